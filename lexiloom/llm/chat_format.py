"""Chat formatting in budgeted windows.  DataFrame functions only.

A turn is written ``<|turn|>role<|text|>text<|end|>``.  Control strings inside roles and texts, those of this
template and those of other common ones, get one backslash after their first character; one that already has
backslashes there gets one more, so that the escape is reversible.

A conversation goes into windows of at most ``BUDGET`` tokens, markers and escapes included.  A turn's tokens are estimated as one for each
four UTF-8 bytes of what is written for it, rounded up, unless the table brings a column of token counts.  Prefix sums of the turns' tokens
give each window's span of whole turns.  Every later window starts with the conversation's system turn, if it fits beside the
window's first own turn, and with the last turns before that one as far as ``HISTORY`` tokens and the rest of the budget allow.  Only a single
turn that is beyond the budget on its own makes a window that exceeds it, and carries nothing.  Carried turns are repeats: they are never
under the loss mask, so each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.rows import CHUNK, let, scan

BUDGET, HISTORY = 1024, 256
TARGET, SYSTEM = "assistant", "system"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The fewest tokens of a turn: its markers.
LEAST = -(-(len(TURN) + len(TEXT) + len(END)) // 4)
#: What begins a control string (after the bracket) in this and other public templates.
_TAILS = r"(\||/?s>|/?INST\]|</?SYS>>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])(\\*){_TAILS}", r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"([<\[])\\(\\*){_TAILS}", "$1$2$3")


def _cuts(sums: Column, system: Column, budget: int, history: int) -> Column:
    """Windows as (start, hist, sys): the first own turn, the first carried one, and whether the system turn comes before that.

    ``sums``: tokens of all turns before each one, and of all; ``system``: the system turn's place, null without one.  Found in one pass over the
    turns; what was found goes into parts of ``CHUNK``, so that no long array is copied for each window.
    """
    shape = "array<struct<start:int,hist:int,sys:boolean>>"
    cost = lambda i: F.get(sums, i + 1) - F.get(sums, i)

    def opened(i: Column) -> Column:
        """The window that begins with turn ``i``, and its tokens."""
        room = F.lit(budget) - cost(i)
        own = F.coalesce((system < i) & (cost(system) <= room), F.lit(False))

        def with_history(left: Column) -> Column:
            far = F.greatest(F.lit(0), i - history // LEAST - 1)
            first = F.coalesce(F.array_min(F.filter(F.sequence(far, i), lambda j: F.get(sums, i) - F.get(sums, j) <= left)), i)
            return let(first, lambda h: F.struct(h.alias("hist"), (own & (system < h)).alias("sys")))

        carried = let(F.least(F.lit(history).cast("long"), F.when(own, room - cost(system)).otherwise(room)), with_history)
        used = lambda c: cost(i) + F.get(sums, i) - F.get(sums, c["hist"]) + F.when(c["sys"], cost(system)).otherwise(F.lit(0).cast("long"))
        return let(carried, lambda c: F.struct(F.struct(i.alias("start"), c["hist"].alias("hist"), F.coalesce(c["sys"], F.lit(False)).alias("sys")).alias("cut"), used(c).alias("used")))

    none = F.array().cast(f"array<{shape}>")
    start = F.struct(none.alias("full"), F.array().cast(shape).alias("part"), F.lit(0).cast("long").alias("used"))

    def step(a: Column, i: Column) -> Column:
        fits = (i > 0) & (a["used"] + cost(i) <= budget)
        more = let(
            opened(i),
            lambda o: F.when(F.size(a["part"]) < CHUNK, F.struct(a["full"].alias("full"), F.array_append(a["part"], o["cut"]).alias("part"), o["used"].alias("used"))).otherwise(
                F.struct(F.array_append(a["full"], a["part"]).alias("full"), F.array(o["cut"]).cast(shape).alias("part"), o["used"].alias("used"))
            ),
        )
        return F.when(fits, F.struct(a["full"].alias("full"), a["part"].alias("part"), (a["used"] + cost(i)).alias("used"))).otherwise(more)

    return let(F.aggregate(F.sequence(F.lit(0), F.size(sums) - 2), start, step), lambda a: F.flatten(F.array_append(a["full"], a["part"])))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens_col: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, carried, formatted, loss_spans.

    ``turns`` has one row per turn: conv_id, turn, role, text, and the text's token count if ``tokens_col`` names it (markers are added to it);
    other columns are ignored.  Turns follow ``turn`` (null first; ties by role, then text); null roles and texts are empty; rows
    without a conv_id form one conversation; texts and conversations of any length are written whole; an empty table gives an empty result.
    ``carried`` is the number of repeated turns at the start, ``loss_spans`` the (start, end) code points of the target texts in
    ``formatted``.  The first system turn of a conversation is the one that is retained.
    """
    held = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        (F.greatest(F.lit(0), F.coalesce(F.col(tokens_col), F.lit(0))) if tokens_col else F.lit(None)).cast("long").alias("tokens"),
    )
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(held)).alias("t"))

    def dress(t: Column) -> Column:
        def written(x: Column) -> Column:
            size = F.octet_length(x["head"]) + F.octet_length(x["body"]) + len(END)
            return F.struct(F.coalesce(t["tokens"] + LEAST, F.ceil(size / 4).cast("long")).alias("cost"), (t["role"] == SYSTEM).alias("system"), (t["role"] == TARGET).alias("target"), x["head"].alias("head"), x["body"].alias("body"))

        return let(F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body")), written)

    out = per.select("conv_id", F.transform("t", dress).alias("d"))
    sums = F.concat(F.array(F.lit(0).cast("long")), scan(F.transform("d", lambda x: x["cost"])))
    spot = F.array_position(F.transform("d", lambda x: x["system"]), F.lit(True)).cast("int")
    out = out.select("conv_id", "d", sums.alias("sums"), F.when(spot > 0, spot - 1).alias("at"))

    def windows(cuts: Column) -> Column:
        nothing = F.slice(F.col("d"), F.lit(1), F.lit(0))

        def one(c: Column, i: Column) -> Column:
            end = F.coalesce(F.get(cuts, i + 1)["start"], F.size("d"))
            retained = F.when(c["sys"], F.slice(F.col("d"), F.col("at") + 1, F.lit(1))).otherwise(nothing)
            return F.struct(i.alias("window"), (c["start"] - c["hist"] + F.size(retained)).alias("carried"), F.concat(retained, F.slice(F.col("d"), c["hist"] + 1, end - c["hist"])).alias("turns"))

        return F.transform(cuts, one)

    out = out.select("conv_id", F.explode(let(_cuts(F.col("sums"), F.col("at"), budget, history), windows)).alias("w"))

    def mask(turns_: Column, carried: Column) -> Column:
        ends = scan(F.transform(turns_, lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(END)).cast("long")))

        def one(e: Column) -> Column:
            def span(t: Column, i: Column) -> Column:
                end = (F.get(e, i) - len(END)).cast("int")
                return F.struct((end - F.length(t["body"])).alias("start"), end.alias("end"), (t["target"] & (i >= carried)).alias("own"))

            return F.transform(F.filter(F.transform(turns_, span), lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

        return let(ends, one)

    text = F.array_join(F.transform("w.turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return out.select("conv_id", F.col("w.window").alias("window"), F.col("w.carried").alias("carried"), text.alias("formatted"), mask(F.col("w.turns"), F.col("w.carried")).alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Back from formatted windows: one row per conversation with its turns (role, text), in order, and
    the unescaped texts under the loss mask."""

    def parse(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(END))
        return F.struct(unescape(F.substring_index(body, TEXT, 1)).alias("role"), unescape(F.substring(body, F.length(F.substring_index(body, TEXT, 1)) + len(TEXT) + 1, F.length(body))).alias("text"))

    parts = F.split(F.col("formatted"), r"<\|turn\|>")
    own = F.transform(F.slice(parts, F.col("carried") + 2, F.size(parts)), parse)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    rows = windows.select("conv_id", F.struct("window", own.alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    return per.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["loss"])).alias("loss"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"))


def conversation_digest(read: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
