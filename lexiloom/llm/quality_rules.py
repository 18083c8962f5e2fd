"""Quality rules with risk-controlled cutoffs.  DataFrame functions only.

Base rules are fixed.  The method adds, for each stratum (language), how strict the rules of ``LADDER`` may be: at level j a document is
rejected if any signal exceeds its j-th cutoff.  Over the labelled holdout of good documents the exact binomial tail
P(Binomial(n, RISK) <= falsely rejected) must not exceed CONFIDENCE / (strata + 2).  Levels are tried from the most lenient on (fixed-sequence
testing needs no further correction); strata, and the two pools below, share the error by Bonferroni.  So with probability
1 - CONFIDENCE all signals together reject at most RISK of the good documents of each stratum.

A stratum with fewer labels than certify anything, even without a false rejection, is pooled with the others like it, and where that
pool is too small too, with all strata; its guarantee is then the pool's.  Without enough labels altogether only the base rules reject.
Copies are no independent labels: labelled texts of a stratum with the same first window (``WINDOW`` words, the bytewise smallest of the
text) count once, as rejected if one of them is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.rows import let
from lexiloom.llm.tables import beside
from lexiloom.plans.stash import cut

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
RISK, CONFIDENCE, MOST_STRATA = 0.02, 0.05, 10_000

#: Signals, all rising with worse text, and their cutoffs from lenient to strict.
SIGNALS: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length_excess": "abs(word_chars / greatest(n_words, 1) - 5.5)",
    "shout_share": "n_upper / greatest(word_chars, 1)",
}
LADDER: dict[str, list[float]] = {
    "symbols_per_word": [2.0, 1.0, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1],
    "dup_line_share": [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.4],
    "repeat_word_share": [0.29, 0.28, 0.27, 0.26, 0.25, 0.23, 0.21, 0.19, 0.17, 0.15],
    "word_length_excess": [8.0, 6.0, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.2, 2.0],
    "shout_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.3, 0.25],
}
LEVELS = 10


def strictness() -> str:
    """SQL: the most lenient level that rejects a document, ``LEVELS`` if none does."""
    steps = lambda s: " ".join(f"WHEN {SIGNALS[s]} > {c} THEN {j}" for j, c in enumerate(LADDER[s]))
    return "least(" + ", ".join(f"CASE {steps(s)} ELSE {LEVELS} END" for s in SIGNALS) + ")"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which occurs at least twice in the text."""

    def counted(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(p: Column) -> Column:
            same = F.filter(p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])).eqNullSafe(True) | (F.get(p, j + 1)["h"] == x["h"]).eqNullSafe(True))
            return let(
                F.sort_array(F.transform(same, lambda x: x["i"])),
                lambda s: F.aggregate(s, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")), lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")))["sum"],
            )

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(pairs, spots)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) > WINDOW, let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted)).otherwise(F.lit(0)).cast("long")


def _first_window(words: Column) -> Column:
    """The bytewise smallest window, of those that begin with the smallest word that begins one; of a shorter text all words."""
    spots = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def lowest(low: Column) -> Column:
        return F.array_min(F.transform(F.filter(spots, lambda i: F.get(words, i) == low), lambda i: F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ")))

    return F.when(F.size(words) >= WINDOW, let(F.array_min(F.slice(words, F.lit(1), F.size(words) - WINDOW + 1)), lowest)).otherwise(F.array_join(words, " "))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts beside its columns (each text is split once, inside its row).

    Null and blank texts have no words, ``first_window`` (a hash) stands for copies, ``strict_at`` is the first level that rejects.  A column of ``docs`` that bears the name of a count is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.xxhash64(_first_window(w)).alias("first_window"),
        )

    def dups(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    out = docs.withColumns({"_w": let(words, counts), "_l": let(lines, dups), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "n_upper": F.regexp_count(text, F.lit(r"[A-Z]")).cast("long")})
    out = out.withColumns({c: F.col(f"_w.{c}") for c in ("n_words", "word_chars", "n_repeat_words", "first_window")} | {c: F.col(f"_l.{c}") for c in ("n_lines", "n_dup_lines")}).drop("_w", "_l")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("strict_at", F.expr(strictness()))


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), exact, by the recurrence of its terms in logarithms."""
    start = F.struct((n * F.log(F.lit(1.0 - p))).alias("t"), (n * F.log(F.lit(1.0 - p))).alias("s"))

    def merge(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i * F.lit(p / (1.0 - p)))
        return F.struct(t.alias("t"), (F.greatest(a["s"], t) + F.log1p(F.exp(-F.abs(a["s"] - t)))).alias("s"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), start, merge)["s"]


def fewest_labels(strata: int, risk: float = RISK, confidence: float = CONFIDENCE) -> int:
    """Good documents that certify a level if it rejects none of them."""
    return math.ceil(math.log(confidence / (strata + 2)) / math.log(1.0 - risk))


def cutoffs(feats: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per stratum: its certified level (null: none), the good documents tested (n), those rejected at the level (k), and whether they
    are the stratum's own, those of all small strata or those of all strata (basis).

    ``feats``: doc_id, the stratum and what ``features`` adds; ``labels``: doc_id, quality.  All labelled rows that the
    base rules keep and whose quality is 1 count, copies once.  Null strata form one stratum, named by the empty string.  An empty
    table on either side gives an empty result.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    held = feats.where("not base_failed").join(good, "doc_id")
    one = held.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "first_window").agg(F.min("strict_at").alias("strict_at"))
    names = [f"k{j}" for j in range(LEVELS)]
    wide = cut(one.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum((F.col("strict_at") <= j).cast("long")).alias(c) for j, c in enumerate(names)]))
    strata = wide.count()
    need = fewest_labels(strata, risk, confidence)
    bound = math.log(confidence / (strata + 2))

    def tested(rows: DataFrame) -> DataFrame:
        """Rejections grow with the level, so the levels that pass are the first ones."""
        # k beyond n * risk can't pass: its tail is not computed
        tail = lambda k: F.when(F.col(k) <= F.col("n") * risk, _log_tail(F.col(k), F.col("n").cast("double"), risk)).otherwise(F.lit(0.0))
        passed = sum((F.when(tail(k) <= bound, 1).otherwise(0) for k in names), F.lit(0))
        level = F.when(passed > 0, passed - 1)
        return rows.select("stratum", "n", *names, level.cast("int").alias("level")).select("stratum", "level", "n", F.get(F.array(*names), F.col("level")).alias("k"))

    def pool(rows: DataFrame, name: str) -> DataFrame:
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *names)])
        return tested(sums.withColumn("stratum", F.lit(""))).select("level", "n", "k", F.lit(name).alias("basis"))

    small = wide.where(F.col("n") < need).select("stratum")
    own = tested(wide.where(F.col("n") >= need)).withColumn("basis", F.lit("own"))
    both = pool(wide.where(F.col("n") < need), "small strata").unionByName(pool(wide, "all strata")).where(F.col("n") >= need).orderBy("n").limit(1).collect()
    shared = both[0] if both else None
    fall = [F.lit(shared[c] if shared else None).cast(t).alias(c) for c, t in (("level", "int"), ("n", "long"), ("k", "long"), ("basis", "string"))]
    return own.unionByName(small.select("stratum", *fall))


def judge(feats: DataFrame, limits: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``kept``: false where a base rule fails or the rules of the stratum's certified level reject.

    ``limits`` has a row per stratum; it is broadcast if it has at most ``MOST_STRATA``, else joined by its key.  A stratum without a level keeps
    what the base rules keep.
    """
    named = limits.select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level"))
    few = limits.count() <= MOST_STRATA
    joined = feats.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(F.broadcast(named) if few else named, "_stratum", "left")
    bad = F.coalesce(F.col("strict_at") <= F.col("_level"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_stratum", "_level")


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts, with a hash of the text beside the id.  The counts are computed once and stored: a filter on them
    would otherwise be pushed below and compute them again for each mention."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    feats = features(docs.select("doc_id", lang, "text")).withColumn("text_key", F.xxhash64("text"))
    stored = cut(feats.select("doc_id", "lang", "text_key", *_COUNTS, "first_window", "strict_at", "base_failed"))
    return judge(stored, cut(cutoffs(stored, labels)))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row of ``docs``.

    Null, empty and blank texts have no words and fail; texts of any length are counted whole; null and repeated ids keep their rows; a null
    language is a stratum, and a table without ``lang`` is one; other columns are ignored; an empty table gives an empty result.
    """
    return _judged(docs, labels).select("doc_id", *_COUNTS, "base_failed", "kept")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged.  A rejected row is found by its id, language and text, so of rows
    that repeat an id each has its own verdict.  Null, empty and blank texts go; an empty table stays empty."""
    docs_ = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    gone = _judged(docs_, labels).where("not kept").select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("text_key").alias("_t")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.xxhash64("text") == F.col("_t"))
    return beside(docs_, ["doc_id", "lang", "text"], lambda own: own.join(gone, match, "left_anti")).select(*docs.columns)
