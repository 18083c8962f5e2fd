"""Personal data: pattern spans and information-theoretic sanitisation.  DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, payment cards (Luhn) and telephone numbers.  The method
then asks which other terms give a protected entity away: over the corpus, a term that stands in a document with
an entity, outside all base spans, is scored by its pointwise mutual information with it,

    bits(t, e) = log2( contexts(t, e) * texts / (df(t) * de(e)) ).

The counts are of distinct texts, copies as one.  Among the texts with entities, on which contexts, de and the larger part of df of what
discloses rest, copies are what ``near_copies`` links; a text without an entity counts towards df(t) once for all that have its smallest
shingle hash.  A term seen with an entity in at least ``MIN_CONTEXTS`` texts, whose share contexts(t, e) / df(t) is at least ``MIN_SHARE`` and whose
bits reach ``MIN_BITS``, discloses the entity: its occurrences are spans of kind ``term``.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import rows
from lexiloom.llm.rows import OPEN, SHUT, let
from lexiloom.llm.tables import beside
from lexiloom.operators.components import connected_components
from lexiloom.plans.stash import cut, stash

MIN_CONTEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 6.0
#: Slots of the filter of candidate terms: sixteen for each of them, within these bounds.
FEWEST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
#: Near copies: words of a shingle, values of a sketch, bands of two minima each, least similarity.  One word in ten replaced leaves
#: about 0.57 of the shingles.
SHINGLE, SKETCH, BANDS, COPY = 3, 64, 24, 0.4
#: Entities of a text from which on those of too few texts are left out first.
MANY = 64
#: Texts with disclosing terms whose keys are broadcast; more are joined.
MOST_KEYS = 1_000_000
#: Spans that are replaced against one stretch of the text.
PART = 512

#: Possessive and anchored forms of the base patterns: same matches, linear time, no recursion.
KINDS: dict[str, str] = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be worth the full pattern.
_HINTS = {"email": "@", "ip": None, "card": None, "phone": "+"}
_GUARDS = {"ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}"}


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def _luhn(d: Column) -> Column:
    places = F.sequence(F.lit(0), F.length(d) - 1)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = x * 2
        return total + F.when(i % 2 == 0, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _worth(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(_HINTS[kind])) if _HINTS[kind] else text.rlike(_GUARDS[kind])


def _spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value), in code points.  ``text`` holds none of the two marks."""

    def place(cut_: Column) -> Column:
        def one(at: Column) -> Column:
            def span(piece: Column, i: Column) -> Column:
                value, start = rows.matched(piece), F.get(at, i).cast("int")
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).cast("int").alias("end"), value.alias("value"))

            return F.filter(F.transform(F.slice(cut_, F.lit(2), F.size(cut_)), span), lambda x: _valid(kind, x["value"]))

        return let(rows.starts(cut_), one)

    return F.when(_worth(text, kind), let(rows.pieces(text, KINDS[kind]), place)).otherwise(F.array().cast(_SPANS))


def _without(kind: str, text: Column) -> Column:
    """``text`` with a blank for each valid match of the kind."""

    def blanked(piece: Column, i: Column) -> Column:
        return F.when(i == 0, piece).when(_valid(kind, rows.matched(piece)), F.concat(F.lit(" "), rows.rest(piece))).otherwise(F.replace(piece, F.lit(SHUT), F.lit("")))

    return F.when(_worth(text, kind), F.array_join(F.transform(rows.pieces(text, KINDS[kind]), blanked), "")).otherwise(text)


def with_base_spans(docs: DataFrame, text_col: str = "text", out: str = "base_spans") -> DataFrame:
    """Add ``out``: array of (kind, start, end, value), by kind as listed, then by start."""
    return docs.withColumn(out, let(rows.unmarked(F.col(text_col)), lambda t: F.concat(*[_spans(t, k) for k in KINDS])))


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def _outside(text: Column) -> Column:
    """Distinct terms of the text after its base spans, kind by kind, have become blanks."""
    out = text
    for kind in KINDS:
        out = let(out, partial(_without, kind))
    return F.filter(F.array_distinct(_terms(out)), lambda w: F.length(w) > 1)


def _entities() -> Column:
    """Hashes of the distinct entities of the base spans."""
    name = lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(_digits(s["value"])))
    return F.array_distinct(F.transform("base_spans", lambda s: F.xxhash64(name(s))))


def _sketch(text: Column) -> Column:
    """The ``SKETCH`` smallest hashes of the text's word shingles; null without words."""
    return let(F.filter(_terms(text), lambda w: w != ""), lambda w: F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(_shingles(w))), 1, SKETCH)))


def _shingles(w: Column) -> Column:
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))


def near_copies(sketches: DataFrame) -> DataFrame:
    """(text_key, unit) of every text that has near copies among ``sketches`` (text_key, sketch; each text once); ``unit`` is the smallest
    key of its group.

    Texts that agree in a band (two minima over the sketch) with the band's first text are linked if their sketches put the
    similarity at ``COPY`` or more; groups are what hangs together by links.  A pair of similarity 0.5 shares no band with
    probability (1 - 0.5**2)**24, about 1e-3.
    """
    held = sketches.where("sketch is not null")
    low = lambda i: F.array_min(F.transform("sketch", lambda x: F.xxhash64(x, F.lit(i))))
    bands = F.array(*[F.xxhash64(F.lit(b), low(2 * b), low(2 * b + 1)) for b in range(BANDS)])
    banded = stash(held.select("text_key", F.explode(bands).alias("band")), "bands")
    first = cut(banded.groupBy("band").agg(F.min("text_key").alias("unit"), F.max("text_key").alias("last")).where("unit < last").drop("last"))
    links = cut(banded.join(first, "band").where("text_key <> unit").select("text_key", "unit").distinct())
    both = links.join(held, "text_key").join(held.select(F.col("text_key").alias("unit"), F.col("sketch").alias("other")), "unit")
    union = F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH)
    alike = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, F.col("sketch")), F.col("other"))) >= COPY * F.size(u))
    true = cut(both.where(alike).select("text_key", "unit"))
    if not true.head(1):
        return true
    return cut(connected_components(true, "text_key", "unit").select(F.col("id").alias("text_key"), F.col("component").alias("unit")))


def _in_units(own: DataFrame, by: list[str], out: str) -> DataFrame:
    """``own`` holds each (text_key, *by) once, with the text's unit; number of units by ``by``.  Texts without near copies are units
    of their own and are summed before they are dealt out."""
    alone = own.where("unit is null").groupBy(*by).agg(F.count("*").alias("n"))
    grouped = own.where("unit is not null").select("unit", *by).distinct().groupBy(*by).agg(F.count("*").alias("n"))
    return alone.unionByName(grouped).groupBy(*by).agg(F.sum("n").alias(out))


class _Filter:
    """One byte for each slot of the hashes of ``terms`` (term, distinct): at most ``MOST_SLOTS`` bytes, whatever the corpus."""

    def __init__(self, terms: DataFrame) -> None:
        n = terms.count()
        self.slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (16 * n).bit_length()))
        held = bytearray(self.slots)
        for at in terms.select(self._slot(F.col("term")).alias("at")).distinct().toArrow()["at"].to_pylist():  # at most MOST_SLOTS numbers
            held[at] = 1
        self.table = F.lit(held)

    def _slot(self, w: Column) -> Column:
        return F.pmod(F.xxhash64(w), F.lit(self.slots)).cast("int")

    def passes(self, w: Column) -> Column:
        return F.substring(self.table, self._slot(w) + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def disclosing_terms(docs: DataFrame, found: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> tuple[DataFrame, DataFrame | None]:
    """One row per term over the thresholds: term, bits (its largest), contexts; and the texts (text_key) that may hold one.

    ``found``: text_key, entities, terms, sketch of the texts with entities.  These give the candidates: a term that stands in more of
    them than ``min_share`` allows for its contexts is none, which leaves out the common words before the corpus is read.  Words of all
    documents pass a filter of the candidates (a fixed size whatever the corpus) inside the row; the counts of those that pass are exact.
    """
    texts = stash(found.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("entities", "terms", "sketch")]), "entity-texts")
    units = near_copies(texts.select("text_key", "sketch"))
    # of a text with very many entities only those that enough texts hold meet its terms: the others could not be scored
    one = texts.select("text_key", F.explode("entities").alias("e"))
    enough = one.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= min_contexts).select("e")
    heavy = texts.where(F.size("entities") > MANY).select("text_key", F.explode("entities").alias("e"))
    kept = heavy.join(enough, "e", "left_semi").groupBy("text_key").agg(F.collect_set("e").alias("es"))
    scored_ = F.when(F.size("entities") > MANY, F.coalesce("es", F.array().cast("array<long>"))).otherwise(F.col("entities")).alias("entities")
    seen = stash(texts.join(units, "text_key", "left").join(kept, "text_key", "left").select("text_key", "unit", scored_, "terms"), "entity-units")
    each = seen.select("text_key", "unit", "entities", F.explode("terms").alias("term"))
    pairs = _in_units(each.select("text_key", "unit", F.explode("entities").alias("e"), "term"), ["e", "term"], "contexts")
    likely = cut(pairs.where(F.col("contexts") >= min_contexts))
    among = _in_units(each.select("text_key", "unit", "term"), ["term"], "among")
    likely = cut(likely.join(among, "term").where(F.col("contexts") >= min_share * F.col("among")))
    none = likely.select("term", F.lit(0.0).alias("bits"), "contexts")
    terms = cut(likely.select("term").distinct())
    if not terms.head(1):
        return none, None
    asked = _Filter(terms)
    held = docs.select(F.xxhash64("text").alias("text_key"), let(rows.unmarked(F.col("text")), _terms).alias("w"))
    hits = held.select("text_key", F.filter(F.array_distinct("w"), asked.passes).alias("terms"), "w").where(F.size("terms") > 0)
    alike = F.array_min(let(F.filter("w", lambda x: x != ""), _shingles))
    holders = stash(hits.select("text_key", alike.alias("alike"), F.explode("terms").alias("term")).join(terms, "term", "left_semi"), "holders")
    others = holders.join(texts.select("text_key"), "text_key", "left_anti").select("alike", "term").distinct().groupBy("term").agg(F.count("*").alias("others"))
    de = _in_units(seen.select("text_key", "unit", F.explode("entities").alias("e")), ["e"], "de")
    total = docs.select(F.xxhash64("text")).distinct().count()
    df = F.col("among") + F.coalesce("others", F.lit(0))
    scored = likely.join(others, "term", "left").withColumn("df", df).join(de, "e").withColumn("bits", F.log2(F.col("contexts") * F.lit(float(total)) / (F.col("df") * F.col("de"))))
    over = scored.where((F.col("bits") >= min_bits) & (F.col("contexts") >= min_share * F.col("df")))
    out = cut(over.groupBy("term").agg(F.max("bits").alias("bits"), F.max("contexts").alias("contexts")))
    return out, cut(holders.join(out.select("term"), "term", "left_semi").select("text_key").distinct())


def _term_spans(docs: DataFrame, terms: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text_key, term_spans): occurrences of disclosing terms, for the texts of ``keys``, which are those that hold any."""
    asked = _Filter(terms)
    known = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
    some = docs.select("doc_id", F.xxhash64("text").alias("text_key"), rows.unmarked(F.col("text")).alias("text")).join(known, "text_key", "left_semi")

    def place(cut_: Column) -> Column:
        words = lambda at: F.transform(F.slice(cut_, F.lit(2), F.size(cut_)), lambda p, i: F.struct(F.get(at, i).cast("int").alias("start"), rows.matched(p).alias("value")))
        return F.filter(let(rows.starts(cut_), words), lambda x: asked.passes(F.lower(x["value"])))

    # only words that pass the filter leave the row
    words = some.select("doc_id", "text_key", F.explode(let(rows.pieces(F.col("text"), r"[\p{L}\p{N}]+"), place)).alias("w")).distinct()
    named = words.select("doc_id", "text_key", F.col("w.start").alias("start"), F.col("w.value").alias("value"), F.lower("w.value").alias("term"))
    span = F.struct(F.lit("term").alias("kind"), "start", (F.col("start") + F.length("value")).alias("end"), "value")
    return named.join(terms.select("term"), "term").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(span)).alias("term_spans"))


def find_personal_data(docs: DataFrame, keep_text: bool = True, **limits: float) -> DataFrame:
    """``docs`` with base_spans and term_spans (arrays of kind, start, end, value; code points, end exclusive).

    Spans are found once and stored, beside all columns of ``docs`` or, without ``keep_text``, beside the id alone.  Null and empty texts have
    no spans; texts of any length are searched whole.  Rows that repeat an id are searched one by one.  Null ids are kept; columns of
    ``docs`` named like an output are replaced.  An empty table gives an empty result.
    """
    plain = docs.drop("base_spans", "term_spans", "text_key", "entities", "terms", "sketch")
    found = with_base_spans(plain).withColumn("text_key", F.xxhash64("text"))
    some = F.size("base_spans") > 0
    text = rows.unmarked(F.col("text"))
    about = {"entities": _entities(), "terms": F.when(some, let(text, _outside)), "sketch": F.when(some, let(text, _sketch))}
    stored = stash((found if keep_text else found.select("doc_id", "text", "text_key", "base_spans")).withColumns(about).drop(*([] if keep_text else ["text"])), "spans")
    terms, keys = disclosing_terms(plain.select("doc_id", "text"), stored.where(F.size("entities") > 0).select("text_key", "entities", "terms", "sketch"), **limits)
    out = stored.drop("entities", "terms", "sketch")
    if not terms.head(1):
        return out.drop("text_key").withColumn("term_spans", F.array().cast(_SPANS))
    extra = _term_spans(plain.select("doc_id", "text"), terms, keys).withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    both = out.join(extra, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left").drop("_d", "_t", "text_key")
    return both.withColumn("term_spans", F.coalesce("term_spans", F.array().cast(_SPANS)))


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256 and all spans as text."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    base, both = F.array_join(F.transform("base_spans", name), ","), F.array_join(F.transform(F.concat("base_spans", "term_spans"), name), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace ``text_col`` by its text with every span as ``[KIND]``; overlapping spans merge under the
    first one's kind, of equal starts the longest.

    Terms are removed down to ``[TERM]``.  A null text stays null.  Spans are worked off in parts of ``PART``, each with its own stretch of
    the text, so that a long text with many spans is not walked from its start for each of them.
    """
    text = F.col(text_col)
    ordered = F.sort_array(F.transform(F.concat("base_spans", "term_spans"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def marked(s: Column) -> Column:
        """Of each span the end of the text before it that is gone already."""
        upto = rows.scan(F.transform(s, lambda x: (-x["back"]).cast("long")), F.greatest)
        return let(upto, lambda u: F.transform(s, lambda x, i: F.struct(F.coalesce(F.get(u, i - 1), F.lit(0)).cast("int").alias("gone"), x["start"].alias("start"), F.get(u, i).cast("int").alias("end"), x["kind"].alias("kind"))))

    def part(m: Column, k: Column) -> Column:
        """Text and marks of the k-th part, from the end of the part before."""
        own = F.slice(m, k * PART + 1, F.lit(PART))

        def written(o: Column) -> Column:
            begin = F.get(o, F.lit(0))["gone"]
            stretch = F.substring(text, begin + 1, F.get(o, F.size(o) - 1)["end"] - begin)

            def one(x: Column, t: Column) -> Column:
                gap = F.substring(t, x["gone"] - begin + 1, F.greatest(F.lit(0), x["start"] - x["gone"]))
                return F.when(x["start"] >= x["gone"], F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

            return let(stretch, lambda t: F.array_join(F.transform(o, lambda x: one(x, t)), ""))

        return let(own, written)

    def whole(m: Column) -> Column:
        last = F.floor((F.size(m) - 1) / PART).cast("int")
        tail = F.substring(text, F.get(m, F.size(m) - 1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: part(m, k)), ""), tail)

    some = F.size("base_spans") + F.size("term_spans") > 0
    return found.withColumn(text_col, F.when(some, let(let(ordered, marked), whole)).otherwise(text)).drop("base_spans", "term_spans")


def sanitise(docs: DataFrame, **limits: float) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; rows and columns stay (``n_chars`` follows the text).

    Null and empty texts stay as they are, long ones are worked on whole, rows that repeat an id one by one; an empty table stays empty.
    """

    def work(own: DataFrame) -> DataFrame:
        out = redact(find_personal_data(own, **limits))
        return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out

    return beside(docs, ["doc_id", "text", "n_chars"], work)
