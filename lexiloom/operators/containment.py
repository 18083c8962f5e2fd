"""Where byte strings occur inside others, as equi-joins.

``contains`` as a join condition plans as a nested loop.  Here every substring of a short haystack is a join key; a long one
(over ``SHORT`` bytes) is keyed by its ``GRAM``-byte runs instead, which grow with its length and not with the square of it.  A
needle then asks by its rarest run and is verified at the place found; needles below ``GRAM`` bytes are keys themselves.
Runs are looked up in a bitmap where they stand, so those of no needle never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.stash import dealt, stash

SHORT, GRAM, PIECE = 24, 8, 256
#: Bits of a run's slot; bytes scanned at once; bytes on both sides that a found run brings along at most; found runs in a batch.
SLOT_BITS, STRETCH, AROUND, PER_BATCH = 22, 1 << 20, 512, 20_000


def _numbers(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _asked(needles: DataFrame, hay: DataFrame) -> tuple[DataFrame, DataFrame]:
    return needles.select("id", "b").where(F.length("b") > 0), hay.select("hid", "h").where(F.length("h") > 0)


def _substrings(hay: DataFrame, proper: bool = False) -> DataFrame:
    """(hid, p, b): the substrings of short haystacks with their places from 1."""
    at = F.explode(_numbers(F.lit(1), F.length("h"))).alias("p")
    near = hay.where(F.length("h") <= SHORT).select("hid", "h", at)
    subs = near.select("hid", "p", F.explode(_numbers(F.lit(1), F.length("h") - F.col("p") + 1)).alias("n"), "h")
    if proper:
        subs = subs.where(F.col("n") < F.length("h"))
    return subs.select("hid", "p", F.substring(F.col("h"), F.col("p"), F.col("n")).alias("b"))


def _slots(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The GRAM-byte runs that start at each byte of ``buf`` as integers, and their slots."""
    grams = np.lib.stride_tricks.as_strided(buf[:GRAM].view("<u8"), (len(buf) - GRAM + 1,), (1,)).copy()
    return grams, (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _scan(texts: list[bytes], marks: np.ndarray, slots: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, place from 0, mark or slot) of the runs whose slot has a mark of 0 or more, a stretch at a time."""
    ends = np.cumsum([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    for at in range(0, len(buf) - GRAM + 1, STRETCH):
        slot = _slots(buf[at : at + STRETCH + GRAM - 1])[1]
        mark = marks[slot]
        hit = np.flatnonzero(mark >= 0)
        row = np.searchsorted(ends, hit + at, side="right")
        inside = hit + at + GRAM <= ends[row]
        hit, row = hit[inside], row[inside]
        yield row, hit + at - np.where(row > 0, ends[row - 1], 0), (slot if slots else mark)[hit]


def _grams(bitmap: np.ndarray):
    """(id, b) to (id, o, g, slot): every run with its place from 1 of each needle whose runs all have their slot in the haystacks' ``bitmap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(bitmap).astype(bool)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            if not texts:
                continue
            sizes = np.array([len(t) for t in texts])
            starts = np.cumsum(sizes) - sizes
            slots = _slots(np.frombuffer("".join(texts).encode("latin-1"), np.uint8))[1]
            n = sizes - GRAM + 1
            row = np.repeat(np.arange(len(texts)), n)
            o = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            own = slots[starts[row] + o]
            keep = ~np.isin(row, row[~known[own]])
            row, o, own = row[keep], o[keep], own[keep]
            grams = [texts[r][k : k + GRAM] for r, k in zip(row.tolist(), o.tolist(), strict=True)]
            yield pa.record_batch({"id": pa.array(ids[row], pa.int64()), "o": pa.array(o + 1, pa.int32()), "g": pa.array(grams, pa.string()), "slot": pa.array(own, pa.int64())})

    return run


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots of all runs of the haystacks, as packed parts of a bitmap."""
    seen, every = np.zeros(1 << SLOT_BITS, np.uint8), np.zeros(1 << SLOT_BITS, np.int32)
    for batch in batches:
        for _, _, slots in _scan([t.encode("latin-1") for t in batch.column(0).to_pylist()], every, True):
            seen[slots] = 1
    bits = np.packbits(seen).reshape(-1, 1 << 13)
    some = np.flatnonzero(bits.any(axis=1))
    yield pa.record_batch({"part": pa.array(some, pa.int64()), "bits": pa.array([bits[k].tobytes() for k in some], pa.binary())})


def _either(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table["bits"].to_pylist()])
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _bits(key: tuple, table: pa.Table) -> pa.Table:
    own = np.zeros(1 << 16, np.uint8)
    own[table["slot"].to_numpy() & 0xFFFF] = 1
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})


def _bitmap(slots: DataFrame) -> np.ndarray:
    """Packed bits of the slots; half a megabyte, however many needles there are."""
    return _whole(slots.select("slot").distinct().groupBy(F.shiftright("slot", 16).alias("part")).applyInArrow(_bits, "part long, bits binary"))


def _whole(parts: DataFrame) -> np.ndarray:
    out = np.zeros((1 << (SLOT_BITS - 16), 1 << 13), np.uint8)
    for r in parts.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _marks(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots in use, and the number of each slot among them, else -1."""
    used = np.flatnonzero(np.unpackbits(bitmap))
    marks = np.full(1 << SLOT_BITS, -1, np.int32)
    marks[used] = np.arange(len(used))
    return used, marks


def _counted(bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, marks = _marks(bitmap)
        counts, held, size = np.zeros(len(used), np.int64), [], 0
        for batch in batches:
            for _, _, mark in _scan([t.encode("latin-1") for t in batch.column(0).to_pylist()], marks):
                held.append(mark)
                size += len(mark)
                if size > max(len(used), STRETCH):
                    counts += np.bincount(np.concatenate(held), minlength=len(used))
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=len(used))
        some = np.flatnonzero(counts)
        yield pa.record_batch({"slot": pa.array(used[some], pa.int64()), "c": pa.array(counts[some], pa.int64())})

    return run


def _seen(bitmap: np.ndarray, around: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marks(bitmap)[1]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, place, _ in _scan([t.encode("latin-1") for t in texts], marks):
                for at in range(0, len(row), PER_BATCH):
                    some = list(zip(row[at : at + PER_BATCH].tolist(), place[at : at + PER_BATCH].tolist(), strict=True))
                    yield pa.record_batch(
                        {
                            "hid": pa.array([ids[r] for r, _ in some], pa.int64()),
                            "p": pa.array([p + 1 for _, p in some], pa.int32()),
                            "g": pa.array([texts[r][p : p + GRAM] for r, p in some], pa.string()),
                            "left": pa.array([min(p, around) for _, p in some], pa.int32()),
                            "win": pa.array([texts[r][max(0, p - around) : p + around] for r, p in some], pa.string()),
                        }
                    )

    return run


def _by_seeds(needles: DataFrame, far: DataFrame) -> DataFrame:
    """(id, hid, pos) of needles of GRAM bytes or more.

    The haystacks are read three times: a bitmap of their runs' slots leaves the needles that can stand in them; runs that share a slot with one of
    these needles' are counted, so each needle has its rarest run, its seed; then only the seeds leave the scan, with the bytes around them.  Slots that several runs share cost comparisons and no result.
    """
    longest = needles.agg(F.max(F.length("b")).alias("n")).first()["n"]
    if longest is None:
        return needles.select("id", F.lit(0).cast("long").alias("hid"), F.lit(0).alias("pos"))
    around = max(GRAM, min(AROUND, longest))
    far = far.select("hid", "h")
    parts = far.select("h").mapInArrow(_present, "part long, bits binary").groupBy("part").applyInArrow(_either, "part long, bits binary")
    asked = stash(needles.select(F.col("id").cast("long").alias("id"), "b").mapInArrow(_grams(_whole(parts)), "id long, o int, g string, slot long"), "grams")
    counts = far.select("h").mapInArrow(_counted(_bitmap(asked)), "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    best = asked.join(dealt(counts), "slot").groupBy("id").agg(F.min(F.struct("c", "o", "g", "slot")).alias("x"))
    seeds = stash(best.join(dealt(needles), "id").select("id", "b", "x.o", "x.g", "x.slot"), "seeds")
    found = far.select(F.col("hid").cast("long").alias("hid"), "h").mapInArrow(_seen(_bitmap(seeds), around), "hid long, p int, g string, left int, win string")
    hits = found.join(dealt(seeds), "g").withColumn("s", F.col("p") - F.col("o") + 1).where("s > 0")
    # the part of the needle that the window shows; of a longer needle, the rest is compared in the haystack
    skip = F.greatest(F.col("o") - 1 - F.col("left"), F.lit(0))
    shown = F.substring(F.col("b"), skip + 1, F.col("o") - 1 + around - skip)
    same = hits.where(F.substring(F.col("win"), F.col("left") - F.col("o") + 2 + skip, F.length(shown)) == shown).withColumn("whole", F.length(shown) == F.length("b"))
    done = same.where("whole").select("id", "hid", (F.col("s") - 1).alias("pos"))
    if longest <= around:
        return done
    open_ = same.where("not whole").select("id", "hid", "s", "b").join(dealt(far), "hid")
    return done.unionByName(open_.where(F.substring(F.col("h"), F.col("s"), F.length("b")) == F.col("b")).select("id", "hid", (F.col("s") - 1).alias("pos")))


def _in_long(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(id, hid, pos) in haystacks of over SHORT bytes."""
    far = hay.where(F.length("h") > SHORT)
    # pieces of PIECE characters that see GRAM - 1 more: a place in a piece is reached in constant time, one in a long string is not
    cut = F.posexplode(F.regexp_extract_all("h", F.lit(rf"(?s)(?=(.{{1,{PIECE + GRAM - 1}}})).{{1,{PIECE}}}"), F.lit(1))).alias("i", "c")
    pieces = far.select("hid", cut)

    def runs(n: Column) -> Column:
        """The substrings of ``n`` characters that start in a piece, as an array: exploded rows then do not carry the piece."""
        return F.transform(_numbers(F.lit(1), F.least(F.lit(PIECE), F.length("c") - n + 1)), lambda p: F.struct(p.alias("p"), F.substring(F.col("c"), p, n).alias("b")))

    place = (F.col("i") * PIECE + F.col("x.p")).alias("p")
    tiny = needles.where(F.length("b") < GRAM)
    sizes = sorted(r["n"] for r in tiny.select(F.length("b").alias("n")).distinct().collect())  # at most GRAM - 1 numbers
    if not sizes:
        return _by_seeds(needles, far)
    some = F.flatten(F.transform(F.array(*map(F.lit, sizes)).cast("array<int>"), runs))
    short = pieces.select("hid", "i", F.explode(some).alias("x")).select("hid", place, "x.b").join(dealt(tiny), "b").select("id", "hid", (F.col("p") - 1).alias("pos"))
    return short.unionByName(_by_seeds(needles.where(F.length("b") >= GRAM), far))


def _any_long(hay: DataFrame) -> bool:
    return bool(hay.where(F.length("h") > SHORT).head(1))


def occurrences(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(id, hid, pos): every place (from 0) where needle ``b`` stands in haystack ``h``.

    ``needles``: id, b; ``hay``: hid, h.  A string occurs in itself; empty and null strings occur nowhere.
    """
    needles, hay = _asked(needles, hay)
    found = _substrings(hay).join(dealt(needles), "b").select("id", "hid", (F.col("p") - 1).alias("pos"))
    return found.unionByName(_in_long(needles, hay)) if _any_long(hay) else found


def first_occurrences(needles: DataFrame, hay: DataFrame, proper: bool = False) -> DataFrame:
    """(id, hid, pos): the first place of each needle that has one, by ``hid``, then by place.

    ``proper``: not as the whole of a haystack.  Equal substrings meet on the map side before anything is shuffled, so a
    one-letter needle costs one row per task and not one per place.
    """
    needles, hay = _asked(needles, hay)
    # one long per place: a struct would need a sort instead of a hash aggregation
    near = _substrings(hay, proper).groupBy("b").agg(F.min(F.col("hid") * 32 + F.col("p")).alias("x"))
    found = near.join(dealt(needles), "b").select("id", F.shiftright("x", 5).alias("hid"), (F.col("x").bitwiseAND(F.lit(31)) - 1).cast("int").alias("pos"))
    if not _any_long(hay):
        return found
    far = _in_long(needles, hay)
    if proper:
        sized = needles.select("id", F.length("b").alias("nb"))
        far = far.join(dealt(sized), "id").join(dealt(hay.where(F.length("h") > SHORT).select("hid", F.length("h").alias("nh"))), "hid").where("nb < nh").select("id", "hid", "pos")
    return found.unionByName(far).groupBy("id").agg(F.min(F.struct("hid", "pos")).alias("x")).select("id", "x.hid", "x.pos")


def contained_pairs(vocab: DataFrame) -> DataFrame:
    """(id, hid, pos): where a word of ``vocab`` (distinct id, b) stands inside another one."""
    return occurrences(vocab, vocab.select(F.col("id").alias("hid"), F.col("b").alias("h"))).where("id <> hid")


def survivors(vocab: DataFrame) -> DataFrame:
    """The words that stand in no other word.  A vocabulary of one word stays as it is; of several, the empty word goes."""
    gone = first_occurrences(vocab, vocab.select(F.col("id").alias("hid"), F.col("b").alias("h")), proper=True).select("id")
    words = vocab.where(F.length("b") > 0)
    return words.join(dealt(gone), "id", "left_anti") if words.head(1) else vocab


def survivors_by_force(words: list[bytes]) -> list[bytes]:
    """The same by comparing all pairs: for tests."""
    distinct = list(dict.fromkeys(words))
    if len(distinct) <= 1:
        return distinct
    return [w for w in distinct if w and not any(w != o and w in o for o in distinct)]


def multi_pattern(patterns: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, start, end): every occurrence, overlapping ones too; byte places, ``end`` inclusive.

    ``patterns``: pattern_id, b; ``docs``: doc_id, b.  An empty pattern matches nothing.
    """
    hits = occurrences(patterns.select(F.col("pattern_id").alias("id"), "b"), docs.select(F.col("doc_id").alias("hid"), F.col("b").alias("h")))
    sized = patterns.select(F.col("pattern_id").alias("id"), F.length("b").alias("n"))
    return hits.join(dealt(sized), "id").select(F.col("hid").alias("doc_id"), F.col("id").alias("pattern_id"), F.col("pos").cast("int").alias("start"), (F.col("pos") + F.col("n") - 1).cast("int").alias("end"))
