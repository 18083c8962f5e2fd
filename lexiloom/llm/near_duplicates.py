"""MinHash near-duplicates through an LSH forest.

A document is its set of distinct five-word shingles; exact copies collapse first.  Each of ``TREES`` orders gives a document a label of
``DEPTH`` + ``MORE`` minima, and all labels are sorted, order by order.  Documents whose labels agree in at least ``DEPTH`` minima stand
together in their order and are candidates: a pair of similarity 0.75 has no such prefix in any of 32 orders with probability
(1 - 0.75**4)**32, about 5e-6.  Neighbours' longest common prefixes cut such a region further: while a part has more than ``DENSE``
documents it is cut at the next minimum, so the depth adapts to the region.

1. Every document is compared with the first document of its part, and the first ones of parts with the region's.
2. What is then left, documents of regions that still hold several components, is decided exactly by a prefix filter: with shingles
   ordered from rare to common, two sets of similarity 0.75 share one among the first 1/7 of the smaller and the first 1/4 of the larger
   set, and how far down it stands bounds the size of the other set.  Documents that share such a shingle, and whose sizes and places allow
   a link, are compared in blocks of ``BLOCK``; equal groups of documents are compared once.

All comparisons are on full shingle sets.  No region is reduced, capped or sampled, pairs are never emitted as rows (a block returns
at most a spanning forest of its links), and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.hashing import MASK, encode, mix, shingle_sets
from lexiloom.llm.tables import slices, source
from lexiloom.operators.components import connected_components
from lexiloom.plans.stash import cut, stash

TREES, DEPTH, MORE = 32, 4, 8
SHINGLE, DENSE, BLOCK = 5, 64, 256
#: In regions that were cut, first documents that a document is compared with; rows that are cut into parts at a time.
BEST, CHUNK = 2, 1 << 16
#: Slots of shingle counts for the prefix filter's order, and how many of the common ones are handed to all tasks.
SLOTS, MOST_COMMON = 1 << 24, 1 << 20
_SEEDS = np.random.default_rng(20240229).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature_batch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per non-empty set and order: the hash of its first DEPTH minima, and 16 bits of each of these packed into one number."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = np.empty((TREES * DEPTH, len(sets)), np.uint64)
    buffer = np.empty_like(flat)
    for k, seed in enumerate(_SEEDS):
        np.multiply(flat, seed, out=buffer)
        low[k] = np.minimum.reduceat(buffer, at)
    low = mix(low).reshape(TREES, DEPTH, len(sets))
    keys, packed = np.zeros((2, TREES, len(sets)), np.uint64)
    for d in range(DEPTH):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, d])
        packed = packed << np.uint64(16) | low[:, d] >> np.uint64(48)
    return mix(keys + np.arange(1, TREES + 1, dtype=np.uint64)[:, None]).T.copy(), packed.T.copy()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, budget=2 << 20):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        sets = shingle_sets([encode(t) for t in texts], SHINGLE)
        count = np.array([len(s) for s in sets], np.int64)
        sums = np.array([int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets], np.uint64)
        alts = np.array([int(np.add.reduce(mix(s))) if len(s) else 0 for s in sets], np.uint64)
        full = np.flatnonzero(count)
        keys = np.zeros((len(sets), TREES), np.uint64)
        packed = np.zeros((len(sets), TREES), np.uint64)
        step = 0
        while step < len(full):  # so many shingles at a time that they stay in cache
            end, held = step, 0
            while end < len(full) and (end == step or held + count[full[end]] <= 65536):
                held += count[full[end]]
                end += 1
            keys[full[step:end]], packed[full[step:end]] = _signature_batch([sets[i] for i in full[step:end]])
            step = end
        offsets = np.arange(0, len(sets) * TREES + 1, TREES, dtype=np.int32)
        yield pa.record_batch(
            [
                ids,
                pa.array(count),
                pa.array(sums.view(np.int64)),
                pa.array(alts.view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                pa.ListArray.from_arrays(offsets, pa.array(packed.view(np.int64).ravel())),
            ],
            names=["doc_id", "n_shingles", "c1", "c2", "keys", "packed"],
        )


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of as many batches as make up ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(batch.num_columns)]
            held = []
    if held:
        yield [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(held[0].num_columns)]


def _common(key: np.ndarray, *deep: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row's label shares with the row before: 0, or DEPTH and more."""
    out = np.zeros(len(key), np.int64)
    same = np.concatenate([[False], key[1:] == key[:-1]])
    out[same] = DEPTH
    for word in deep:
        differ = np.concatenate([[0], word[1:] ^ word[:-1]]).view(np.uint64)
        equal = np.select([differ >> np.uint64(48) > 0, differ >> np.uint64(32) > 0, differ >> np.uint64(16) > 0, differ > 0], [0, 1, 2, 3], 4)
        out[same] += equal[same]
        same &= equal == 4
    return out


def _parts(common: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, part) numbers of sorted rows: parts of more than ``dense`` rows are cut at the next minimum, as long as there is one."""
    region = np.cumsum(common < DEPTH) - 1
    part = region
    for depth in range(DEPTH + 1, DEPTH + MORE + 1):
        large = np.bincount(part)[part] > dense
        if not large.any():
            break
        part = np.cumsum((common < DEPTH) | (np.concatenate([[True], part[1:] != part[:-1]])) | large & (common < depth)) - 1
    return region, part


def _regions(dense: int, chunk: int):
    """Rows sorted by (key, deep1, deep2, id) to members (key, id, top, n, cut) of regions of several documents: ``top`` is the smallest id of
    the part, ``n`` the region's size.  ``cut``: the region has several parts, or may go on in another task or chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        chunks = _gathered(batches, chunk)
        now, first = next(chunks, None), True
        while now is not None:
            after = next(chunks, None)
            cols = now if last is None else [np.concatenate([a, b]) for a, b in zip(last, now, strict=True)]  # the row before belongs to both chunks
            key, deep1, deep2, ids = cols
            region, part = _parts(_common(key, deep1, deep2), dense)
            n = np.bincount(region)[region]
            lows = np.full(part[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(lows, part, ids)
            several = np.zeros(region[-1] + 1, bool)
            several[region[1:][(part[1:] != part[:-1]) & (region[1:] == region[:-1])]] = True
            several[[region[0], region[-1]]] = True  # at the ends it may go on
            edge = np.zeros(len(ids), bool)
            edge[0] = first
            edge[-1] |= after is None
            keep = (n > 1) | edge
            yield pa.record_batch([pa.array(key[keep]), pa.array(ids[keep]), pa.array(lows[part][keep]), pa.array(n[keep]), pa.array(several[region][keep])], names=["key", "id", "top", "n", "cut"])
            last, now, first = [c[-1:] for c in cols], after, False

    return run


class _Forest:
    """Union-find of one block."""

    def __init__(self, labels: list[int]) -> None:
        first: dict[int, int] = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _block_links(roles: list[int], ids: list[int], comps: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """Links of similarity 0.75 between the block's sources (role 0) and all its rows, as a spanning forest."""
    sets = shingle_sets([encode(t) for t in texts], SHINGLE)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    forest, out = _Forest(comps), []
    for s in (i for i, r in enumerate(roles) if r == 0):
        lo, hi = np.searchsorted(flat, sets[s], "left"), np.searchsorted(flat, sets[s], "right")
        width = hi - lo
        if not width.sum():
            continue
        at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for m in np.flatnonzero(100 * common >= 75 * (sizes[s] + sizes - common)):
            if ids[m] != ids[s] and forest.join(s, int(m)):
                out.append((ids[s], ids[m]))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; a block may span batches."""
    held: list[list] = [[], [], [], []]
    block, found = None, []
    for batch in batches:
        names = batch.column(0).to_pylist()
        columns = [batch.column(k).to_pylist() for k in range(1, 5)]
        for i, name in enumerate(names):
            if name != block:
                if len(held[0]) > 1:
                    found += _block_links(*held)
                block, held = name, [[], [], [], []]
            for k in range(4):
                held[k].append(columns[k][i])
        if found:
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])
            found = []
    if len(held[0]) > 1:
        found += _block_links(*held)
    if found:
        yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


def _confirm(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows``: blk, role, id, comp.  The block's texts meet in one task; only links leave it."""
    dealt = rows.join(texts, "id").select("blk", "role", "id", "comp", "text")
    return cut(dealt.repartition("blk").sortWithinPartitions("blk", "role").mapInArrow(_links, "u long, v long"))


def _confirm_stars(star: DataFrame, texts: DataFrame) -> DataFrame:
    """The true ones of the links (top, id); a star of many links is dealt out in blocks."""
    star = cut(star.distinct())
    wide = cut(star.groupBy("top").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")))
    spread = star.join(wide, "top").select("top", "id", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int").alias("b"))
    leaf = spread.select(F.xxhash64("top", "b").alias("blk"), F.lit(1).alias("role"), "id", F.col("id").alias("comp"))
    hub = spread.select("top", "b").distinct().select(F.xxhash64("top", "b").alias("blk"), F.lit(0).alias("role"), F.col("top").alias("id"), F.col("top").alias("comp"))
    return _confirm(leaf.unionByName(hub), texts)


def _first_links(members: DataFrame) -> DataFrame:
    """(top, id): of each region in one part all of them; of regions that were cut, each document's ``BEST`` first ones (those that it
    shares most orders with) and the first one of each part with the region's."""
    apart = members.where("cut")
    ranked = apart.where("top <> id").groupBy("id", "top").agg(F.count("*").alias("n")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("top")).alias("m"))), asc=False).alias("x"))  # at most one entry per order
    best = ranked.select("id", F.explode(F.slice("x", 1, BEST)).alias("x")).select((-F.col("x.m")).alias("top"), "id")
    tops = apart.select("key", "top").distinct()
    chief = tops.groupBy("key").agg(F.min("top").alias("first"))
    between = tops.join(chief, "key").where("top <> first").select(F.col("first").alias("top"), F.col("top").alias("id"))
    return members.where("not cut and top <> id").select("top", "id").unionByName(best).unionByName(between)


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, id, comp) of the regions that hold several components among documents that have not all been compared."""
    now = members.join(comps.select("id", "component"), "id", "left").select("key", "id", "top", "n", "cut", F.coalesce("component", "id").alias("comp"))
    # a region's first document has met all others already, but not if the region was cut
    unmet = F.col("cut") | (F.col("n") > 2) & (F.col("id") != F.col("top"))
    keys = cut(now.where(unmet).groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"))
    return cut(now.join(keys, "key").select("key", "id", "comp"))


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = shingle_sets([encode(t) for t in batch.column("text").to_pylist()], SHINGLE)
        at, n = np.unique(np.concatenate(sets) % np.uint64(SLOTS), return_counts=True)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(n)], names=["at", "n"])


def _common_slots(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the most common shingles and the binary logarithms of their counts: as many whole classes as ``MOST_COMMON`` allows."""
    counted = stash(docs.mapInArrow(_slot_counts, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1").select("at", F.floor(F.log2("n")).cast("int").alias("size")), "slots")
    least, held = 64, 0
    for row in sorted(counted.groupBy("size").count().collect(), reverse=True):  # at most 63 rows
        held += row["count"]
        least = row["size"] if held <= MOST_COMMON else least
    common = counted.where(F.col("size") >= least).toArrow()
    at, size = common["at"].to_numpy(), common["size"].to_numpy()
    order = np.argsort(at)
    return at[order], size[order].astype(np.int8)


def _prefixes(at: np.ndarray, size: np.ndarray):
    def common(s: np.ndarray) -> np.ndarray:
        slot = (s % np.uint64(SLOTS)).astype(np.int32)
        if not len(at):
            return np.zeros(len(s), np.int8)
        spot = np.searchsorted(at, slot)
        spot[spot == len(at)] = 0
        return np.where(at[spot] == slot, size[spot], np.int8(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets([encode(t) for t in batch.column("text").to_pylist()], SHINGLE)
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, s in enumerate(sets):
                n = len(s)
                first = s[np.lexsort((s, common(s)))[: n + -(3 * n) // 4 + 1]]
                place = int(np.log(n) / np.log(4 / 3) + 1e-9)  # sets of similarity 0.75 are of the same or neighbouring sizes
                most = (7 * (n - np.arange(len(first)))) // 3 - n
                for near in (place, place - 1):
                    for col, x in zip(cols, (mix(first + np.uint64((near + 2) * 0x9E3779B97F4A7C15 & MASK)), np.full(len(first), i), np.full(len(first), n), most), strict=True):
                        col.append(x)
            key, owner, size, most = (np.concatenate(c) for c in cols)
            rows = pa.array(owner)
            yield pa.record_batch([pa.array(key.view(np.int64)), *(batch.column(c).take(rows) for c in ("id", "comp")), pa.array(size), pa.array(most)], names=["key", "id", "comp", "size", "most"])

    return run


def _rare_groups(left: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, id, comp): the documents that share a shingle of the prefix filter, where they are of several components; of equal groups one.

    Any order of the shingles is right; counts put the common ones last.  ``most`` is the largest set that can be linked with one whose shingle
    stands at this place: a document whose ``most`` is below the group's smallest set has no partner there.
    """
    docs = stash(left.select("id", "comp").distinct().join(texts, "id"), "undecided")
    shared = stash(docs.mapInArrow(_prefixes(*_common_slots(docs)), "key long, id long, comp long, size long, most long"), "prefixes")
    several = shared.groupBy("key").agg(F.min("size").alias("least"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key", "least")
    able = cut(shared.join(several, "key").where("most >= least").select("key", "id", "comp"))
    name = F.xxhash64("id")
    groups = able.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b"), F.bit_xor(name).alias("x"), F.sum(F.shiftright(name, 24)).alias("y"))
    once = cut(groups.where("a <> b").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))
    return cut(able.join(once, "key").select("key", "id", "comp"))


def _confirm_groups(left: DataFrame, texts: DataFrame) -> DataFrame:
    """The true links between components of each group (key, id, comp): what is outside the largest one against all, in blocks."""
    sizes = left.groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = cut(sizes.groupBy("key").agg(F.max(F.struct("c", F.negative("comp").alias("m"))).alias("x"), F.sum("c").alias("all")).select("key", F.negative("x.m").alias("main"), F.ceil((F.col("all") - F.col("x.c")) / BLOCK).cast("int").alias("ns"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nm")))
    split = left.join(main, "key")
    outer = split.where("comp <> main").select("key", F.pmod(F.xxhash64("id"), F.col("ns")).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), F.lit(0).alias("role"), "id", "comp")
    target = split.select("key", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("s"), F.pmod(F.xxhash64("id"), F.col("nm")).cast("int").alias("m"), F.lit(1).alias("role"), "id", "comp")
    return _confirm(outer.unionByName(target).select(F.xxhash64("key", "s", "m").alias("blk"), "role", "id", "comp"), texts)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links of Jaccard similarity 0.75 or more (set
    sizes in full), the row's own included.  Empty, blank and null texts have no shingles and link
    with nothing.  Rows that repeat an id are classed row by row, each by its own text.
    A row whose id is null is never linked: component_id null, kept true.  Other columns are ignored;
    an empty table gives an empty result.
    """
    src = source(docs, id_col, text_col)
    sig = stash(src.mapInArrow(_signatures, "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>, packed array<long>"), "signatures")
    real = sig.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    one = stash(real.join(classes, ["c1", "c2", "n_shingles", "doc_id"]).select(F.col("doc_id").alias("id"), "keys", "packed"), "distinct")
    labels = one.select("id", "packed", F.posexplode("keys").alias("t", "key"))
    deeper = [F.get("packed", F.pmod(F.col("t") + k, F.lit(TREES))).alias(f"deep{k}") for k in (1, 2)]  # an order goes on with the next orders' minima
    order = ["key", "deep1", "deep2", "id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = labels.select("key", *deeper, "id").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    members = stash(sorted_.mapInArrow(_regions(DENSE, CHUNK), "key long, id long, top long, n long, cut boolean"), "regions")
    texts = stash(src.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("id"), "text"), "candidate-texts")

    links = _confirm_stars(_first_links(members), texts)
    comps = cut(connected_components(links))
    left = _open(members, comps)
    if left.head(1):
        more = _confirm_groups(_rare_groups(left, texts), texts)
        if more.head(1):
            comps = connected_components(links.unionByName(more))

    named = classes.withColumnRenamed("doc_id", "rep").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("c1", "c2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one document of each group: the one with the smallest id.  Rows that repeat an id go together, and only if none of them
    is kept; rows without an id stay."""
    gone = near_duplicate_classes(docs).groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
