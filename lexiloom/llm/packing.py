"""Packing by power-of-two decomposition.

A document of n ids is cut into pieces whose lengths are powers of two: full pieces of ``LENGTH`` first, then
the binary digits of the rest, longest first.  Each piece is a sequence of its own, so no sequence crosses
documents and none is padded; equal lengths form a bucket, and sequence ids count bucket by bucket, long
ones first, within a bucket in the order of reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.tables import slices, source
from lexiloom.llm.tokens import encoder
from lexiloom.plans.stash import cut, stash

LENGTH, MOST_STARTS = 2048, 1_000_000


def pieces(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of ``n`` ids; ``length`` is a power of two."""
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 2, -1, -1) if n % length >> b & 1]


def _cut(path: str, end_id: int, length: int):
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context = encoder(path), TaskContext.get()
        part, placed = context.partitionId() if context else 0, {}
        for batch in slices(batches, budget=2 << 20):
            cols: list[list] = [[], [], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += tail
                n, start = len(ids) // 4, 0
                for size in pieces(n, length):
                    piece = ids[4 * start : 4 * (start + size)]
                    rank = placed[size] = placed.get(size, -1) + 1
                    for col, value in zip(cols, (doc, start, size, zlib.crc32(piece), n, rank, piece), strict=True):
                        col.append(value)
                    start += size
            count = len(cols[0])
            yield pa.record_batch(
                [*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(np.full(count, part, np.int64)), pa.array(cols[6], pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part", "ids"],
            )

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, part long, ids binary"


def decompose(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, its task and its rank there among pieces of its length, ids
    (little-endian 32 bit).

    Null and empty texts are one piece of the end id.  Null and repeated ids keep their rows.
    """
    return source(docs).mapInArrow(_cut(tokenizer, end_id, length), _PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset (0: a sequence is one piece); ids on request.

    Null and empty texts are one piece of the end id; texts of any length are cut whole; null and repeated ids keep their rows; other
    columns are ignored; an empty table gives an empty result.

    Numbering shuffles no piece: each task ranks its pieces within each bucket, the pieces are stored, and the stored tasks' counts,
    summed up in order of bucket and task, give every (bucket, task) its first number.  That table is broadcast if it has at most
    ``MOST_STARTS`` rows, else joined by its key.
    """
    rows = decompose(docs, tokenizer, end_id, length)
    stored = stash(rows if with_ids else rows.drop("ids"), "pieces")
    counts = cut(stored.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")))
    ahead = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    longer, before = 0, []
    for row in sorted(totals.collect(), key=lambda r: -r["length"]):  # one row per power of two
        before += [F.lit(row["length"]), F.lit(longer)]
        longer += row["total"]
    shift = F.create_map(*before)[F.col("length")] if before else F.lit(0)
    starts = counts.select("length", "part", (shift + F.coalesce(F.sum("n").over(ahead), F.lit(0))).cast("long").alias("first"))
    numbered = stored.join(F.broadcast(starts) if counts.count() <= MOST_STARTS else starts, ["length", "part"])
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    return numbered.select(*keep, *(["ids"] if with_ids else []))
