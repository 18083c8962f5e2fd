"""Token ids by the ``tokenizers`` library, and their columnar files.

The file format is Parquet: one row per document with ``doc_id``, its token count, checksum and the
ids as a list column.  Ids are delta/bit packed (Parquet V2 pages, no dictionary for ids); row groups and pages are
small and of set size and carry a page index, so a reader of a few documents or of the metadata alone
fetches a few pages.  Documents stand in ascending ``doc_id`` order.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.tables import prefix_within, slices, source
from lexiloom.plans.stash import stash, stash_path

#: Letters, numbers and white space below U+0250, the same in every Unicode version in use, and with
#: them the public byte-level BPE split pattern.  Texts with other characters go through the tokenizer's own splitter as a whole.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_CACHE_ENTRIES = 500_000

PARQUET = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "snappy",
}


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, with a memory of pieces.

    A byte-level BPE encodes each piece of its split pattern on its own, so each distinct piece of a batch is given to
    the tokenizer's model once and its ids are kept (a tokenizer of another kind gets whole texts).  Texts that hold the content of an
    added token, such as an end-of-text mark, go through the tokenizer as a whole too, which decides what becomes of it.  New pieces
    are remembered as young, those met again in a later batch as settled; settled ones that have become too many are young again, and too many
    young ones are forgotten, which costs time and changes no result.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = _byte_alphabet()
        self.settled: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.split = re.compile(SPLIT).findall
        splitter = self.tokenizer.pre_tokenizer
        known = isinstance(splitter, ByteLevel) and not splitter.add_prefix_space and splitter.use_regex and self.tokenizer.normalizer is None
        beyond = re.compile("[^\x00-\u024f]" if known else "(?s).").search
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = lambda text: beyond(text) or any(a in text for a in added)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of single pieces, by the tokenizer's model: a piece has nothing left to split."""
        run, table = self.tokenizer.model.tokenize, self.alphabet
        return {p: array("I", [t.id for t in run(p.encode().decode("latin-1").translate(table))]).tobytes() for p in new}

    def _look_up(self, parts: list[str]) -> list[bytes]:
        found = list(map(self.settled.get, parts))
        if None in found:
            if len(self.settled) > _CACHE_ENTRIES:
                self.settled, self.young = {}, self.settled
            holes = [i for i, f in enumerate(found) if f is None]
            lost = {parts[i] for i in holes}
            own = {p: v for p in lost if (v := self.young.pop(p, None)) is not None}
            self.settled.update(own)
            fresh = self._pieces([p for p in lost if p not in own])
            if len(self.young) + len(fresh) > _CACHE_ENTRIES:
                self.young.clear()
            self.young.update(fresh)
            own.update(fresh)
            for i in holes:
                found[i] = own[parts[i]]
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        parts: list[str] = []
        ends: list[int] = []
        odd: list[int] = []
        for i, text in enumerate(texts):
            if text and self.odd(text):
                odd.append(i)
            elif text:
                parts += self.split(text)
            ends.append(len(parts))
        found, out, at = self._look_up(parts), [], 0
        for end in ends:
            out.append(b"".join(found[at:end]))
            at = end
        for i in odd:
            out[i] = self._whole([texts[i]])[0]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenize(path: str, end_id: int):
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), 0
        for batch in slices(batches, budget=2 << 20):
            ids = [x + tail for x in enc.encode_all(batch.column(1).to_pylist())]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32))
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(np.arange(row, row + len(ids)))],
                names=["doc_id", "n_tokens", "ids_crc32", "ids", "_row"],
            )
            row += len(ids)

    return run


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, ids, and the row's place in its task, of every row (null and empty texts: the end id alone)."""
    src = source(docs)
    return src.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, n_tokens long, ids_crc32 long, ids array<int>, _row long")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, name: str = "tokens", path: str | None = None) -> str:
    """Write the token files in ascending doc_id order (null ids first, repeated ids side by side, by text); returns their folder.

    Null and empty texts are the end id alone, texts of any length are encoded whole, other columns are ignored, and an empty table
    gives a folder that reads as empty.  Ranges of ids are cut over the raw rows, before the costly encoding, and each range is sorted by its task.
    Spark's committer writes the files, so a repeated task leaves no double rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = source(docs)
    ranged = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = token_table(ranged, tokenizer, end_id).withColumn("_part", F.spark_partition_id())
    if path is None:
        return stash_path(rows, name, **PARQUET)
    writer = rows.write.mode("errorifexists")
    for k, v in PARQUET.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, ids_crc32 long, ids array<int>, _row long, _part int").parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32: the column chunks of the ids are not touched."""
    return read_tokens(spark, path).select("doc_id", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The rows of ``low <= doc_id <= high``: as files are in order of doc_id, their statistics and page indexes leave few pages to read."""
    return read_tokens(spark, path).where(F.col("doc_id").between(low, high)).drop("_part", "_row")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths and checksums from the ids that were read, one list at a time."""
    for batch in batches:
        lists = batch.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4").view("<u4")
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)] if len(ends) else []
        yield pa.record_batch([*batch.columns[:3], pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "_part", "_row", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a token folder, from the ids in its files.

    ``start`` counts the ids of all rows before it in the files, also among rows that repeat an id: a sum per written range, then a
    running sum by the row's place inside each range.  The running sum reads lengths only, not ids.
    """
    read = read_tokens(spark, path)
    out = read.select("doc_id", "_part", "_row", "ids").mapInArrow(_checksums, "doc_id long, _part int, _row long, n_tokens long, ids_crc32 long")
    return prefix_within(stash(out, "token-digest"), ["_row"], "n_tokens", "start").select("doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "ids_crc32")
