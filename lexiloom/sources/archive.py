"""Archive scan and archive, rank and metadata sinks.

The archive is one raw file, which no Spark writer makes: bit fields and delta codes are encoded in blocks on the executors and the driver
only strings the blocks together, one at a time, on a local path or through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import to_binary
from lexiloom.operators.layout import entry_bits
from lexiloom.plans.running import running
from lexiloom.plans.stash import dealt, stash
from lexiloom.sources.codecs import ArchiveError, Header, bits_needed, decode_footer, decode_ranks, encode_ranks, pack_columns, split_archive, uleb_column, uleb_encode
from lexiloom.sources.files import local, read_bytes, writing

BLOCK, CHUNK = 1 << 16, 1 << 12
#: Encoded blocks and bytes of payload that the driver takes at once, and bytes of a payload piece.
AT_ONCE, SPAN, STRETCH = 32, 16 << 20, 1 << 20

ENTRIES = "file string, version int, separator binary, is_ordered boolean, ordinal long, b string, offset long, length long"


def _open(path: str, data: bytes) -> tuple[Header, str, np.ndarray, np.ndarray]:
    try:
        head, payload, footer = split_archive(data)
        return head, payload.decode("latin-1"), *decode_footer(footer, head.ordered, len(payload))
    except ArchiveError as e:
        raise ArchiveError(f"{path}: {e}") from None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's entries in blocks; beside the file only two integers an entry are held."""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            head, text, lengths, offsets = _open(path, data.as_py())
            for at in range(0, len(lengths), BLOCK):
                sizes, places = lengths[at : at + BLOCK], offsets[at : at + BLOCK]
                n = len(sizes)
                yield pa.record_batch(
                    {
                        "file": pa.array([path] * n, pa.string()),
                        "version": pa.array([head.version] * n, pa.int32()),
                        "separator": pa.array([head.separator] * n, pa.binary()),
                        "is_ordered": pa.array([head.ordered] * n, pa.bool_()),
                        "ordinal": pa.array(np.arange(at, at + n), pa.int64()),
                        "b": pa.array([text[o : o + k] for o, k in zip(places.tolist(), sizes.tolist(), strict=True)], pa.string()),
                        "offset": pa.array(places, pa.int64()),
                        "length": pa.array(sizes, pa.int64()),
                    }
                )


def _chunks(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                _, payload, _ = split_archive(data.as_py())
                places = range(0, len(payload), CHUNK)
                for at in range(0, len(places), 1024):
                    part = places[at : at + 1024]
                    texts = [payload[x : x + CHUNK + max(0, longest - 1)].decode("latin-1") for x in part]
                    yield pa.record_batch({"hid": pa.array(part, pa.int64()), "h": pa.array(texts, pa.string())})

    return run


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Entries of one or many archives (a file is decoded by one task): lines in order, or words by offset."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_entries, ENTRIES)


def payload_table(spark: SparkSession, path: str, longest: int) -> DataFrame:
    """(hid, h): an archive's payload in chunks that overlap by ``longest`` - 1 bytes; ``hid`` is the chunk's place.

    One task reads the file and the chunks are dealt to all of them; the driver sees none of it.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_chunks(longest), "hid long, h string").repartition("hid")


def read_header(path: str) -> Header:
    return Header.decode(read_bytes(path, 12))


def read_payload(path: str) -> tuple[Header, bytes]:
    head, payload, _ = split_archive(read_bytes(path))
    return head, payload


def _pack(widths: list[int]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = table.sort_by("rn")
        data = pack_columns([order["length"].to_numpy(), order["offset"].to_numpy()], widths)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    return run


def _deltas(key: tuple, table: pa.Table) -> pa.Table:
    """A block of (rn, length, offset, count of that length, and length and offset of the row before the block)."""
    order = table.sort_by("rn")
    sizes, places, counts = (order[c].to_numpy() for c in ("length", "offset", "count"))
    before, at = (np.concatenate([[order[c][0].as_py() or 0], x[:-1]]) for c, x in (("last_length", sizes), ("last_offset", places)))
    first = np.flatnonzero(sizes != before)
    codes = np.insert(places - np.where(sizes == before, at, 0), np.repeat(first, 2), np.column_stack([sizes[first], counts[first]]).ravel())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([uleb_column(codes)], pa.binary())})


def _rank_bytes(key: tuple, table: pa.Table) -> pa.Table:
    data = encode_ranks(table.sort_by([("rn", "ascending"), ("rank", "ascending")])["rank"].to_pylist())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def in_blocks(rows: DataFrame, encode, n: int) -> Iterator[bytes]:
    """``rows``, numbered by ``rn`` from 0 up to ``n``, encoded in blocks on the executors; the driver takes ``AT_ONCE`` blocks at a time."""
    blocks = rows.withColumn("block", F.floor(F.col("rn") / BLOCK)).groupBy("block").applyInArrow(encode, "block long, data binary")
    parts = max(1, -(-n // (BLOCK * AT_ONCE)))
    for row in blocks.repartitionById(parts, F.floor(F.col("block") / AT_ONCE).cast("int")).sortWithinPartitions("block").select("data").toLocalIterator():
        yield bytes(row["data"])


def _ordered_blocks(lines: DataFrame, payload: int) -> Iterator[bytes]:
    shape = entry_bits(lines, payload).first()
    yield uleb_encode(shape["longest"]) + uleb_encode(shape["n_lines"])
    widths = [bits_needed(shape["longest"]), bits_needed(payload)]
    numbered = running(lines.select("line_no", "length", "offset"), [F.col("line_no")], out="rn")
    yield from in_blocks(numbered, _pack(widths), shape["n_lines"])


def footer_order(offsets: DataFrame) -> DataFrame:
    """Words in footer order: by length, then by offset; ``rn`` numbers them."""
    return running(offsets.where("length > 0"), [F.col("length"), F.col("offset")], out="rn")


def _unordered_blocks(offsets: DataFrame) -> Iterator[bytes]:
    rows = stash(footer_order(offsets.select("length", "offset")), "footer")
    block = F.floor(F.col("rn") / BLOCK)
    counts = rows.groupBy("length").agg(F.count("*").alias("count"))
    tails = rows.groupBy((block + 1).alias("block")).agg(F.max(F.struct("length", "offset")).alias("x")).select("block", F.col("x.length").alias("last_length"), F.col("x.offset").alias("last_offset"))
    # a row for each length, and one for each block
    headed = rows.withColumn("block", block).join(F.broadcast(counts), "length").join(F.broadcast(tails), "block", "left").drop("block")
    yield from in_blocks(headed, _deltas, rows.count())


def write_archive(path: str, payload: Iterator[bytes], payload_bytes: int, separator: bytes, lines: DataFrame | None = None, offsets: DataFrame | None = None) -> int:
    """Write header, payload and footer: ordered from ``lines`` (line_no, length, offset), else unordered from ``offsets``.  Returns the file's size.

    ``payload_bytes`` has to be the payload's length, as the header comes first and no file system is asked to go back.
    """
    at = 12 + payload_bytes
    size = 0
    with writing(path) as write:
        write(Header(separator, lines is not None, at).encode())
        for chunk in payload:
            write(chunk)
            size += len(chunk)
        if size != payload_bytes:
            raise ArchiveError(f"payload of {size} bytes, {payload_bytes} expected")
        for chunk in _ordered_blocks(lines, payload_bytes) if lines is not None else _unordered_blocks(offsets) if offsets is not None else ():
            write(chunk)
            size += len(chunk)
    return 12 + size


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = bytearray()
    for batch in batches:
        for data in batch.column(0).to_pylist():
            held += data
            if len(held) >= STRETCH:
                yield pa.record_batch({"data": pa.array([bytes(held)], pa.binary())})
                held.clear()
    yield pa.record_batch({"data": pa.array([bytes(held)] if held else [], pa.binary())})


def payload_chunks(superwords: DataFrame) -> Iterator[bytes]:
    """The payload in order: superwords are strung together on the executors, and the driver takes those that begin in the same ``SPAN`` bytes at a time."""
    last = superwords.agg(F.max("base").alias("n")).first()["n"]
    if last is None:
        return
    spans = superwords.select("base", F.length("sw").alias("n"), to_binary(F.col("sw")).alias("data")).repartitionById(last // SPAN + 1, F.floor(F.col("base") / SPAN).cast("int"))
    for row in spans.sortWithinPartitions("base", "n").select("data").mapInArrow(_stretches, "data binary").toLocalIterator():
        yield bytes(row["data"])


def sidecar_path(path: str, extension: str) -> str:
    return os.path.splitext(path)[0] + extension


def _write_private(path: str, data: Iterable[bytes]) -> None:
    here = local(path)
    with writing(path) as write:
        if here is not None:
            os.chmod(f"{here}.part", 0o600)
        for piece in data:
            write(piece)


def write_ranks(path: str, offsets: DataFrame, ranks: DataFrame) -> str:
    """``.rank`` sidecar beside the archive: ranks in footer order; a word without a rank is an error."""
    numbered = footer_order(offsets.select("b", "length", "offset"))
    joined = stash(numbered.join(dealt(ranks.select("b", "rank").distinct()), "b", "left").select("rn", "b", "rank"), "ranks")
    missing = joined.where("rank is null").head(1)
    if missing:
        raise ArchiveError(f"no rank for {missing[0]['b']!r}")
    out = sidecar_path(path, ".rank")
    _write_private(out, in_blocks(joined.select("rn", "rank"), _rank_bytes, joined.count()))
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            ranks = np.array(decode_ranks(data.as_py()), np.int64)
            for at in range(0, len(ranks), BLOCK):
                part = ranks[at : at + BLOCK]
                yield pa.record_batch({"place": pa.array(np.arange(at, at + len(part)), pa.int64()), "rank": pa.array(part, pa.int64())})


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(place, rank): a ``.rank`` sidecar, decoded by one task in blocks."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_places, "place long, rank long")


def write_metadata(path: str, source: str) -> str:
    """``.json`` sidecar: a byte copy of ``source``."""
    out = sidecar_path(path, ".json")
    _write_private(out, [read_bytes(source)])
    return out


def write_result(path: str, text: str) -> None:
    _write_private(path, [text.encode()])


def archive_size(lengths: np.ndarray, offsets: np.ndarray, payload: int) -> int:
    """Bytes of an ordered archive of these lines."""
    bits = len(lengths) * (bits_needed(int(lengths.max()) if len(lengths) else 0) + bits_needed(payload))
    return 12 + payload + len(uleb_encode(int(lengths.max()) if len(lengths) else 0)) + len(uleb_encode(len(lengths))) + -(-bits // 8)


def encoding_metadata(pattern: str, special_tokens: dict[str, int]) -> str:
    """The JSON that goes beside a tokenizer's archive: its split pattern and special tokens (by id)."""
    return json.dumps({"pat_str": pattern, "special_tokens": dict(sorted(special_tokens.items(), key=lambda x: x[1]))}, ensure_ascii=False, indent=2) + "\n"


#: Split patterns and special tokens of the public encodings.
_R50K = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+$|\s+(?!\S)|\s"
_CL100K = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_O200K = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
ENCODINGS = {
    "synthetic": (r"\w+|\S", {"synthetic_end": 100}),
    "cl100k_base": (_CL100K, {"endoftext": 100257, "fim_prefix": 100258, "fim_middle": 100259, "fim_suffix": 100260, "endofprompt": 100276}),
    "o200k_base": (_O200K, {"endoftext": 199999, "endofprompt": 200018}),
    "p50k_base": (_R50K, {"endoftext": 50256}),
    "p50k_edit": (_R50K, {"endoftext": 50256, "fim_prefix": 50281, "fim_middle": 50282, "fim_suffix": 50283}),
    "r50k_base": (_R50K, {"endoftext": 50256}),
}


def write_encodings(folder: str) -> list[str]:
    """One metadata file for each known encoding: its split pattern and its special tokens."""
    paths = []
    for name, (pattern, special) in ENCODINGS.items():
        paths.append(f"{folder}/{name}.json")
        with writing(paths[-1]) as write:
            write(encoding_metadata(pattern, {f"<|{k}|>": v for k, v in special.items()}).encode())
    return paths
