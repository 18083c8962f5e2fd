"""Separated-text and tokenizer-vocabulary scans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import from_binary, from_text, to_binary
from lexiloom.plans.running import running
from lexiloom.plans.stash import dealt, stash
from lexiloom.sources.archive import in_blocks
from lexiloom.sources.files import writing

_BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


class ScanError(ValueError):
    """A source file breaks its format."""


def read_separated(spark: SparkSession, path: str, separator: bytes = b"\n") -> DataFrame:
    """A corpus (line_no, b) from a file of byte strings ended or divided by ``separator``.

    Carriage returns are data, empty lines are kept, one trailing empty line is not a line.  Lines are numbered in file order over
    all splits.  An empty separator is refused.
    """
    if not separator:
        raise ScanError("empty separator")
    raw = spark.read.option("lineSep", separator.decode("latin-1")).text(path) if max(separator) < 128 else None
    if raw is None:
        return _read_binary(spark, path, separator)
    rows = raw.select(
        from_binary(F.col("value").cast("binary")).alias("b"),
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("s"),
        F.monotonically_increasing_id().alias("m"),
    )
    return running(rows, [F.col("f"), F.col("s"), F.col("m")], out="line_no").select("line_no", "b")


def _read_binary(spark: SparkSession, path: str, separator: bytes) -> DataFrame:
    """Separators beyond ASCII are no text line ends: split the file's byte view instead (one file, one task)."""
    whole = spark.read.format("binaryFile").load(path).select("path", from_binary(F.col("content")).alias("h"))
    quoted = "\\Q" + separator.decode("latin-1") + "\\E"
    parts = whole.select("path", F.posexplode(F.split("h", quoted)).alias("i", "b"), F.size(F.split("h", quoted)).alias("n"))
    return running(parts.where("not (i = n - 1 and b = '')").select("path", "i", "b"), [F.col("path"), F.col("i")], out="line_no").select("line_no", "b")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_separated(spark, path, b"\n")


def corpus_of(df: DataFrame, order: str, column: str) -> DataFrame:
    """A corpus from a text column of a table, numbered by ``order`` (a long key); nulls are no lines."""
    return df.where(F.col(column).isNotNull()).select(F.col(order).cast("long").alias("line_no"), from_text(F.col(column)).alias("b"))


def _joined(key: tuple, table: pa.Table) -> pa.Table:
    data = "".join(table.sort_by("rn")["line"].to_pylist()).encode()
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def write_tokenizer(path: str, corpus: DataFrame) -> None:
    """Lines of ``base64 rank`` from a corpus (line_no, b, rank), in the order of its lines."""
    line = F.concat(F.regexp_replace(F.base64(to_binary(F.col("b"))), r"\s", ""), F.lit(" "), F.col("rank").cast("string"), F.lit("\n")).alias("line")
    rows = stash(running(corpus.select("line_no", line), [F.col("line_no")], out="rn").select("rn", "line"), "tokens")
    with writing(path) as write:
        for piece in in_blocks(rows, _joined, rows.count()):
            write(piece)


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, b, rank) from lines of ``base64 rank``; blank lines are skipped, a broken line raises with its number.

    Of a token listed twice, the last rank holds for all its lines.
    """
    raw = read_lines(spark, path).select((F.col("line_no") + 1).alias("n"), F.trim(F.regexp_replace("b", r"[\s]+$|^[\s]+", "")).alias("v")).where("v <> ''")
    part = F.split("v", " ", 2)
    rows = raw.select("n", F.get(part, F.lit(0)).alias("code"), F.get(part, F.lit(1)).alias("r"))
    ok = F.col("r").isNotNull() & F.col("code").rlike(_BASE64) & F.col("r").rlike("^[0-9]{1,10}$") & (F.expr("try_cast(r as bigint)") <= 4294967295)
    bad = rows.where(~F.coalesce(ok, F.lit(False))).orderBy("n").head(1)
    if bad:
        raise ScanError(f"line {bad[0]['n']}: expected base64 and a 32-bit rank")
    read = rows.select(F.col("n").alias("line_no"), from_binary(F.unbase64("code")).alias("b"), F.col("r").cast("long").alias("rank"))
    last = read.groupBy("b").agg(F.max_by("rank", "line_no").alias("rank"))
    return read.select("line_no", "b").join(dealt(last), "b").select("line_no", "b", "rank")
