"""Reading the input tables and numbering rows without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches to Python workers: at most so many rows and bytes, so that a stretch of very long texts stays bounded.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Ranges whose sums are broadcast; more are joined by key.
MOST_RANGES = 1_000_000


def source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of ``docs`` for a Python operator; bounds the session's Arrow batches."""
    conf = docs.sparkSession.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < rows <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows of ``df`` by the hash of ``keys`` (all of them, if there are no more): the same ones at every call.

    A threshold on the hash is set from one count, so no task keeps a list of candidates and the driver gets what it asked for.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def beside(docs: DataFrame, needed: list[str], work) -> DataFrame:
    """``work`` on ``docs`` whose other columns are put aside under names that cannot clash; they come back as they were."""
    aside = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in needed}
    done = work(docs.withColumnsRenamed(aside))
    return done.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds about ``budget`` bytes of text; whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def prefix_within(fixed: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows that come before in ``order``.

    ``fixed`` is a stored table whose rows carry the number of their range of ``order`` in ``_part``.  One sum per range reaches
    the driver; a window inside each range adds the rest, so no task sees the whole table.  ``order`` should name a key.
    """
    sums = fixed.groupBy("_part").agg(F.sum(weight).alias("w")).collect()
    ahead, base = 0, {}
    for row in sorted(sums, key=lambda r: r["_part"]):
        base[row["_part"]] = ahead
        ahead += row["w"] or 0
    spark = fixed.sparkSession
    bases = spark.createDataFrame([(k, v) for k, v in base.items()], "_part int, _base long")
    inner = W.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    run = fixed.withColumn("_run", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    few = len(base) <= MOST_RANGES
    return run.join(F.broadcast(bases) if few else bases, "_part").withColumn(out, F.col("_run") + F.col("_base")).drop("_run", "_base", "_part")
