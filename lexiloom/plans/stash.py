"""Cutting lineage through the shared checkpoint folder.

Everything that has to outlive a stage goes to ``spark.checkpoint.dir``, the one folder that the
driver and all executors share.  Nothing is ever kept on one executor only, so a lost executor
costs a re-read and not the result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only where a session names none (tests, a laptop) is a
    folder chosen here; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            have = jdir.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        else:
            have = "file://" + tempfile.mkdtemp(prefix="lexiloom-", dir=None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(have)
    return have.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint (small, iterated tables)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: columnar, compressed,
    prunable, and safe against lost executors through the commit protocol."""
    return df.sparkSession.read.schema(df.schema).parquet(stash_path(df, name, **options))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that has as many rows as the data: never broadcast.

    Spark goes by compressed bytes, of which a million short words or ids take a few MB; as a hash table on the driver they take hundreds.
    """
    return df.hint("merge")


_RUN = uuid.uuid4().hex


def clear(spark: SparkSession) -> None:
    """Delete the tables that this driver process has stashed.  Results that still read them fail afterwards, so this is for the
    end of a job; checkpoints are left to Spark's own cleaner."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stash-{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stash_path(df: DataFrame, name: str, **options: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/stash-{_RUN}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    return path
