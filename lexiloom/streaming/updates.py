"""Word lists that arrive as a stream.  An extension: the engine itself is a batch engine.

Each micro-batch adds the words that are not known yet as one folder of a growing table; a repeated batch overwrites its own
folder, so a restart after a lost driver adds nothing twice.  The table's folders are updates for a later merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexiloom.functions.bytesview import from_binary

KNOWN = StructType([StructField("b", StringType()), StructField("batch", LongType())])


def known_words(spark: SparkSession, table: str) -> DataFrame:
    """(b, batch) of all words so far."""
    return spark.read.schema(KNOWN).option("basePath", table).option("recursiveFileLookup", "true").parquet(table)


def stream_words(spark: SparkSession, source: str, table: str, checkpoint: str, separator: str = "\n", once: bool = True) -> StreamingQuery:
    """Start adding the new byte strings of the text files that appear in ``source`` to ``table``.

    ``once``: take what is there and stop, else run until stopped.  Empty lines are no words.
    """
    lines = spark.readStream.option("lineSep", separator).text(source).select(from_binary(F.col("value").cast("binary")).alias("b")).where(F.length("b") > 0)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.select("b").distinct()
        # earlier batches only, so that a repeated batch sees what its first run saw
        if number:
            before = known_words(session, table).where(F.col("batch") < number)
            fresh = fresh.join(before.select("b"), "b", "left_anti")
        fresh.select("b", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{table}/update-{number:09d}")

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
