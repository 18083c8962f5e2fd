"""Payload order, offsets and footer columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import bits_needed, uleb128_hex, uleb128_size
from lexiloom.operators.containment import first_occurrences
from lexiloom.plans.running import running
from lexiloom.plans.stash import dealt


def place_superwords(superwords: DataFrame) -> DataFrame:
    """Add ``base``, the byte place in the payload: superwords stand one after another, long ones first, then bytewise."""
    return running(superwords.withColumn("len", F.length("sw").cast("long")), [-F.col("len"), F.col("sw")], weight="len")


def locate(vocab: DataFrame, kept: DataFrame, superwords: DataFrame, places: DataFrame) -> DataFrame:
    """(id, b, offset, length) of every word of ``vocab``, by construction: a survivor where its path put it, a contained
    word inside its container of the smallest id; the empty word at 0.

    ``kept``: id, b of the survivors; ``superwords``: island_id, base; ``places``: id, island_id, start.
    """
    own = places.join(dealt(superwords.select("island_id", "base")), "island_id").select("id", (F.col("base") + F.col("start")).alias("offset"))
    rest = vocab.where(F.length("b") > 0).join(dealt(kept.select("id")), "id", "left_anti")
    all_ = own
    if rest.head(1):
        inside = first_occurrences(rest, kept.select(F.col("id").alias("hid"), F.col("b").alias("h")))
        all_ = own.unionByName(inside.join(dealt(own.withColumnRenamed("id", "hid")), "hid").select("id", (F.col("offset") + F.col("pos")).alias("offset")))
    return vocab.join(dealt(all_), "id", "left").select("id", "b", F.when(F.length("b") == 0, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"), F.length("b").cast("long").alias("length"))


def footer_deltas(offsets: DataFrame) -> DataFrame:
    """Unordered footer as rows: length, offset, delta to the offset before of the same length, and its ULEB128 size."""
    before = F.lag("offset", 1, 0).over(W.partitionBy("length").orderBy("offset"))
    deltas = offsets.where("length > 0").withColumn("delta", F.col("offset") - before)
    return deltas.withColumns({"delta_bytes": uleb128_size(F.col("delta")), "delta_hex": uleb128_hex(F.col("delta"))})


def ordered_lines(corpus: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each line with its word's length and offset (missing: 0), duplicates and empty lines too."""
    known = offsets.select("b", "offset")
    return corpus.join(dealt(known), "b", "left").select("line_no", "b", F.length("b").cast("long").alias("length"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def entry_bits(lines: DataFrame, payload: int) -> DataFrame:
    """Widths of an ordered footer's fields."""
    return lines.agg(F.coalesce(F.max("length"), F.lit(0)).alias("longest"), F.count("*").alias("n_lines")).select("longest", "n_lines", bits_needed(F.col("longest")).alias("length_bits"), bits_needed(F.lit(payload).cast("long")).alias("offset_bits"))
