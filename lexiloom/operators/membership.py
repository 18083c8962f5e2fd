"""Exact membership of words in an archive's entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.containment import first_occurrences
from lexiloom.plans.stash import dealt


def contains_word(entries: DataFrame, word: str) -> bool:
    """Is ``word`` (a byte view) an entry?  Equality, so a mere substring is not."""
    return bool(entries.where(F.col("b") == word).head(1))


def membership(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(b, status) of distinct query words: member, substring (inside an entry only) or absent."""
    asked = queries.select("b").distinct()
    words = entries.select("b").distinct().withColumn("hit", F.lit(True))
    known = asked.join(dealt(words), "b", "left")
    rest = known.where("hit is null").select("b").withColumn("id", F.xxhash64("b"))
    # which entry holds it does not matter here, so all of them go under few numbers
    inside = first_occurrences(rest, words.select(F.pmod(F.xxhash64("b"), F.lit(1 << 40)).alias("hid"), F.col("b").alias("h"))).select("id").distinct()
    partly = rest.join(dealt(inside), "id").select("b").distinct().withColumn("part", F.lit(True))
    return known.join(dealt(partly), "b", "left").select("b", F.when(F.col("hit"), "member").when(F.col("part"), "substring").otherwise("absent").alias("status"))
