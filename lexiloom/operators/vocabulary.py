"""Corpora, vocabularies and exact duplicates.

A corpus has ``line_no`` (long) and ``b`` (byte string); a vocabulary has ``id`` and ``b``, where ``id`` is the line of the first
occurrence, so ids are unique and follow the order of first occurrence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_empty(df: DataFrame) -> DataFrame:
    return df.where(F.length("b") > 0)


def distinct_first(corpus: DataFrame) -> DataFrame:
    """Distinct byte strings with their first line; the empty string is a value like others, nulls are dropped.

    ``min`` is combined on the map side, so a line that fills a third of the corpus costs one row per task.
    """
    return corpus.where("b is not null").groupBy("b").agg(F.min("line_no").alias("id")).select("id", "b")
