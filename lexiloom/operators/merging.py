"""Appending an update to an archive without rebuilding it.

Differences that are on purpose: eliminated words keep the order of the update, so a merge gives the same bytes every time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.assembly import Options
from lexiloom.operators.containment import first_occurrences
from lexiloom.operators.kernels.paths import overlap
from lexiloom.plans.build import Dictionary, build_dictionary
from lexiloom.plans.stash import dealt, stash
from lexiloom.sources.archive import payload_table, read_archive, read_header, write_archive
from lexiloom.sources.codecs import HEADER_BYTES
from lexiloom.sources.files import read_range

#: The options of a merge's inner build.
MERGE = Options(min_overlap=3, dp_limit=15)


def split_update(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add ``offset`` to the update's words (line_no, b): the first place in the primary payload, null for survivors.

    Any place counts, also across the borders of primary words.  The empty word is at 0.  Repeats keep their rows.
    """
    distinct = words.groupBy("b").agg(F.min("line_no").alias("id"))
    hits = first_occurrences(distinct, chunks).select("id", (F.col("hid") + F.col("pos")).alias("offset"))
    found = distinct.join(dealt(hits), "id", "left").select("b", F.when(F.length("b") == 0, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"))
    return words.join(dealt(found), "b", "left")


@dataclass
class Merge:
    primary: str
    payload: int  # bytes of the primary's payload
    inner: Dictionary  # of the update's survivors
    shared: int
    lines: DataFrame  # line_no, b, length, offset: primary, eliminated, survivors
    ordered: bool
    separator: bytes

    def fragments(self) -> Iterator[bytes]:
        """What comes after the primary payload, superword by superword."""
        skip = self.shared
        for chunk in self.inner.payload():
            yield chunk[skip:]
            skip = max(0, skip - len(chunk))

    def _payload(self) -> Iterator[bytes]:
        yield from read_range(self.primary, HEADER_BYTES, HEADER_BYTES + self.payload)
        yield from self.fragments()

    def write(self, path: str) -> int:
        chunks, size = self._payload(), self.payload + self.inner.payload_bytes() - self.shared
        if self.ordered:
            return write_archive(path, chunks, size, self.separator, lines=self.lines)
        words = self.lines.where("length > 0").groupBy("b").agg(F.first("length").alias("length"), F.min_by("offset", "line_no").alias("offset"))
        return write_archive(path, chunks, size, self.separator, offsets=words)


def merge_archives(spark: SparkSession, primary: str, update: str) -> Merge:
    """Merge two archives.  Ordered only if both are; the separator is the primary's; sidecars are not merged.

    The search in the primary payload runs over chunks of it in a join; the driver copies it in pieces and holds none of it.  The appended part
    begins with a survivor, which stands nowhere in the payload, so the two share less than the longest word and only so much is compared.
    """
    head, other = read_header(primary), read_header(update)
    payload = head.footer - HEADER_BYTES
    first = stash(read_archive(spark, primary).select("ordinal", "b", "offset", "length"), "primary")
    news = stash(read_archive(spark, update).where("length > 0").select(F.col("ordinal").alias("line_no"), "b"), "update")
    longest = news.agg(F.max(F.length("b")).alias("n")).first()["n"] or 0
    parted = stash(split_update(news, payload_table(spark, primary, longest)), "parted")
    inner = build_dictionary(parted.where("offset is null").select("line_no", "b"), MERGE)
    ahead = next(inner.payload(), b"")[:longest]
    tail = b"".join(read_range(primary, HEADER_BYTES + max(0, payload - longest), HEADER_BYTES + payload))
    shared = overlap(tail, ahead)
    shift = payload - shared
    gone = parted.where("offset is not null").groupBy("b").agg(F.min("line_no").alias("line_no"), F.first("offset").alias("offset"))
    new = parted.where("offset is null").select("line_no", "b").join(dealt(inner.offsets.select("b", F.col("offset").alias("o"))), "b").select("line_no", "b", (F.col("o") + shift).alias("offset"))
    ranked = (
        first.select(F.lit(0).alias("src"), F.col("ordinal").alias("at"), "b", "offset")
        .unionByName(gone.select(F.lit(1).alias("src"), F.col("line_no").alias("at"), "b", "offset"))
        .unionByName(new.select(F.lit(2).alias("src"), F.col("line_no").alias("at"), "b", "offset"))
    )
    best = ranked.groupBy("b").agg(F.min_by("offset", F.struct("src", "at")).alias("offset"))
    order = (F.col("src").cast("long") * (1 << 55) + F.col("at")).alias("line_no")
    lines = ranked.select(order, "b").join(dealt(best), "b").select("line_no", "b", F.length("b").cast("long").alias("length"), "offset")
    return Merge(primary, payload, inner, shared, stash(lines, "merged"), head.ordered and other.ordered, head.separator)
