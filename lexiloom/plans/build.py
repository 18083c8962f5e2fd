"""The whole build: distinct, containment, islands, assembly, layout — and its archive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.assembly import Options, assemble
from lexiloom.operators.containment import survivors
from lexiloom.operators.layout import locate, ordered_lines, place_superwords
from lexiloom.operators.overlaps import islands
from lexiloom.operators.vocabulary import distinct_first
from lexiloom.plans.stash import stash
from lexiloom.sources.archive import payload_chunks, write_archive, write_metadata, write_ranks


@dataclass
class Dictionary:
    """A built dictionary: tables in the shared folder, ready to be written or joined."""

    corpus: DataFrame
    superwords: DataFrame  # island_id, sw, solver, len, base
    offsets: DataFrame  # id, b, offset, length
    ordered: bool = True
    separator: bytes = b"\n"

    def payload(self) -> Iterator[bytes]:
        return payload_chunks(self.superwords)

    def payload_bytes(self) -> int:
        return self.superwords.agg(F.sum("len").alias("n")).first()["n"] or 0

    def lines(self) -> DataFrame:
        return ordered_lines(self.corpus, self.offsets)

    def write(self, path: str, metadata: str | None = None) -> int:
        """Write the archive; with ranks in the corpus also its sidecars.  Returns the archive's size in bytes."""
        if self.ordered:
            return write_archive(path, self.payload(), self.payload_bytes(), self.separator, lines=stash(self.lines(), "lines"))
        size = write_archive(path, self.payload(), self.payload_bytes(), self.separator, offsets=self.offsets)
        if "rank" in self.corpus.columns:
            write_ranks(path, self.offsets, self.corpus)
            if metadata:
                write_metadata(path, metadata)
        return size

    def compression(self) -> float:
        """Payload bytes over the bytes of all lines (an empty corpus: 1)."""
        raw = self.corpus.agg(F.sum(F.length("b")).alias("n")).first()["n"]
        return self.payload_bytes() / raw if raw else 1.0


def build_dictionary(corpus: DataFrame, options: Options | None = None, ordered: bool = True, separator: bytes = b"\n") -> Dictionary:
    """Build from a corpus (line_no, b[, rank]).  A corpus with ranks is a tokenizer vocabulary and always unordered.

    Each stage shrinks what the next one gets: distinct lines, then words inside no other, then islands.
    """
    options = options or Options()
    corpus = stash(corpus, "corpus")
    vocab = stash(distinct_first(corpus), "vocabulary")
    kept = stash(survivors(vocab), "survivors")
    members = stash(islands(kept, options.min_overlap, options.one_task_links), "islands")
    tops, places = assemble(kept, members, options)
    placed = stash(place_superwords(tops), "superwords")
    offsets = stash(locate(vocab, kept, placed, places), "offsets")
    return Dictionary(corpus, placed, offsets, ordered and "rank" not in corpus.columns, separator)
