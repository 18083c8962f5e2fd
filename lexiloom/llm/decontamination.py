"""Benchmark decontamination: n-gram seeds that no alignment can avoid, then Smith-Waterman alignment.

Seeds are all word pairs of a test item, none left out however often it leaked.  An alignment of score s with an item of n words
has at least s - n - 1 matched pairs of neighbours within 3n - s words of the document; places with so many seeds that near
each other are aligned, and no other place can reach the threshold.  Where that number is below one (items of up to five words at
0.6) single words are the seeds, of which s / 2 must match.  The score is the alignment's share of a perfect one.  Test items
are a query set against all documents, taken in blocks of about ``ITEM_WORDS`` words, so what is broadcast is bounded whatever the
table's size: each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.hashing import WORD_TABLE, corpus_words, encode, gram_hashes
from lexiloom.llm.tables import slices, source

ITEM_WORDS, MOST_HITS = 1 << 20, 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word sequences: score, and the bounds of the matched words of ``b``.

    Linear gaps.  The left-to-right dependency of a row is a running maximum, so a row is a few numpy calls.
    """
    m = len(b)
    if not len(a) or not m:
        return 0, 0, 0
    drop = GAP * np.arange(m + 1)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, lo, hi = 0, 0, 0
    places = np.arange(m + 1)
    for x in a:
        diag = row[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = row[1:] + GAP
        inner = np.maximum(np.maximum(diag, up), 0)
        start = np.where(inner == 0, places[1:], np.where(diag >= up, origin[:-1], origin[1:]))
        flat = np.concatenate([[0], inner]) - drop
        top = np.maximum.accumulate(flat)
        source = np.maximum.accumulate(np.where(flat == top, places, 0))
        row = top + drop
        origin = np.concatenate([[0], start])[source]
        at = int(row.argmax())
        if row[at] > best:
            best, lo, hi = int(row[at]), int(origin[at]), at
    return best, lo, hi


def _items(rows: list[tuple[int, str]]) -> tuple[list[int], list[np.ndarray]]:
    ids, words = [], []
    for i, text in rows:
        w, _ = corpus_words([encode(text)], WORD_TABLE)
        if len(w):
            ids.append(i)
            words.append(w)
    return ids, words


def _bounds(n: int, threshold: float) -> tuple[int, int, int]:
    """For an item of ``n`` words: seed length, seeds that every alignment of the threshold holds, and its most document words."""
    least = math.ceil(MATCH * threshold * n - 1e-9)
    span = max(1, 3 * n - least)
    return (2, least - n - 1, span) if least - n - 1 >= 1 else (1, max(1, -(-least // 2)), span)


def _seeds(words: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes with item index, sorted by hash."""
    grams = [gram_hashes(w, n) for w, n in zip(words, sizes, strict=True)]
    item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    seeds = np.concatenate(grams)
    order = np.argsort(seeds, kind="stable")
    return seeds[order], item[order]


def _places(hit: np.ndarray, seed: np.ndarray, owner: np.ndarray, first: np.ndarray, item: np.ndarray, need: np.ndarray, span: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, item, word) of every hit that begins a run of enough seeds; at most about MOST_HITS hits of whole documents at a time."""
    many = first[seed + 1] - first[seed]
    upto, begin = np.cumsum(many), 0
    while begin < len(hit):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + MOST_HITS, "right"))
        end = max(end, begin + 1)
        if end < len(hit):
            whole = int(np.searchsorted(owner, owner[end]))
            end = whole if whole > begin else int(np.searchsorted(owner, owner[end], "right"))
        n = many[begin:end]
        at = np.repeat(hit[begin:end], n)
        doc = np.repeat(owner[begin:end], n)
        it = item[np.repeat(first[seed[begin:end]], n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        pair = doc * len(need) + it
        order = np.argsort(pair, kind="stable")  # hits are in the order of the words
        at, doc, it, pair = at[order], doc[order], it[order], pair[order]
        last = np.arange(len(at)) + need[it] - 1
        inside = last < len(at)
        last[~inside] = 0
        for k in np.flatnonzero(inside & (pair[last] == pair) & (at[last] - at < span[it])):
            yield int(doc[k]), int(it[k]), int(at[k])
        begin = end


def _find(ids: list[int], words: list[np.ndarray], threshold: float):
    limits = [_bounds(len(w), threshold) for w in words]
    need, span = np.array([x[1] for x in limits]), np.array([x[2] for x in limits])
    seeds, item = _seeds(words, [x[0] for x in limits])
    table, first = np.unique(seeds, return_index=True)
    first, lengths = np.append(first, len(seeds)), sorted({x[0] for x in limits})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, found = batch.column(0).to_pylist(), []
            all_words, bounds = corpus_words([encode(t) for t in batch.column(1).to_pylist()], WORD_TABLE)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            windows: dict[tuple[int, int], list[list[int]]] = {}
            for n in lengths:
                grams = gram_hashes(all_words, n)
                at = np.searchsorted(table, grams)
                at[at == len(table)] = 0
                hit = np.flatnonzero(table[at] == grams)
                hit = hit[owner[hit] == owner[hit + n - 1]]
                for doc, it, x in _places(hit, at[hit], owner[hit], first, item, need, span):
                    a, b = max(int(bounds[doc]), x - int(span[it])), min(int(bounds[doc + 1]), x + int(span[it]))
                    have = windows.setdefault((doc, it), [])
                    if have and a <= have[-1][1]:  # hits of one item come in order
                        have[-1][1] = b
                    else:
                        have.append([a, b])
            for (doc, it), spans in windows.items():
                w, best = words[it], (0, 0, 0)
                for a, b in spans:
                    if MATCH * np.isin(w, all_words[a:b]).sum() < MATCH * threshold * len(w) - 1e-9:
                        continue  # too few of the item's words, in any order
                    score, x, y = align(w, all_words[a:b])
                    if score > best[0]:
                        best = (score, a + x - int(bounds[doc]), a + y - int(bounds[doc]))
                share = best[0] / (MATCH * len(w))
                if best[0] and share >= threshold:
                    found.append((docs[doc], ids[it], best[0], share, best[1], best[2]))
            if found:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "score", "share", "first_word", "end_word"])

    return run


_FOUND = "doc_id long, item_id long, score long, share double, first_word long, end_word long"


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (document, test item) whose alignment reaches ``threshold`` of a perfect one.

    doc_id, item_id, score, share, first_word, end_word (word places in the document).  Null, empty and wordless texts
    match nothing.  Repeated rows give repeated results, null doc_ids are reported as null.  An empty table on
    either side gives an empty result.
    """
    spark = docs.sparkSession
    src = source(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.size(F.split("text", r"[^A-Za-z0-9\x{80}-\x{10ffff}]+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // ITEM_WORDS))
    out = spark.createDataFrame([], _FOUND)
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        ids, words = _items(sorted(rows))
        if not ids:
            continue
        out = out.unionByName(src.mapInArrow(_find(ids, words, threshold), _FOUND))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no test item.  Rows that repeat a contaminated row's id go with it; rows without an id stay, as no
    finding can name them."""
    bad = contamination(docs, benchmark, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
