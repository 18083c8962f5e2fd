"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word and every word shape has a 64-bit hash, and its sparse random index vector is drawn from that hash, so no two words share one
and there is no table of them.  A word's context vector is the sum of the index vectors of its neighbours (``REACH`` to each side) over all
documents: whole numbers, summed per word by a native aggregation, so the result does not depend on the order of tasks.  Words whose
share of all words is at least ``LEAST_SHARE`` have one; there can't be more than 1 / ``LEAST_SHARE`` of them, whatever the corpus.  A rarer word, too
seldom for sums over the corpus to say more, is described where it stands: by the index vectors of its neighbours there.  A document
is the mean of its words' and of its shapes' vectors, and how alike the index vectors of words ``1`` to ``LAGS`` places apart are.  The network (tanh layer, logistic output) is trained in numpy on at most ``MAX_TRAIN``
labelled rows, a bounded sample by hash order; a temperature fitted on a fifth of them that it did not see calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.hashing import encode, mix, word_hashes
from lexiloom.llm.tables import bounded_sample, slices, source
from lexiloom.plans.stash import stash

LEAST_SHARE, DIMS, REACH, LAGS = 1e-5, 24, 2, 8
FEATURES = 2 * DIMS + LAGS
MAX_TRAIN, HIDDEN, EPOCHS, SEED = 40_000, 24, 60, 7
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 20

_SPACE = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
#: Upper case, lower case (all beyond ASCII too), digits; other ASCII stands for itself.
_SHAPE = bytes(32 if b == 32 or 9 <= b <= 13 else 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def streams(texts: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of all words and of their shapes, and the bounds of each text."""
    data = b" ".join(t.translate(_SPACE) for t in texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    words, at = word_hashes(data)
    raw = np.frombuffer(b" ".join(t.translate(_SHAPE) for t in texts), np.uint8)
    runs = raw[np.concatenate([[True], raw[1:] != raw[:-1]])] if len(raw) else raw
    shapes, _ = word_hashes(runs.tobytes())
    return (words, shapes), np.searchsorted(at, begin)


def index_vectors(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two places (different ones) and signs of each hash's index vector."""
    x = mix(h ^ np.uint64(SEED))
    one = (x % np.uint64(DIMS)).astype(np.int64)
    two = (one + 1 + (x // np.uint64(DIMS) % np.uint64(DIMS - 1)).astype(np.int64)) % DIMS
    sign = lambda bit: 1 - 2 * (x >> np.uint64(bit) & np.uint64(1)).astype(np.int64)
    return [(one, sign(62)), (two, sign(63))]


def _add_contexts(total: np.ndarray, row: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> None:
    """Add to ``total`` (flat, DIMS to a row) the index vectors of the neighbours of each word that has a ``row`` (others: -1)."""
    drawn = index_vectors(hashes)
    for step in range(1, REACH + 1):
        near = np.flatnonzero(owner[step:] == owner[:-step]) if len(owner) > step else np.empty(0, np.int64)
        for x, y in ((near, near + step), (near + step, near)):
            own = row[x] >= 0
            x, y = row[x[own]] * DIMS, y[own]
            for place, sign in drawn:
                total += np.bincount(x + place[y], weights=sign[y], minlength=len(total)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

    def told(kind: int, part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(part[0]), kind, np.int32)), pa.array(part[0].view(np.int64)), pa.array(part[1])], names=["kind", "h", "n"])

    held: list[list] = [[], []]
    for batch in slices(batches):
        both, _ = streams([encode(t) for t in batch.column(1).to_pylist()])
        for kind, hashes in enumerate(both):
            held[kind].append(np.unique(hashes, return_counts=True))
            if sum(len(p[0]) for p in held[kind]) > COUNTED:
                held[kind] = [merged(held[kind])]
                if len(held[kind][0][0]) > COUNTED // 2:
                    yield told(kind, held[kind].pop())
    for kind in range(2):
        if held[kind]:
            yield told(kind, merged(held[kind]))


def _rows_of(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return np.where(table[at] == hashes, at, -1)


def _contexts(tables: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(len(t) * DIMS, np.int64) for t in tables]
        for batch in slices(batches):
            both, bounds = streams([encode(t) for t in batch.column(1).to_pylist()])
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            for table, sums, hashes in zip(tables, total, both, strict=True):
                if len(table):
                    _add_contexts(sums, _rows_of(table, hashes), hashes, owner)
        for kind, sums in enumerate(total):
            sums = sums.reshape(-1, DIMS)
            used = np.flatnonzero(sums.any(axis=1))
            yield pa.record_batch([pa.array(np.full(len(used), kind, np.int32)), pa.array(used), *(pa.array(sums[used, d]) for d in range(DIMS))], names=["kind", "at", *(f"d{d}" for d in range(DIMS))])

    return run


def word_vectors(docs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and for shapes: the sorted hashes that have a context vector, and these (unit length, common words weighted down)."""
    src = docs.select("doc_id", "text")
    counted = stash(src.mapInArrow(_counts, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "word-counts")
    sums = {r["kind"]: r["n"] for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tables, shares = [], []
    for kind in range(2):
        often = counted.where((F.col("kind") == kind) & (F.col("n") >= LEAST_SHARE * sums.get(kind, 0))).select("h", "n").toArrow()  # at most 1 / LEAST_SHARE rows
        h, n = often["h"].to_numpy().view(np.uint64), often["n"].to_numpy()
        order = np.argsort(h)
        tables.append(h[order])
        shares.append(n[order] / max(1, sums.get(kind, 0)))
    cols = [f"d{d}" for d in range(DIMS)]
    part = src.mapInArrow(_contexts(tables), "kind int, at long, " + ", ".join(f"{c} long" for c in cols))
    summed = part.groupBy("kind", "at").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()  # as many rows as the tables
    out = []
    for kind, (table, share) in enumerate(zip(tables, shares, strict=True)):
        vectors = np.zeros((len(table), DIMS))
        own = summed["kind"].to_numpy() == kind
        vectors[summed["at"].to_numpy()[own]] = np.stack([summed[c].to_numpy()[own] for c in cols], axis=1) if len(table) else vectors
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        weight = _weight(share) if kind == 0 else np.ones(len(table))
        out.append((table, (vectors * weight[:, None]).astype(np.float32)))
    return out


def _weight(share: np.ndarray) -> np.ndarray:
    return 1e-3 / (1e-3 + share)


def _described(table: np.ndarray, vectors: np.ndarray, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A vector per word: its context vector, or of a word that has none its own neighbours' index vectors here, to unit length."""
    at = _rows_of(table, hashes)
    out = vectors[at] if len(table) else np.zeros((len(hashes), DIMS), np.float32)
    rare = np.flatnonzero(at < 0)
    if len(rare):
        own = np.full(len(hashes), -1)
        own[rare] = np.arange(len(rare))
        sums = np.zeros(len(rare) * DIMS, np.int64)
        _add_contexts(sums, own, hashes, owner)
        here = sums.reshape(-1, DIMS).astype(np.float32)
        out[rare] = here / np.maximum(np.linalg.norm(here, axis=1, keepdims=True), 1e-9)
    return out


def _alike(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Mean product of the index vectors of words that stand 1 to LAGS places apart in a text (1: equal, 0: unrelated)."""
    drawn, out = index_vectors(hashes), np.zeros((texts, LAGS))
    for lag in range(1, LAGS + 1):
        near = np.flatnonzero(owner[lag:] == owner[:-lag]) if len(owner) > lag else np.empty(0, np.int64)
        product = sum((p[near] == q[near + lag]) * s[near] * t[near + lag] for p, s in drawn for q, t in drawn) / 2 if len(near) else np.empty(0)
        pairs = np.bincount(owner[near], minlength=texts)
        out[:, lag - 1] = np.bincount(owner[near], weights=product, minlength=texts) / np.maximum(1, pairs)
    return out


def _pool(known: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=1 << 20):
            both, bounds = streams([encode(t) for t in batch.column(1).to_pylist()])
            size = np.diff(bounds)
            owner = np.repeat(np.arange(len(size)), size)
            out = np.zeros((len(size), FEATURES), np.float64)
            full = np.flatnonzero(size)
            if len(full):
                for k, ((table, vectors), hashes) in enumerate(zip(known, both, strict=True)):
                    sums = np.add.reduceat(_described(table, vectors, hashes, owner), bounds[:-1][full], axis=0, dtype=np.float64)
                    out[full, k * DIMS : (k + 1) * DIMS] = sums / size[full, None]
                out[:, 2 * DIMS :] = _alike(both[0], owner, len(size))
            flat = pa.array(out.astype(np.float32).ravel())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(np.arange(0, out.size + 1, FEATURES, dtype=np.int32), flat)], names=["doc_id", "features"])

    return run


class Network:
    """Two layers on standardised features; probability = logistic(output / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.w1 = rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0
        if len(x) < 10 or len(set(y.tolist())) < 2:  # nothing to tell apart: the base rate
            self.w2[:] = 0
            rate = (y.sum() + 1) / (len(y) + 2)
            self.b2[:] = np.log(rate / (1 - rate))
            return
        last = rng.permutation(len(x))
        tune, fit = last[: max(2, len(x) // 5)], last[max(2, len(x) // 5) :]
        self._train((x[fit] - self.mean) / self.scale, y[fit], rng)
        logit = self.logits(x[tune])
        grid = np.exp(np.linspace(-1.5, 2.0, 71))
        loss = [np.mean(np.logaddexp(0, -np.where(y[tune] == 1, 1, -1) * logit / t)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        params = [self.w1, self.b1, self.w2, self.b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                i = order[at : at + 256]
                h = np.tanh(x[i] @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))
                g = (p - y[i]) / len(i)
                back = np.outer(g, self.w2) * (1 - h * h)
                grads = [x[i].T @ back + 1e-4 * self.w1, back.sum(0), h.T @ g + 1e-4 * self.w2, np.array([g.sum()])]
                step += 1
                for k, (p_, g_) in enumerate(zip(params, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g_
                    v[k] = 0.999 * v[k] + 0.001 * g_ * g_
                    p_ -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, FEATURES).astype(np.float64)
                yield pa.record_batch([batch.column(0), pa.array(np.round(net.probability(x), 9))], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``held_out`` rows (crc32 of the id's decimal text leaves 1 when divided by 3) never train.  Null and empty texts have zero features and the
    network's score for them; texts of any length are pooled whole; rows that repeat an id are scored one by one, and all of them train if the
    id is labelled; an empty table gives an empty result.  A null id is not held out and not labelled.  Labels of null quality are left out.  Without labels of both kinds
    every score is the smoothed base rate.
    """
    src = source(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    feats = stash(src.mapInArrow(_pool(word_vectors(src)), "doc_id long, features array<float>"), "pooled")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = bounded_sample(feats.where(~held).join(marks, "doc_id"), ["doc_id"], max_train).select(F.xxhash64("doc_id").alias("h"), "doc_id", "features", "quality").toArrow()
    features = sample["features"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, FEATURES).astype(np.float64)
    order = np.lexsort((*features.T[::-1], sample["doc_id"].to_numpy(), sample["h"].to_numpy()))[:max_train]
    net = Network(features[order], sample["quality"].to_numpy()[order].astype(np.float64))
    scored = feats.mapInArrow(_score(net), "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
