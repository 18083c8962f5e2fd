"""Vectorised word and shingle hashes over whole texts (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_CHUNK = 1 << 20

#: A-Z to a-z; space, tab, LF, VT, FF and CR to space.
SPACE_TABLE = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; every other ASCII byte that is no digit or letter to space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def encode(text: str | None) -> bytes:
    """UTF-8 of a text; a null is empty, a lone surrogate is kept as its three bytes."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1024, 2 * len(_powers))
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE, np.uint64))])
    return _powers


def _chunk_words(arr: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    is_word = arr != 32
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts = edge[is_word[edge]]
    if len(is_word) and is_word[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = edge[~is_word[edge]]
    if is_word[-1]:
        ends = np.append(ends, len(arr))
    lengths = ends - starts
    at = np.flatnonzero(is_word)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = (arr[at].astype(np.uint64) + np.uint64(1)) * _power_table(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, np.cumsum(lengths) - lengths)), starts + base


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of the words of ``data``, in which all separators are spaces.

    Works through pieces of about a megabyte that end at a space, so memory follows the piece.
    """
    arr = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(arr):
        end = min(len(arr), at + _CHUNK)
        if end < len(arr):
            cut = data.find(b" ", end)
            end = len(arr) if cut < 0 else cut
        h, s = _chunk_words(arr[at:end], at)
        hashes.append(h)
        starts.append(s)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def corpus_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts and the bounds of each text's words (``len(texts) + 1``)."""
    data = b" ".join(t.translate(table) for t in texts)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, starts = word_hashes(data)
    return hashes, np.searchsorted(starts, begin)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (shorter input: nothing)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    m = len(words) - n + 1
    acc, q = np.zeros(m, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc += words[k : k + m] * q
            q = np.uint64((int(q) * int(_STEP)) & MASK)
    return mix(acc)


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingles of each text; a shorter text is one shingle, an empty one none."""
    words, bounds = corpus_words(texts, SPACE_TABLE)
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            h = np.sort(grams[a : b - n + 1])
            if len(h) > 1:
                h = h[np.concatenate([[True], h[1:] != h[:-1]])]
            out.append(h)
        elif b > a:
            h = gram_hashes(words[a:b], int(b - a))
            out.append(mix(h + np.uint64(int(b - a))))
        else:
            out.append(np.empty(0, np.uint64))
    return out
