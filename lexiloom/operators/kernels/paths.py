"""Overlaps and superstrings of a given path."""

from __future__ import annotations

from collections.abc import Sequence


def borders(pattern: bytes) -> list[int]:
    """Length of the longest proper border of each prefix."""
    out = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = out[i - 1]
        while k and pattern[i] != pattern[k]:
            k = out[k - 1]
        out[i] = k + (pattern[i] == pattern[k])
    return out


def overlap(left: bytes, right: bytes) -> int:
    """Longest suffix of ``left`` that is a prefix of ``right`` (all of either allowed)."""
    at = max(0, len(left) - len(right))
    while at < len(left):
        if right.startswith(left[at:]):
            return len(left) - at
        at = left.find(right[:1], at + 1)
        if at < 0:
            return 0
    return 0


class Overlaps:
    """Memo of pairwise overlaps of one island."""

    def __init__(self, words: Sequence[bytes]) -> None:
        self.words, self.known = words, {}

    def __call__(self, i: int, j: int) -> int:
        got = self.known.get((i, j))
        if got is None:
            got = self.known[i, j] = overlap(self.words[i], self.words[j]) if i != j else 0
        return got

    def total(self, path: Sequence[int]) -> int:
        return sum(self(a, b) for a, b in zip(path, path[1:]))


def join_path(words: Sequence[bytes], path: Sequence[int], gains: Sequence[int]) -> tuple[bytes, list[int]]:
    """The superstring along ``path`` (``gains[k]`` bytes shared with the word before) and each word's offset in it."""
    text, starts = bytearray(), []
    for i, gain in zip(path, gains, strict=True):
        starts.append(len(text) - gain)
        text += words[i][gain:]
    return bytes(text), starts
