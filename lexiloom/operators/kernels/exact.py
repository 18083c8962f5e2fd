"""Maximum-overlap Hamiltonian path by dynamic programming over subsets (numpy over masks)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from lexiloom.operators.kernels.paths import Overlaps

MOST = 18


def solve_exact(words: Sequence[bytes]) -> tuple[list[int], list[int]]:
    """(path, gains).  Every positive overlap counts.  Ties: the smallest predecessor, then the smallest end.

    Needs 2**n * n cells, so more than ``MOST`` words are refused.
    """
    n = len(words)
    if n > MOST:
        raise ValueError(f"{n} words exceed the exact solver's {MOST}")
    if n == 0:
        return [], []
    ov = Overlaps(words)
    gain = np.array([[ov(i, j) for j in range(n)] for i in range(n)], np.int64)
    best = np.full((1 << n, n), -1, np.int64)
    back = np.full((1 << n, n), -1, np.int8)
    for i in range(n):
        best[1 << i, i] = 0
    by_size: dict[int, list[int]] = {}
    for mask in range(1, 1 << n):
        by_size.setdefault(mask.bit_count(), []).append(mask)
    for size in range(2, n + 1):
        masks = np.array(by_size[size], np.int64)
        for end in range(n):
            own = masks[(masks >> end) & 1 == 1]
            before = best[own ^ (1 << end)]
            value = np.where(before >= 0, before + gain[:, end], -1)
            value[:, end] = -1
            choice = value.argmax(axis=1)  # the first of the largest
            best[own, end], back[own, end] = value[np.arange(len(own)), choice], choice
    mask, end, path = (1 << n) - 1, int(best[-1].argmax()), []
    while end >= 0:
        path.append(end)
        mask, end = mask ^ (1 << end), int(back[mask, end])
    path.reverse()
    return path, [0] + [int(gain[a, b]) for a, b in zip(path, path[1:])]
