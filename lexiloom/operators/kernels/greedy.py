"""Greedy assembly: the longest overlaps link first."""

from __future__ import annotations

import time
from collections.abc import Sequence

#: Fixed value: overlaps beyond this many bytes are not looked for.
LONGEST = 1000


def solve_greedy(words: Sequence[bytes], k: int, deadline: float | None = None) -> tuple[list[int], list[int]]:
    """(path, gains).  For each length from long to short, words without a right neighbour ask, in order, for the first
    word without a left neighbour that starts with their suffix.  A link below ``k`` bytes needs a word shorter than ``k``.

    A chain is known by its two ends: the head of the chain that ends in u tells in one look-up whether u and v already hang
    together.  At the deadline the links made so far stand; the path is always complete.
    """
    n, k = len(words), max(1, k)
    size = [len(w) for w in words]
    after: list[int] = [-1] * n
    gain = [0] * n  # bytes shared with the left neighbour
    linked = [False] * n  # has a left neighbour
    head_of = list(range(n))  # valid at chain ends: the other end
    tail_of = list(range(n))
    links = 0
    for length in range(min(max(size, default=0), LONGEST), 0, -1):
        if links == n - 1 or (deadline is not None and time.monotonic() > deadline):
            break
        waiting: dict[bytes, list[int]] = {}
        for v in range(n - 1, -1, -1):
            if not linked[v] and size[v] >= length:
                waiting.setdefault(words[v][:length], []).append(v)
        for u in range(n):
            if after[u] >= 0 or size[u] < length:
                continue
            queue = waiting.get(words[u][size[u] - length :])
            if not queue:
                continue
            for at in range(len(queue) - 1, -1, -1):
                v = queue[at]
                if v == u or head_of[u] == v or (length < k and size[u] >= k and size[v] >= k):
                    continue
                del queue[at]
                after[u], linked[v], gain[v] = v, True, length
                head, tail = head_of[u], tail_of[v]
                head_of[tail], tail_of[head] = head, tail
                links += 1
                break
    path: list[int] = []
    for i in range(n):
        if not linked[i]:
            while i >= 0:
                path.append(i)
                i = after[i]
    return path, [gain[i] for i in path]
