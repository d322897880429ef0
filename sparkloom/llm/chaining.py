"""Collinear chaining of seed matches through a Fenwick tree."""

from __future__ import annotations

import numpy as np


class MaxTree:
    """Fenwick tree for the best (score, index) over a prefix of ranks."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def update(self, rank: int, value: tuple[float, int]) -> None:
        i = rank + 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def query(self, rank: int) -> tuple[float, int]:
        """Best over ranks below rank."""
        out = (float("-inf"), -1)
        while rank > 0:
            if self.best[rank] > out:
                out = self.best[rank]
            rank -= rank & -rank
        return out


def chains(a: np.ndarray, b: np.ndarray, k: int, gap: float = 0.2, least: float = 0.0) -> list[tuple[float, list[int]]]:
    """Disjoint chains of anchors (a[i], b[i]) of length k, best first.

    A chain visits anchors in the order of both texts. An anchor scores k, less
    what it overlaps with the one before it on the left text; moving on costs
    ``gap`` times the codes skipped in both texts. With the gap cost linear in
    both coordinates, score + gap * (a + b) of the predecessors is all a query
    needs, so the best predecessor is a prefix maximum over the rank of b.
    """
    if not len(a):
        return []
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    ranks = np.searchsorted(np.unique(b), b)
    tree = MaxTree(int(ranks.max()) + 1)
    score, parent = [0.0] * len(a), [-1] * len(a)
    i = 0
    while i < len(a):
        same = i
        while same < len(a) and a[same] == a[i]:  # anchors at one place of the left text can't follow each other
            base, p = tree.query(int(ranks[same]))
            own = float(k)
            if p >= 0:
                own = min(k, float(a[same] - a[p]))
                joined = base - gap * float(a[same] + b[same]) + own + gap * 2 * own
                if joined > k:
                    score[same], parent[same] = joined, p
                else:
                    score[same] = float(k)
            else:
                score[same] = own
            same += 1
        for x in range(i, same):
            tree.update(int(ranks[x]), (score[x] + gap * float(a[x] + b[x]), x))
        i = same
    used, out = [False] * len(a), []
    for end in sorted(range(len(a)), key=lambda x: -score[x]):
        if used[end]:
            continue
        path, x = [], end
        while x >= 0 and not used[x]:
            used[x] = True
            path.append(int(order[x]))
            x = parent[x]
        total = score[end] - (score[x] if x >= 0 else 0.0)
        if total >= least:
            out.append((total, path[::-1]))
    return out
