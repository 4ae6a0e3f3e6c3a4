"""Ward's hierarchical clustering of a bounded number of summed-up points."""

from __future__ import annotations

import numpy as np


def ward(sizes: list[int], sums: list[list[float]], k: int) -> list[int]:
    """Cluster of each point, numbered by first appearance, when merges that add least to the squares within go on until k are left.

    A point is given by how many rows it stands for and their sum. Merges are found by chains of nearest neighbours, which
    give the same tree as taking the cheapest merge each time, and are then put in order of their cost.
    """
    n, s = np.array(sizes, float), np.array(sums, float).reshape(len(sizes), -1)
    alive, merges, chain = np.ones(len(n), bool), [], []

    def cost(i: int) -> np.ndarray:
        gap = ((s / n[:, None] - s[i] / n[i]) ** 2).sum(1) * n * n[i] / (n + n[i])
        gap[~alive] = np.inf
        gap[i] = np.inf
        return gap

    for _ in range(len(n) - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            gap = cost(chain[-1])
            best = int(gap.argmin())
            if len(chain) > 1 and gap[chain[-2]] <= gap[best]:  # the one before wins ties, so that a chain ends
                break
            chain.append(best)
        b, a = chain.pop(), chain.pop()
        merges.append((float(gap[a]), len(merges), a, b))
        n[a], s[a], alive[b] = n[a] + n[b], s[a] + s[b], False
    root = list(range(len(n)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, _, a, b in sorted(merges)[: max(0, len(n) - k)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    number: dict[int, int] = {}
    return [number.setdefault(find(i), len(number)) for i in range(len(n))]
