"""A pattern in memory, and the walks that the orderings share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


class Graph:
    """Neighbour lists, ascending, of a symmetric pattern without loops."""

    def __init__(self, neighbours: list[list[int]]):
        self.neighbours, self.n = neighbours, len(neighbours)
        self.degree = [len(x) for x in neighbours]

    @classmethod
    def packed(cls, n: int, col_at, rows) -> Graph:
        """From a packed pattern; it is made symmetric, and loops, repeats and rows out of range are dropped."""
        at, rows = np.asarray(col_at, np.int64), np.asarray(rows, np.int64)
        return cls.edges(n, np.repeat(np.arange(n), np.diff(at)) if n else rows[:0], rows)

    @classmethod
    def edges(cls, n: int, a, b) -> Graph:
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        good = (a != b) & (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n)
        a, b = a[good], b[good]
        codes = np.unique(np.concatenate([a * n + b, b * n + a]))
        cuts = np.searchsorted(codes, np.arange(n + 1) * n)
        flat = (codes % max(n, 1)).tolist()
        return cls([flat[s:e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])

    def within(self, vertices: list[int]) -> Graph:
        """The pattern of some vertices, given ascending, which are numbered in that order."""
        number = {v: k for k, v in enumerate(vertices)}
        return Graph([[number[u] for u in self.neighbours[v] if u in number] for v in vertices])

    def components(self) -> list[list[int]]:
        """Connected components by their least vertex, each ascending."""
        found, placed = [], bytearray(self.n)
        for seed in range(self.n):
            if placed[seed]:
                continue
            placed[seed], reached = 1, [seed]
            for v in reached:
                for u in self.neighbours[v]:
                    if not placed[u]:
                        placed[u] = 1
                        reached.append(u)
            found.append(sorted(reached))
        return found

    @property
    def nnz(self) -> int:
        return sum(self.degree)

    def walk(self, start: int, inside: Callable[[int], bool] | None = None) -> list[list[int]]:
        """Breadth-first levels from start, each in the order of discovery."""
        seen, levels = {start}, [[start]]
        while True:
            following = []
            for u in levels[-1]:
                for v in self.neighbours[u]:
                    if v not in seen and (inside is None or inside(v)):
                        seen.add(v)
                        following.append(v)
            if not following:
                return levels
            levels.append(following)

    def slimmest(self, vertices: Iterable[int]) -> int:
        """The vertex of least degree, the first of several."""
        return min(vertices, key=self.degree.__getitem__)

    def by_degree(self, vertices: Iterable[int]) -> list[int]:
        return sorted(vertices, key=lambda v: (self.degree[v], v))

    def outermost(self, start: int) -> tuple[int, int]:
        """The slimmest vertex of the last level from start, and how many levels lie behind start."""
        levels = self.walk(start)
        return self.slimmest(levels[-1]), len(levels) - 1

    def peripheral(self, seed: int, jumps: int = 5) -> int:
        """A vertex far out: jumps to the outermost vertex while that lies deeper each time."""
        depth = 0
        for _ in range(jumps):
            far, found = self.outermost(seed)
            if found <= depth:
                break
            seed, depth = far, found
        return seed
