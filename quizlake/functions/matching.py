"""Small combinatorial solvers used inside operators: assignment, maximum flow and disjoint sets."""

from __future__ import annotations

from collections import deque


def assignment(cost: list[list[float]]) -> list[int]:
    """The column of each row in a cheapest full assignment of an n x m cost table with n <= m (shortest augmenting paths)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    inf = float("inf")
    row_potential, col_potential = [0.0] * n, [0.0] * m
    row_of = [-1] * m
    for start in range(n):
        dist, parent, done = [inf] * m, [-1] * m, [False] * m
        row, last, base = start, -1, 0.0
        while True:
            best, best_col = inf, -1
            for c in range(m):
                if done[c]:
                    continue
                d = base + cost[row][c] - row_potential[row] - col_potential[c]
                if d < dist[c]:
                    dist[c], parent[c] = d, last
                if dist[c] < best:
                    best, best_col = dist[c], c
            done[best_col] = True
            last, base = best_col, best
            if row_of[best_col] < 0:
                break
            row = row_of[best_col]
        for c in range(m):
            if done[c] and c != last:
                row_potential[row_of[c]] += base - dist[c]
                col_potential[c] -= base - dist[c]
        row_potential[start] += base
        c = last
        while c >= 0:
            before = parent[c]
            row_of[c] = row_of[before] if before >= 0 else start
            c = before
    out = [-1] * n
    for c, r in enumerate(row_of):
        if r >= 0:
            out[r] = c
    return out


class Flow:
    """Maximum flow with integer capacities (levels and blocking flows)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, capacity: int) -> int:
        """Adds an edge; returns its number for ``used``."""
        self.out[a].append(len(self.head))
        self.head.append(b)
        self.left.append(capacity)
        self.out[b].append(len(self.head))
        self.head.append(a)
        self.left.append(0)
        return len(self.head) - 2

    def used(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = {source: 0}
            todo = deque([source])
            while todo:
                a = todo.popleft()
                for e in self.out[a]:
                    if self.left[e] and self.head[e] not in level:
                        level[self.head[e]] = level[a] + 1
                        todo.append(self.head[e])
            if sink not in level:
                return total
            at = [0] * len(self.out)
            while pushed := self._push(source, sink, 1 << 62, level, at):
                total += pushed

    def _push(self, a: int, sink: int, most: int, level: dict[int, int], at: list[int]) -> int:
        if a == sink:
            return most
        while at[a] < len(self.out[a]):
            e = self.out[a][at[a]]
            b = self.head[e]
            if self.left[e] and level.get(b) == level[a] + 1 and (got := self._push(b, sink, min(most, self.left[e]), level, at)):
                self.left[e] -= got
                self.left[e ^ 1] += got
                return got
            at[a] += 1
        return 0


class DisjointSets:
    """Union-find over any hashable values."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):  # noqa: ANN001, ANN201
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a, b) -> None:  # noqa: ANN001
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> dict:
        out: dict = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out
