"""Minimum-cost flow on a small network (primal-dual with blocking flows)."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush


class Network:
    """Arcs with integer capacities and non-negative integer costs."""

    def __init__(self, nodes: int) -> None:
        self.head: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        """Add an arc and its reverse; the arc's number."""
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def send(self, source: int, sink: int) -> int:
        """Send as much as possible at least cost; the amount sent."""
        potential, sent = [0] * len(self.head), 0
        while True:
            distance = self._distances(source, potential)
            if distance[sink] is None:
                return sent
            far = distance[sink]
            for v, d in enumerate(distance):
                potential[v] += far if d is None else min(d, far)
            while True:  # blocking flows over the arcs of reduced cost 0
                level = self._levels(source, potential)
                if level[sink] < 0:
                    break
                sent += self._block(source, sink, level, potential)

    def _free(self, arc: int, v: int, potential: list[int]) -> bool:
        return self.room[arc] > 0 and self.cost[arc] + potential[v] - potential[self.to[arc]] == 0

    def _distances(self, source: int, potential: list[int]) -> list[int | None]:
        distance: list[int | None] = [None] * len(self.head)
        distance[source], queue = 0, [(0, source)]
        while queue:
            d, v = heappop(queue)
            if d > distance[v]:
                continue
            for arc in self.head[v]:
                if self.room[arc] > 0:
                    w, new = self.to[arc], d + self.cost[arc] + potential[v] - potential[self.to[arc]]
                    if distance[w] is None or new < distance[w]:
                        distance[w] = new
                        heappush(queue, (new, w))
        return distance

    def _levels(self, source: int, potential: list[int]) -> list[int]:
        level = [-1] * len(self.head)
        level[source], queue = 0, deque([source])
        while queue:
            v = queue.popleft()
            for arc in self.head[v]:
                if level[self.to[arc]] < 0 and self._free(arc, v, potential):
                    level[self.to[arc]] = level[v] + 1
                    queue.append(self.to[arc])
        return level

    def _block(self, source: int, sink: int, level: list[int], potential: list[int]) -> int:
        sent, at, path = 0, [0] * len(self.head), []
        v = source
        while True:
            if v == sink:
                amount = min(self.room[arc] for arc in path)
                for arc in path:
                    self.room[arc] -= amount
                    self.room[arc ^ 1] += amount
                sent += amount
                v, path = source, []
                continue
            while at[v] < len(self.head[v]):
                arc = self.head[v][at[v]]
                if level[self.to[arc]] == level[v] + 1 and self._free(arc, v, potential):
                    break
                at[v] += 1
            else:
                if v == source:
                    return sent
                arc = path.pop()
                v = self.to[arc ^ 1]
                at[v] += 1
                continue
            path.append(arc)
            v = self.to[arc]
