"""A hierarchical navigable small-world graph over the vectors of one shard."""

from __future__ import annotations

import heapq
import math

import numpy as np

LINKS = 12  # links that a new node gets per layer; layer 0 keeps twice as many


class Graph:
    """Unit vectors with layered links; layer 0 is a matrix of rows padded with -1."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.ground = np.full((len(vectors), 2 * LINKS + 8), -1, np.int32)
        self.degree = np.zeros(len(vectors), np.int32)
        self.upper: list[dict[int, np.ndarray]] = []
        self.entry = -1

    @classmethod
    def built(cls, vectors: np.ndarray, beam: int = 48, seed: int = 1) -> Graph:
        graph = cls(vectors)
        draws = np.random.default_rng(seed).random(len(vectors))
        levels = np.minimum((-np.log(np.maximum(draws, 1e-12)) / math.log(LINKS)).astype(int), 12)
        for node, level in enumerate(levels):
            graph._insert(node, int(level), beam)
        graph._connect()
        return graph

    def _reached(self, start: int, seen: np.ndarray) -> None:
        """Mark every node that layer 0 leads to from ``start``."""
        seen[start], front = True, np.array([start])
        while len(front):
            around = np.unique(self.ground[front])
            front = around[(around >= 0) & ~seen[around]]
            seen[front] = True

    def _connect(self) -> None:
        """Link nodes that pruning has cut off to the nearest node that is reached."""
        if self.entry < 0:
            return
        seen = np.zeros(len(self.vectors), bool)
        self._reached(self.entry, seen)
        for node in np.flatnonzero(~seen).tolist():
            if seen[node]:
                continue
            reached = np.flatnonzero(seen)
            near = int(reached[(self.vectors[reached] @ self.vectors[node]).argmax()])
            if self.degree[near] == self.ground.shape[1]:
                self.ground = np.pad(self.ground, ((0, 0), (0, 8)), constant_values=-1)
            self.ground[near, self.degree[near]] = node
            self.degree[near] += 1
            self._reached(node, seen)

    def _around(self, node: int, layer: int) -> np.ndarray:
        if layer:
            return self.upper[layer - 1][node]
        return self.ground[node, : self.degree[node]]

    def _descend(self, q: np.ndarray, layer: int) -> int:
        """The node nearest to q that greedy steps reach above ``layer``."""
        at = self.entry
        near = float(self.vectors[at] @ q)
        for k in range(len(self.upper), layer, -1):
            while True:
                around = self._around(at, k)
                if not len(around):
                    break
                sims = self.vectors[around] @ q
                best = int(sims.argmax())
                if sims[best] <= near:
                    break
                at, near = int(around[best]), float(sims[best])
        return at

    def _search(self, q: np.ndarray, start: int, beam: int, layer: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest nodes found."""
        seen = np.zeros(len(self.vectors), bool)
        seen[start] = True
        near = float(self.vectors[start] @ q)
        todo, kept = [(-near, start)], [(near, start)]
        while todo:
            sim, node = heapq.heappop(todo)
            if len(kept) >= beam and -sim < kept[0][0]:
                break
            around = self._around(node, layer)
            around = around[~seen[around]]
            if not len(around):
                continue
            seen[around] = True
            sims = self.vectors[around] @ q
            if len(kept) >= beam:
                better = sims > kept[0][0]
                around, sims = around[better], sims[better]
            for other, s in zip(around.tolist(), sims.tolist()):
                heapq.heappush(todo, (-s, other))
                heapq.heappush(kept, (s, other))
                if len(kept) > beam:
                    heapq.heappop(kept)
        return sorted(kept, reverse=True)

    def _spread(self, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of nodes in order of nearness, first those nearer to the base than to one chosen before."""
        if len(nodes) <= most:
            return nodes
        between = self.vectors[nodes] @ self.vectors[nodes].T
        chosen, left = [], []
        closest = np.full(len(nodes), -2.0)
        for i in range(len(nodes)):
            if closest[i] < sims[i] and len(chosen) < most:
                chosen.append(i)
                np.maximum(closest, between[i], out=closest)
            else:
                left.append(i)
        return nodes[chosen + left[: most - len(chosen)]]

    def _link(self, node: int, other: int, layer: int) -> None:
        if layer:
            links = self.upper[layer - 1]
            links[node] = np.append(links[node], other)
            if len(links[node]) > LINKS + 6:
                links[node] = self._pruned(node, links[node], LINKS)
            return
        if self.degree[node] == self.ground.shape[1]:
            kept = self._pruned(node, self.ground[node], 2 * LINKS)
            self.ground[node, : len(kept)] = kept
            self.degree[node] = len(kept)
        self.ground[node, self.degree[node]] = other
        self.degree[node] += 1

    def _pruned(self, node: int, others: np.ndarray, most: int) -> np.ndarray:
        sims = self.vectors[others] @ self.vectors[node]
        order = np.argsort(-sims, kind="stable")
        return self._spread(others[order], sims[order], most)

    def _insert(self, node: int, level: int, beam: int) -> None:
        q = self.vectors[node]
        if self.entry < 0:
            self.upper = [{node: np.empty(0, np.int32)} for _ in range(level)]
            self.entry = node
            return
        top = len(self.upper)
        at = self._descend(q, min(level, top))
        for layer in range(min(level, top), -1, -1):
            found = self._search(q, at, beam, layer)
            at = found[0][1]
            nodes = np.array([n for _, n in found], np.int32)
            chosen = self._spread(nodes, np.array([s for s, _ in found]), LINKS)
            if layer:
                self.upper[layer - 1][node] = chosen
            else:
                self.ground[node, : len(chosen)] = chosen
                self.degree[node] = len(chosen)
            for other in chosen.tolist():
                self._link(other, node, layer)
        if level > top:
            self.upper += [{node: np.empty(0, np.int32)} for _ in range(level - top)]
            self.entry = node

    def near(self, q: np.ndarray, beam: int, floor: float) -> np.ndarray:
        """Nodes found with a cosine of at least ``floor`` to the unit vector q.

        A beam as wide as the shard would visit every node: then all are compared at once.
        """
        if beam >= len(self.vectors):
            return np.flatnonzero(self.vectors @ q >= floor)
        found = self._search(q, self._descend(q, 0), beam, 0)
        front = np.array([n for s, n in found if s >= floor], np.int64)
        seen = np.zeros(len(self.vectors) + 1, bool)  # the last one stands for the padding
        seen[[n for _, n in found]] = True
        seen[-1] = True
        hits = [front]
        while len(front):  # on from all near nodes at once, as far as nodes are near
            around = np.unique(self.ground[front])
            around = around[~seen[around]]
            seen[around] = True
            front = around[self.vectors[around] @ q >= floor]
            hits.append(front)
        return np.concatenate(hits)
