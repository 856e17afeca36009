"""A hierarchical navigable small-world graph over the vectors of one shard, as flat arrays.

Nearness is the largest inner product. Every vector gets one more component that
brings all to the same length; a query gets a zero there, so the order by inner product
stays as it is and the graph is built in a space where a vector is its own nearest.
Vectors enter in batches: a batch searches the graph of those before it, looks at itself, and is linked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16
BUILD_BREADTH = 80
BATCH = 256


@dataclass
class Graph:
    """Layer 0 holds all vectors. ``neighbours[l]`` has a row for each of ``members[l]``; -1 is no link."""

    points: np.ndarray  # n x (d + 1), float32
    members: list[np.ndarray]
    neighbours: list[np.ndarray]
    entry: int

    def search(self, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the nearest found, ``breadth`` columns, -1 where there are fewer."""
        start = np.full((len(queries), 1), self.entry, dtype=np.int64)
        for layer in range(len(self.members) - 1, 0, -1):
            start = self._beam(queries, start, layer, 1)[0]
        return self._beam(queries, start, 0, breadth)

    def _beam(
        self, queries: np.ndarray, start: np.ndarray, layer: int, breadth: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one layer for all queries at once."""
        links, rows = self.neighbours[layer], np.arange(len(queries))[:, None]
        if layer:
            slot = np.full(len(self.points), -1, dtype=np.int64)
            slot[self.members[layer]] = np.arange(len(self.members[layer]))
        ids = np.full((len(queries), breadth), -1, dtype=np.int64)
        near = np.full((len(queries), breadth), -np.inf, dtype=np.float32)
        done = np.zeros((len(queries), breadth), dtype=bool)
        k = min(start.shape[1], breadth)
        ids[:, :k] = start[:, :k]
        near[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qd,qkd->qk", queries, self.points[ids[:, :k]]), -np.inf)
        seen = np.zeros((len(queries), len(self.points) + 1), dtype=bool)
        seen[rows, ids] = True
        open_ = np.arange(len(queries))
        while len(open_):
            waiting = np.where(done[open_] | (ids[open_] < 0), -np.inf, near[open_])
            best = waiting.argmax(axis=1)
            still = waiting[np.arange(len(open_)), best] > -np.inf
            open_, best = open_[still], best[still]
            if not len(open_):
                break
            done[open_, best] = True
            at = ids[open_, best]
            found = links[slot[at] if layer else at]
            fresh = (found >= 0) & ~seen[open_[:, None], found]
            seen[open_[:, None], np.where(fresh, found, len(self.points))] = True
            found = np.where(fresh, found, -1)
            value = np.einsum("qd,qkd->qk", queries[open_], self.points[found])
            value = np.where(fresh, value, -np.inf).astype(np.float32)
            all_ids = np.concatenate((ids[open_], found), axis=1)
            all_near = np.concatenate((near[open_], value), axis=1)
            all_done = np.concatenate((done[open_], np.zeros(found.shape, dtype=bool)), axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :breadth]
            ids[open_] = np.take_along_axis(all_ids, order, axis=1)
            near[open_] = np.take_along_axis(all_near, order, axis=1)
            done[open_] = np.take_along_axis(all_done, order, axis=1)
        return ids, near


def levelled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with a component that makes all as long as the longest."""
    square = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
    rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.concatenate((vectors, rest[:, None]), axis=1).astype(np.float32)


def spread(points: np.ndarray, owners: np.ndarray, ids: np.ndarray, links: int) -> np.ndarray:
    """For each owner, up to ``links`` of its candidates ``ids`` (-1: none), nearest first, that are nearer to it than to one taken before."""
    near = np.where(ids >= 0, np.einsum("qd,qkd->qk", points[owners], points[ids]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)
    among = np.einsum("qkd,qjd->qkj", points[ids], points[ids])
    taken = np.zeros(ids.shape, dtype=bool)
    for k in range(ids.shape[1]):
        covered = (taken & (among[:, k, :] > near[:, k, None])).any(axis=1)
        taken[:, k] = (ids[:, k] >= 0) & ~covered & (taken.sum(axis=1) < links)
    # What room is left goes to the nearest of the others.
    room = links - taken.sum(axis=1)
    spare = ~taken & (ids >= 0)
    taken |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
    chosen = np.full((len(owners), links), -1, dtype=np.int64)
    row, col = np.nonzero(taken)
    chosen[row, (np.cumsum(taken, axis=1) - 1)[row, col]] = ids[row, col]
    return chosen


def build(vectors: np.ndarray, links: int = LINKS, breadth: int = BUILD_BREADTH, seed: int = 7) -> Graph:
    """The graph of different vectors (n x d); the same for the same vectors in the same order."""
    points = levelled(vectors)
    n = len(points)
    draw = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(1 - draw) / np.log(links)).astype(np.int64)
    top = int(level.max(initial=0))
    members = [np.nonzero(level >= layer)[0] for layer in range(top + 1)]
    room = [2 * links] + [links] * top
    neighbours = [np.full((len(m), room[layer]), -1, dtype=np.int64) for layer, m in enumerate(members)]
    slots = []
    for m in members:
        slot = np.full(n + 1, -1, dtype=np.int64)
        slot[m] = np.arange(len(m))
        slots.append(slot)
    graph = Graph(points, members, neighbours, 0)
    reached, at = -1, 0
    while at < n:
        batch = np.arange(at, min(n, at + max(8, min(BATCH, at // 2))))
        start = np.full((len(batch), 1), graph.entry if at else -1, dtype=np.int64)
        for layer in range(top, -1, -1):
            own = batch[level[batch] >= layer]
            if at and layer <= reached:
                start = graph._beam(points[batch], start, layer, breadth if len(own) else 1)[0]
            if not len(own):
                continue
            found = start[level[batch] >= layer] if at and layer <= reached else np.full((len(own), 1), -1)
            # The batch itself: everybody else in it.
            near = points[own] @ points[own].T
            np.fill_diagonal(near, -np.inf)
            few = min(len(own) - 1, 2 * links)
            if few > 0:
                mates = np.argpartition(-near, few - 1, axis=1)[:, :few]
                found = np.concatenate((found, own[mates]), axis=1)
            chosen = spread(points, own, found, links)
            slot, table = slots[layer], neighbours[layer]
            table[slot[own], :links] = chosen
            # Both ways: those linked to get the new ones among their own candidates.
            row, col = np.nonzero(chosen >= 0)
            source, target = own[row], chosen[row, col]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            owners, first, count = np.unique(target, return_index=True, return_counts=True)
            width = int(count.max(initial=0))
            extra = np.full((len(owners), width), -1, dtype=np.int64)
            place = np.arange(len(target)) - np.repeat(first, count)
            extra[np.repeat(np.arange(len(owners)), count), place] = source
            # A pair of one batch may have chosen each other.
            extra[(extra[:, :, None] == table[slot[owners]][:, None, :]).any(axis=2)] = -1
            for k in range(0, len(owners), BATCH):
                part = owners[k : k + BATCH]
                table[slot[part]] = spread(
                    points, part, np.concatenate((table[slot[part]], extra[k : k + BATCH]), axis=1), room[layer]
                )
        highest = int(level[batch].max())
        if highest > reached:
            reached, graph.entry = highest, int(batch[level[batch].argmax()])
        at += len(batch)
    return graph
