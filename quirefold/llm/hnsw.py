"""Hierarchical navigable small-world graphs over unit vectors, searched many queries at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Links of a node on upper layers and on the lowest one; beam while building; nodes added at once.
LINKS, LOWEST, BUILD_BEAM, TOGETHER = 16, 32, 64, 1024
#: Queries searched at once, and how many of a query's best nodes are opened in one step.
QUERIES, OPENED = 512, 4
NONE = np.float32(-3)


def chosen(near: np.ndarray, most: int, sims: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Up to ``most`` links of each row's candidates (-1: none), kept apart: those nearer to the row's
    node than to a link already taken first, then the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    out = np.full((len(near), most), -1, dtype=np.int32)
    for k in range(0, len(near), 1024):
        ids, s = near[k : k + 1024], sims[k : k + 1024]
        v = vectors[ids]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros(ids.shape, dtype=bool)
        closest = np.full(ids.shape, NONE)  # to a taken link
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (s[:, c] > closest[:, c]) & (taken.sum(axis=1) < most)
            taken[:, c] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
        rank = np.where(ids < 0, 2, 1 - taken)  # taken ones, the rest, no candidates
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out[k : k + 1024, : first.shape[1]] = np.take_along_axis(ids, first, 1)
    return out


class Graph:
    """Layers over unit vectors. Nodes are sorted by level, so a layer's nodes are the first ones of all."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        n, rng = len(vectors), np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.vectors = np.ascontiguousarray(vectors[self.order], dtype=np.float32)
        self.layers: list[np.ndarray] = []  # the highest first
        for k in range(level.max(initial=0), -1, -1):
            self._add_layer(int((level >= k).sum()), LOWEST if k == 0 else LINKS)

    def _add_layer(self, size: int, most: int) -> None:
        above = len(self.layers[-1]) if self.layers else 0
        links = np.full((size, most), -1, dtype=np.int32)
        at = 0
        while at < size:
            end = min(size, at + min(TOGETHER, max(at, 128)))
            new = self.vectors[at:end]
            near = [self._own_nearest(new, at)]
            if at:
                start = self._descended(new) if at >= above and above else np.zeros(end - at, dtype=np.int32)
                near.append(np.concatenate([self._beam(links[:at], new[k : k + QUERIES], start[k : k + QUERIES], BUILD_BEAM)[0] for k in range(0, end - at, QUERIES)]))
            near = np.concatenate(near, axis=1)
            links[at:end, : most // 2] = chosen(near, most // 2, self._sims(new, near), self.vectors)
            self._link_back(links, at, end)
            at = end
        self.layers.append(links)

    def _own_nearest(self, new: np.ndarray, at: int) -> np.ndarray:
        """The nearest of the nodes that are added together, without a node itself."""
        k = min(BUILD_BEAM // 2, len(new) - 1)
        if k < 1:
            return np.full((len(new), 1), -1, dtype=np.int32)
        sims = new @ new.T
        np.fill_diagonal(sims, NONE)
        return (np.argpartition(-sims, k - 1, axis=1)[:, :k] + at).astype(np.int32)

    def _sims(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s = np.empty(ids.shape, dtype=np.float32)
        for k in range(0, len(ids), 1024):
            s[k : k + 1024] = (self.vectors[ids[k : k + 1024]] @ queries[k : k + 1024, :, None])[:, :, 0]
        s[ids < 0] = NONE
        return s

    def _link_back(self, links: np.ndarray, at: int, end: int) -> None:
        """Adds the links' other directions; nodes with too many choose anew."""
        fresh = links[at:end]
        a, b = fresh.ravel(), np.repeat(np.arange(at, end, dtype=np.int32), fresh.shape[1])
        a, b = a[a >= 0], b[a >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        nodes, first, count = np.unique(a, return_index=True, return_counts=True)
        more = np.full((len(nodes), count.max(initial=0)), -1, dtype=np.int32)
        row = np.repeat(np.arange(len(nodes)), count)
        more[row, np.arange(len(a)) - first[row]] = b
        for k in range(0, len(nodes), 4096):
            own = nodes[k : k + 4096]
            wide = np.sort(np.concatenate([links[own], more[k : k + 4096]], axis=1), axis=1)[:, ::-1]
            wide[:, 1:][(wide[:, 1:] == wide[:, :-1])] = -1
            wide = np.sort(wide, axis=1)[:, ::-1]
            width = max(links.shape[1], int((wide >= 0).sum(axis=1).max(initial=0)))
            wide = wide[:, :width]
            full = (wide >= 0).sum(axis=1) > links.shape[1]
            links[own[~full]] = wide[~full][:, : links.shape[1]]
            if full.any():
                links[own[full]] = chosen(wide[full], links.shape[1], self._sims(self.vectors[own[full]], wide[full]), self.vectors)

    def _beam(self, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best nodes found for each query, best first; -1 where there are fewer."""
        q = len(queries)
        ids = np.full((q, beam), -1, dtype=np.int32)
        sims = np.full((q, beam), NONE)
        done = np.ones((q, beam), dtype=bool)
        seen = np.zeros((q, len(links)), dtype=bool)
        ids[:, 0], done[:, 0] = start, False
        sims[:, 0] = np.einsum("qd,qd->q", self.vectors[start], queries)
        seen[np.arange(q), start] = True
        live = np.arange(q)
        while len(live):
            best = np.argsort(done[live], axis=1, kind="stable")[:, :OPENED]  # rows are sorted: the first that aren't done
            open_ = ~done[live[:, None], best]
            done[live[:, None], best] = True
            some = np.where(open_[:, :, None], links[ids[live[:, None], best]], -1).reshape(len(live), -1)
            some.sort(axis=1)
            fresh = some >= 0
            fresh[:, 1:] &= some[:, 1:] != some[:, :-1]
            r, c = np.nonzero(fresh)
            new = ~seen[live[r], some[r, c]]
            r, c = r[new], c[new]
            found = some[r, c]
            seen[live[r], found] = True
            s = np.einsum("nd,nd->n", self.vectors[found], queries[live[r]])
            better = s > sims[live[r], -1]
            r, found, s = r[better], found[better], s[better]
            if len(r):
                rows, first, count = np.unique(r, return_index=True, return_counts=True)
                k, own = np.repeat(np.arange(len(rows)), count), live[rows]
                place = beam + np.arange(len(r)) - first[k]
                width = beam + int(count.max())
                wide_i, wide_s, wide_d = np.full((len(rows), width), -1, dtype=np.int32), np.full((len(rows), width), NONE), np.ones((len(rows), width), dtype=bool)
                wide_i[:, :beam], wide_s[:, :beam], wide_d[:, :beam] = ids[own], sims[own], done[own]
                wide_i[k, place], wide_s[k, place], wide_d[k, place] = found, s, False
                order = np.argsort(-wide_s, axis=1, kind="stable")[:, :beam]
                ids[own], sims[own], done[own] = (np.take_along_axis(x, order, 1) for x in (wide_i, wide_s, wide_d))
            live = live[~done[live].all(axis=1)]
        return ids, sims

    def _descended(self, queries: np.ndarray) -> np.ndarray:
        """For each query a near node on the lowest of the finished layers."""
        out = np.zeros(len(queries), dtype=np.int32)
        for k in range(0, len(queries), QUERIES):
            own = out[k : k + QUERIES]
            for links in self.layers:
                own = self._beam(links, queries[k : k + QUERIES], own, OPENED)[0][:, 0]
            out[k : k + QUERIES] = own
        return out

    def within(self, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs found with similarity ``least`` or more, nodes by their places in ``vectors``.

        A query whose beam holds nothing but such nodes may have more: it goes again with a wider one.
        A beam as wide as a quarter of the nodes is the scan of all of them.
        """
        links, n = self.layers[-1], len(self.vectors)
        upper = self.layers[:-1]
        for k in range(0, len(queries), QUERIES):
            q = np.ascontiguousarray(queries[k : k + QUERIES], dtype=np.float32)
            todo, wide = np.arange(len(q)), beam
            start = np.zeros(len(q), dtype=np.int32)
            if 4 * wide < n:
                for layer in upper:
                    start = self._beam(layer, q, start, OPENED)[0][:, 0]
            while len(todo):
                if 4 * wide >= n:
                    a, b = np.nonzero(q[todo] @ self.vectors.T >= least)
                    yield todo[a] + k, self.order[b]
                    break
                ids, sims = self._beam(links, q[todo], start[todo], wide)
                more = sims[:, -1] >= least
                a, b = np.nonzero((sims >= least) & ~more[:, None])
                yield todo[a] + k, self.order[ids[a, b]]
                todo, wide = todo[more], wide * 4

    def audited(self, least: float, target: float = 0.995, sample: int = 256, beam: int = 32, seed: int = 1) -> int:
        """The beam, doubled from ``beam`` on, with which a sample's search finds a share ``target`` of what a scan finds.

        The sample: nodes as they are, and vectors made to have exactly ``least`` with a node, which
        are the hardest to find of those that count.
        """
        n, rng = len(self.vectors), np.random.default_rng(seed)
        own = self.vectors[rng.choice(n, min(sample, n), replace=False)]
        off = rng.normal(size=own.shape).astype(np.float32)
        off -= np.einsum("qd,qd->q", off, own)[:, None] * own
        size = np.linalg.norm(off, axis=1, keepdims=True)
        made = least * own + np.sqrt(1 - least * least) * off / np.maximum(size, 1e-9)
        queries = np.concatenate([own, made[size[:, 0] > 1e-6] * (1 + 1e-6)]).astype(np.float32)
        truth = int((queries @ self.vectors.T >= least).sum())
        while 4 * beam < n:
            if sum(len(a) for a, _ in self.within(queries, least, beam)) >= target * truth:
                break
            beam *= 2
        return beam
