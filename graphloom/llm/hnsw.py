"""A hierarchical navigable small-world graph as flat neighbour arrays, built and searched in batches with numpy.

A level holds every ``RATIO``-th vector of the one below, down to a top of at most ``FLAT`` vectors, which are scanned in one
matrix product. Each level is a graph of its own: ``near[n, degree]`` (int32, -1 where unused) and the similarities beside
it, kept by similarity. A query descends from the top: the best of a level start the beam on the next. All queries of a
batch take each step together: the best unexpanded node of each beam is expanded, its unseen neighbours are scored and
merged in.

Insertion is batched: the vectors of the upper levels take their links from there, then each batch searches the graph of
what was inserted before, its own members are compared by a matrix product, and links are made both ways; a full list keeps
its most similar ones.
"""

from __future__ import annotations

import numpy as np

RATIO, FLAT = 6, 3000
_ID, _SCALE = (1 << 31) - 1, 1 << 29


class Hnsw:
    def __init__(self, x: np.ndarray, *, degree: int = 32, beam: int = 64, steps: int = 48, entries: int = 16, batch: int = 1024, levels: int = 0):
        """x: unit vectors, float32, one per row (in any order)."""
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.degree, self.beam, self.steps, self.entries, self.batch = degree, beam, steps, entries, batch
        self.upper: Hnsw | None = None
        self.near = np.full((n, degree), -1, np.int32)
        self.sim = np.full((n, degree), -2, np.float32)
        if n <= FLAT:
            for a in range(0, n, batch):
                own = np.arange(a, min(a + batch, n))
                i, s = self._scan(self.x[own], degree, own)
                self.near[own, : i.shape[1]], self.sim[own, : i.shape[1]] = np.where(s > -2, i, -1), s
            return
        # A fixed shuffle: levels must not follow the order in which the vectors came.
        order = np.random.default_rng(levels).permutation(n).astype(np.int32)
        self.top = order[: n // RATIO]
        self.upper = Hnsw(self.x[self.top], degree=degree, beam=entries, steps=entries, entries=entries, batch=batch, levels=levels + 1)
        self.near[self.top] = np.where(self.upper.near >= 0, self.top[self.upper.near], -1)
        self.sim[self.top] = self.upper.sim
        self.seen = np.zeros(batch * (n + 1), bool)
        for a in range(len(self.top), n, batch):
            self._insert(order[a : a + batch])

    def _scan(self, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best by a matrix product over all; ``own`` are the queries' ids, which don't count."""
        s = q @ self.x.T
        if own is not None:
            s[np.arange(len(q)), own] = -2
        k = min(k, s.shape[1])
        at = np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :] if k < s.shape[1] else np.tile(np.arange(k), (len(q), 1))
        return at.astype(np.int32), np.take_along_axis(s, at, 1)

    def search(self, q: np.ndarray, *, own: np.ndarray | None = None, beam: int | None = None, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of each query's beam, unordered; -1 and -2 where it isn't full.

        ``own``: the queries' ids, where they are vectors of the graph; their search begins at their own links.
        """
        ids, sims = [], []
        for a in range(0, len(q), self.batch):
            start = None if own is None or self.upper is None else (self.near[own[a : a + self.batch]], self.sim[own[a : a + self.batch]])
            i, s = self._beam(q[a : a + self.batch], start, beam or self.beam, self.steps if steps is None else steps)
            ids.append(i)
            sims.append(s)
        return np.concatenate(ids), np.concatenate(sims)

    def _enter(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the beam on this level begins: what the level above gives."""
        i, s = self.upper.search(q)
        i, s = top(i, s, self.entries)
        return np.where(i >= 0, self.top[i], -1).astype(np.int32), s

    def _beam(self, q: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None, w: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """A beam is one array of numbers: similarity, id and whether it is still open, in this order of bits; -1 is empty.

        So one partition of plain numbers merges a beam with what was found.
        """
        b = len(q)
        if self.upper is None:
            return self._scan(q, w)
        at, s = start or self._enter(q)
        beam = np.full((b, w), -1, np.int64)
        first = np.where(s > -2, _entry(s, at), -1)
        if first.shape[1] > w:
            first = np.partition(first, first.shape[1] - w, axis=1)[:, first.shape[1] - w :]
        beam[:, : first.shape[1]] = first
        # Flat marks of what each query has seen; a row begins with one for the empty link, -1.
        width, live = len(self.x) + 1, np.arange(b)
        seen = self.seen[: b * width]
        seen[:] = False
        seen[::width] = True
        seen[((live * width + 1)[:, None] + at).ravel()] = True
        for _ in range(steps):
            now = beam[live]
            open_ = np.where(now & 1, now, -1)
            pick = open_.argmax(1)
            best = open_[np.arange(len(live)), pick]
            go = best >= 0
            live, pick, best = live[go], pick[go], best[go]
            if not len(live):
                break
            beam[live, pick] = best - 1
            nb = self.near.take((best >> 1) & _ID, axis=0)
            marks = ((live * width + 1)[:, None] + nb).ravel()
            new = np.flatnonzero(~seen.take(marks))
            what = nb.ravel().take(new)
            seen[marks.take(new)] = True
            both = np.full((len(live), w + nb.shape[1]), -1, np.int64)
            both[:, :w] = beam[live]
            r, c = np.divmod(new, nb.shape[1])
            sims = np.einsum("ij,ij->i", self.x.take(what, axis=0), q.take(live.take(r), axis=0))
            both[r, w + c] = _entry(sims, what)
            both.partition(both.shape[1] - w, axis=1)
            beam[live] = both[:, both.shape[1] - w :]
        full = beam >= 0
        return np.where(full, (beam >> 1) & _ID, -1).astype(np.int32), np.where(full, (beam >> 32) / _SCALE - 1, -2).astype(np.float32)

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        ids, sims = self._beam(q, None, self.beam, self.steps)
        s = q @ q.T
        np.fill_diagonal(s, -2)
        k = min(self.degree, len(new))
        at = np.argpartition(s, len(new) - k, axis=1)[:, len(new) - k :]
        self._link(new, np.concatenate((ids, new[at]), 1), np.concatenate((sims, np.take_along_axis(s, at, 1)), 1))

    def _link(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give the new nodes their best links, and their best ends the links back."""
        d = self.degree
        if ids.shape[1] > d:
            keep = np.argpartition(sims, ids.shape[1] - d, axis=1)[:, ids.shape[1] - d :]
            ids, sims = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
        w = ids.shape[1]
        self.near[new, :w], self.sim[new, :w] = np.where(sims > -2, ids, -1), sims
        to, s = ids.ravel(), sims.ravel()
        frm = np.repeat(new, w)
        ok = s > -2
        # A back link that is weaker than all of a full list can't get in.
        ok[ok] = s[ok] > self.sim[to[ok]].min(1)
        to, s, frm = to[ok], s[ok], frm[ok]
        if not len(to):
            return
        by = np.lexsort((-s, to))
        to, s, frm = to[by], s[by], frm[by]
        ends, first, n = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, n)
        fit = rank < d
        width = int(min(d, n.max()))
        more_i = np.full((len(ends), width), -1, np.int32)
        more_s = np.full((len(ends), width), -2, np.float32)
        row = np.repeat(np.arange(len(ends)), n)
        more_i[row[fit], rank[fit]], more_s[row[fit], rank[fit]] = frm[fit], s[fit]
        # The pair is in both lists already where both ends are new.
        dup = (more_i[:, :, None] == self.near[ends][:, None, :]).any(2) if np.isin(ends, new).any() else None
        if dup is not None:
            more_s[dup] = -2
        all_s = np.concatenate((self.sim[ends], more_s), 1)
        all_i = np.concatenate((self.near[ends], more_i), 1)
        keep = np.argpartition(all_s, all_s.shape[1] - d, axis=1)[:, all_s.shape[1] - d :]
        self.sim[ends] = np.take_along_axis(all_s, keep, 1)
        self.near[ends] = np.where(self.sim[ends] > -2, np.take_along_axis(all_i, keep, 1), -1)

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's k most similar ones as the graph has them, most similar first."""
        return top(self.near, self.sim, k)


def _entry(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An open entry of a beam."""
    return (np.clip((sims.astype(np.float64) + 1) * _SCALE, 0, 1 << 31).astype(np.int64) << 32) | (ids.astype(np.int64) << 1) | 1


def top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, ids.shape[1])
    at = np.argpartition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k :]
    s = np.take_along_axis(sims, at, 1)
    by = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(np.take_along_axis(ids, at, 1), by, 1), np.take_along_axis(s, by, 1)
