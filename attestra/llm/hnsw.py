"""Hierarchical navigable small-world graphs whose inserts and searches advance many vectors at a time."""

from __future__ import annotations

import numpy as np

#: Cells of the visited table that one search holds at once.
_VISITED = 40_000_000


def _levels(n: int, degree: int, seed: int) -> np.ndarray:
    u = np.random.default_rng(seed).random(n)
    return np.minimum((-np.log(u) / np.log(max(degree, 2))).astype(np.int64), 6)


class Graph:
    """Unit vectors ``x`` (float32), highest level first, and each layer's neighbour lists; a layer holds the first rows of ``x``."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]) -> None:
        self.x, self.layers = x, layers  # a layer: neighbours as rows of x, -1 filled; layer 0 holds all, each higher one fewer

    @staticmethod
    def build(x: np.ndarray, degree: int = 16, ef: int = 48, seed: int = 11) -> tuple[Graph, np.ndarray]:
        """The graph and, for each of its rows, the row of ``x`` that it is."""
        level = _levels(len(x), degree, seed)
        order = np.argsort(-level, kind="stable")
        x = x[order]
        layers: list[np.ndarray] = []
        for k in range(int(level.max(initial=0)), -1, -1):  # from the top, as a layer's inserts enter from the one above
            above = Graph(x, layers) if layers else None
            n = int((level >= k).sum())
            layers = [_layer(x[:n], 2 * degree if k == 0 else degree, ef, above), *layers]
        return Graph(x, layers), order

    def descend(self, q: np.ndarray, to: int, ef: int = 4) -> np.ndarray:
        """The best ``ef`` nodes found to each query in layer ``to``, entering at the top; -1 filled."""
        found = np.zeros((len(q), 1), np.int64)
        for near in self.layers[: to - 1 if to else None : -1]:
            found, _ = beam(self.x[: len(near)], near, q, found[:, :1], min(ef, len(near)))
        return found

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), -1 filled and best first, of the ``ef`` nearest found to each row of ``q``."""
        step = max(1, _VISITED // max(len(self.x), 1))
        parts = [self._search(q[i : i + step], ef) for i in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        entry = self.descend(q, 1)[:, :1] if len(self.layers) > 1 else np.zeros((len(q), 1), np.int64)
        return beam(self.x, self.layers[0], q, entry, ef)


def beam(x: np.ndarray, near: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once; each turn opens the ``wide`` best unopened nodes of every beam."""
    m = len(q)
    seen = np.zeros((m, len(x)), bool)
    ids = np.full((m, ef), -1, np.int64)
    sims = np.full((m, ef), -np.inf, np.float32)
    opened = np.ones((m, ef), bool)
    k = entry.shape[1]
    ids[:, :k], opened[:, :k] = entry, False
    sims[:, :k] = np.einsum("qkd,qd->qk", x[entry], q)
    seen[np.arange(m)[:, None], entry] = True
    live = np.arange(m)
    while len(live):
        score = np.where(opened[live], -np.inf, sims[live])
        w = min(wide, ef)
        take = np.argpartition(-score, w - 1, axis=1)[:, :w] if w < ef else np.tile(np.arange(ef), (len(live), 1))
        ok = np.take_along_axis(score, take, 1) > -np.inf
        any_ok = ok.any(1)
        live, take, ok = live[any_ok], take[any_ok], ok[any_ok]
        if not len(live):
            break
        row = live[:, None]
        opened[row, take] |= ok
        new = np.where(ok[:, :, None], near[np.where(ok, ids[row, take], 0)], -1).reshape(len(live), -1)
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        fresh = (new >= 0) & ~seen[row, np.maximum(new, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], new[r, c]] = True
        got = np.full(new.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("nd,nd->n", x[new[r, c]], q[live[r]])
        all_s = np.concatenate([sims[live], got], 1)
        all_i = np.concatenate([ids[live], np.where(fresh, new, -1)], 1)
        all_o = np.concatenate([opened[live], ~fresh], 1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], opened[live] = (np.take_along_axis(v, best, 1) for v in (all_i, all_s, all_o))
        opened[live] |= ~np.isfinite(sims[live])
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[~np.isfinite(sims)] = -1
    return ids, sims


def _layer(x: np.ndarray, degree: int, ef: int, above: Graph | None) -> np.ndarray:
    """Neighbour lists of one layer: vectors enter in growing batches from the nodes that the layers above lead to, search
    what is there, link both ways and prune."""
    n = len(x)
    near = np.full((n, degree), -1, np.int64)
    done = min(n, 256)
    if n:
        _link(x, near, np.arange(done), _nearest(x[:done], x[:done], degree, True))
    while done < n:
        batch = np.arange(done, min(n, done + max(256, done // 2), done + 2048))
        found = np.full((len(batch), max(ef, degree)), -1, np.int64)
        step = max(1, _VISITED // done)
        for i in range(0, len(batch), step):
            q = x[batch[i : i + step]]
            led = above.descend(q, 0) if above else np.zeros((len(q), 1), np.int64)
            # the first place led to whose node has entered; the first node otherwise
            ok = (led >= 0) & (led < done)
            entry = np.where(ok.any(1), led[np.arange(len(q)), ok.argmax(1)], 0)[:, None]
            found[i : i + step], _ = beam(x[:done], near[:done], q, entry, max(ef, degree))
        own = _nearest(x[batch], x[batch], degree // 2, True)
        own = np.where(own >= 0, own + done, -1)
        _link(x, near, batch, np.concatenate([found, own], 1))
        done += len(batch)
    return near


def _nearest(q: np.ndarray, x: np.ndarray, k: int, same: bool) -> np.ndarray:
    s = q @ x.T
    if same:
        np.fill_diagonal(s, -np.inf)
    k = min(k, s.shape[1] - same)
    if k <= 0:
        return np.full((len(q), 1), -1, np.int64)
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def _prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` candidates of each node, nearest first, passing over those nearer to a chosen one than to the node;
    places left go to the nearest that were passed over."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == node[:, None]] = -1
    s = np.where(cand >= 0, np.einsum("nkd,nd->nk", x[np.maximum(cand, 0)], x[node]), -np.inf)
    order = np.argsort(-s, 1, kind="stable")[:, : 3 * degree]
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    v = x[np.maximum(cand, 0)]
    between = np.einsum("nkd,njd->nkj", v, v)
    keep = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        closer = (keep & (between[:, j, :] > s[:, j : j + 1])).any(1)
        keep[:, j] = (cand[:, j] >= 0) & ~closer & (keep.sum(1) < degree)
    rank = np.argsort(np.where(keep, 0, np.where(cand >= 0, 1, 2)), 1, kind="stable")[:, :degree]
    out = np.take_along_axis(cand, rank, 1)
    if out.shape[1] < degree:
        out = np.concatenate([out, np.full((len(out), degree - out.shape[1]), -1, np.int64)], 1)
    return out


def _link(x: np.ndarray, near: np.ndarray, nodes: np.ndarray, cand: np.ndarray) -> None:
    degree = near.shape[1]
    for i in range(0, len(nodes), 256):
        near[nodes[i : i + 256]] = _prune(x, nodes[i : i + 256], cand[i : i + 256].copy(), degree)
    src = np.repeat(nodes, degree)
    dst = near[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.lexsort((-np.einsum("nd,nd->n", x[src], x[dst]), dst))
    src, dst = src[order], dst[order]
    first = np.r_[0, np.flatnonzero(np.diff(dst)) + 1] if len(dst) else np.empty(0, np.int64)
    place = np.arange(len(dst)) - np.repeat(first, np.diff(np.r_[first, len(dst)]))
    ok = place < degree
    to, inverse = np.unique(dst[ok], return_inverse=True)
    back = np.full((len(to), degree), -1, np.int64)
    back[inverse, place[ok]] = src[ok]
    for i in range(0, len(to), 256):
        t = to[i : i + 256]
        near[t] = _prune(x, t, np.concatenate([near[t], back[i : i + 256]], 1), degree)
