"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

1. Vectors are checked, scaled to unit length and stored with 21 bits a number.
2. Vectors of which there are very many exact copies (:func:`_copies_limit`) are searched
   once: the smallest key stands for the group.
3. A tree of centroids is fitted on a bounded sample (:data:`SAMPLE_PER_CELL` rows a
   cell); the number of cells grows in proportion to the rows (:data:`CELL_ROWS` each).
   Every row is indexed in its nearest cell.
4. A row visits its own cell and those cells whose border is nearer than ``margin`` (at
   most ``max_probes``).  A visit serves both sides: what a row finds there also counts
   as found by the rows it meets, so a pair is lost only if both its rows lie farther
   than ``margin`` from the border.
5. A cell is cut into small cells by the same rule, with the margin ``inner``.  There a base row is the packed sign
   bits of its rotated residual and three correction scalars.  A visitor's inner product
   with it is estimated from the bits, with an error bound; only rows whose upper bound
   reaches the least similarity asked for and the k-th best known so far of either side
   are reranked, with the stored vectors.
6. The k best over all cells are merged, copies are put back.

The whole set of cells is broadcast, at most :data:`MAX_CELLS` rows.  Of more rows than
so many cells may hold, regions are made first by the same routing; they are written
to the shared folder and searched one after the other.

Cells that the sample shows to be larger than :data:`BLOCK_ROWS` are split into blocks;
a visitor goes to every block, so no row is dropped.

Defined results: rows whose vector is null, of another length, with a null or a number
that is not finite, or all zero take no part.  Ties go to the smaller key.  A vector with
more exact copies than the limit has the smallest other keys among them as neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import Scratch

CELL_ROWS = 32768
SMALL_ROWS = 512
MAX_CELLS = 16384
#: Up to so many cells the tree has one level; beyond, a row looks at the cells of its nearest ROOTS roots.
ONE_LEVEL = 1024
ROOTS = 12
SAMPLE_PER_CELL = 32
BLOCK_ROWS = 65536
CHUNK = 1024
EPSILON = 2.5  # width of the error bound in deviations
_SEED = 20240229
_TOP = (1 << 20) - 1
_ROUTED = "cell int, block int, role int, k long, v binary"


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary array of one width."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _bytes(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The reverse of :func:`_binary`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), np.uint8)
    start = int(np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + len(column) * width].reshape(len(column), width)


def _pack(unit: np.ndarray) -> np.ndarray:
    """A 32-bit scale, the greatest number, and three numbers of 21 bits in every eight bytes: an error of some 1e-7 in a similarity."""
    n, dim = unit.shape
    scale = np.maximum(np.abs(unit).max(axis=1, initial=0), 1e-30).astype(np.float32)
    whole = np.zeros((n, _words(dim), 3), dtype=np.int64)
    whole.reshape(n, 3 * _words(dim))[:, :dim] = np.rint(unit / scale[:, None] * _TOP) + _TOP
    words = whole[..., 0] | whole[..., 1] << 21 | whole[..., 2] << 42
    return np.concatenate((scale[:, None].view(np.uint8), words.view(np.uint8).reshape(n, 8 * _words(dim))), axis=1)


def _unpack(rows: np.ndarray, dim: int) -> np.ndarray:
    scale = np.ascontiguousarray(rows[:, :4]).view(np.float32)
    words = np.ascontiguousarray(rows[:, 4:]).view(np.int64)
    whole = np.stack([words >> shift & (1 << 21) - 1 for shift in (0, 21, 42)], axis=2).reshape(len(rows), 3 * _words(dim))[:, :dim]
    return (whole - _TOP).astype(np.float32) * (scale / np.float32(_TOP))


def _words(dim: int) -> int:
    return -(-dim // 3)


def _width(dim: int) -> int:
    return 4 + 8 * _words(dim)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return _unpack(_bytes(column, _width(dim)), dim)


def _prepare(dim: int, vectors: bool):
    """``(k, g1, g2[, v])`` of usable rows: two digests of the vector as stored, and the unit vector."""
    mixers = np.random.default_rng(_SEED + 1).integers(1, 1 << 62, size=(2, dim), dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(lengths == dim)
            if not len(right):
                continue
            values = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            norm = np.sqrt(np.einsum("ij,ij->i", values, values))
            good = np.isfinite(values).all(axis=1) & np.isfinite(norm) & (norm > 0)
            values, norm, right = values[good], norm[good], right[good]
            bits = (values.astype(np.float32) + np.float32(0)).view(np.int32).astype(np.int64)
            with np.errstate(over="ignore"):
                marks = [(bits * m).sum(axis=1) ^ ((bits * m) >> 29).sum(axis=1) for m in mixers]
            columns = [b.column(0).take(pa.array(right)), pa.array(marks[0]), pa.array(marks[1])]
            if vectors:
                columns.append(_binary(_pack(values / norm[:, None])))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "g1", "g2", "v"][: len(columns)])

    return run


def _nearest_center(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers**2).sum(axis=1)
    return np.concatenate([np.argmax(p @ centers.T - half, axis=1) for p in np.array_split(rows, max(1, len(rows) // 4096))])


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds on the sample; a cell that loses all rows is moved to a row of the largest cell."""
    rng = np.random.default_rng(_SEED + 2)
    cells = max(1, min(cells, len(sample)))
    centers = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest_center(sample, centers)
        sizes = np.bincount(own, minlength=cells)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(np.concatenate(([-1], own[order]))))
        centers[np.unique(own)] = np.add.reduceat(sample[order], starts, axis=0) / sizes[sizes > 0][:, None]
        for empty in np.flatnonzero(sizes == 0):
            members = np.flatnonzero(own == int(np.argmax(sizes)))
            centers[empty] = sample[rng.choice(members)]
    return centers.astype(np.float32)


@dataclass
class Tree:
    """Cells with their centers; ``first`` are the places where each root's cells start; ``blocks`` are the parts of each cell."""

    roots: np.ndarray
    first: np.ndarray
    centers: np.ndarray
    blocks: np.ndarray

    def near(self, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` nearest cells of each row, nearest first, and their squared distances less 1."""
        square = (self.centers**2).sum(axis=1)
        most = min(most, len(self.centers))
        if len(self.roots) == 1:
            far = square - 2 * (rows @ self.centers.T)
            at = np.argpartition(far, most - 1, axis=1)[:, :most] if most < far.shape[1] else np.broadcast_to(np.arange(most), far.shape)
            dist = np.take_along_axis(far, at, axis=1)
        else:
            width = min(ROOTS, len(self.roots))
            up = (self.roots**2).sum(axis=1) - 2 * (rows @ self.roots.T)
            chosen = np.argpartition(up, width - 1, axis=1)[:, :width]
            at = np.zeros((len(rows), width, most), dtype=np.int64)
            dist = np.full((len(rows), width, most), np.inf, dtype=np.float32)
            for r in np.unique(chosen):
                i, slot = np.nonzero(chosen == r)
                low, high = self.first[r], self.first[r + 1]
                far = square[low:high] - 2 * (rows[i] @ self.centers[low:high].T)
                n = min(most, high - low)
                here = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.broadcast_to(np.arange(n), far.shape)
                dist[i, slot, :n] = np.take_along_axis(far, here, axis=1)
                at[i, slot, :n] = here + low
            at, dist = at.reshape(len(rows), -1), dist.reshape(len(rows), -1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(dist, order, axis=1)


def _within(near: np.ndarray, dist: np.ndarray, centers: np.ndarray, margin: float | None) -> np.ndarray:
    """Which of the near cells have their border nearer than ``margin``; the nearest cell always counts."""
    if margin is None:
        return np.isfinite(dist)
    gap = centers[near]
    gap -= gap[:, :1].copy()
    gap = np.sqrt(np.maximum(np.einsum("ijk,ijk->ij", gap, gap), 1e-12))
    return np.isfinite(dist) & (dist - dist[:, :1] <= 2 * margin * gap)


def _route(tree, margin: float | None, max_probes: int):
    """Rows ``(cell, block, role, k, v)``.  Role 0 is a base row that also asks, 1 a base row that does not, 2 a visitor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tree.value
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                role, keys = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                dim = t.centers.shape[1]
                raw = _bytes(part.column(2), _width(dim))
                u = _unpack(raw, dim)
                near, dist = t.near(u, max_probes)
                own = near[:, 0]
                spread = (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> np.int64(40)) & np.int64(0xFFFFFF)
                home = spread % t.blocks[own]
                base = role != 2
                if base.any():
                    yield _rows(own[base], home[base], role[base], keys[base], raw[base])
                take = _within(near, dist, t.centers, margin) & (role != 1)[:, None]
                i, j = np.nonzero(take)
                cell = near[i, j]
                n = t.blocks[cell]
                i, cell = np.repeat(i, n), np.repeat(cell, n)
                block = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                away = ~(base[i] & (cell == own[i]) & (block == home[i]))
                i, cell, block = i[away], cell[away], block[away]
                if len(i):
                    yield _rows(cell, block, np.full(len(i), 2), keys[i], raw[i])

    return run


def _rows(cell, block, role, keys, vectors: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (cell, block, role)), pa.array(keys.astype(np.int64)), _binary(vectors)], names=["cell", "block", "role", "k", "v"])


class _Best:
    """The k best partners so far of each of ``n`` rows, better ones first; equal ones by key."""

    def __init__(self, n: int, k: int):
        self.sims, self.keys = np.full((n, k), -np.inf, dtype=np.float32), np.full((n, k), -1, dtype=np.int64)

    def add(self, at: np.ndarray, keys: np.ndarray, sims: np.ndarray) -> None:
        if not len(at):
            return
        k = self.sims.shape[1]
        rows = np.unique(at)
        held = self.keys[rows] >= 0
        at = np.concatenate((at, np.repeat(rows, k)[held.ravel()]))
        keys, sims = np.concatenate((keys, self.keys[rows][held])), np.concatenate((sims, self.sims[rows][held]))
        order = np.lexsort((keys, -sims, at))
        at, keys, sims = at[order], keys[order], sims[order]
        fresh = np.append(True, (at[1:] != at[:-1]) | (keys[1:] != keys[:-1]))
        at, keys, sims = at[fresh], keys[fresh], sims[fresh]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        kept = rank < k
        self.sims[rows], self.keys[rows] = -np.inf, -1
        self.sims[at[kept], rank[kept]], self.keys[at[kept], rank[kept]] = sims[kept], keys[kept]

    def floor(self, at: np.ndarray | slice, least: float) -> np.ndarray:
        """What a partner must reach to count."""
        return np.maximum(self.sims[at, -1], np.float32(least))

    def batch(self, owners: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(self.keys >= 0)
        return pa.RecordBatch.from_arrays([pa.array(owners[i]), pa.array(self.keys[i, j]), pa.array(self.sims[i, j].astype(np.float64))], names=["a", "b", "s"])


class _Block:
    """The base rows of one block of a cell, in small cells, with their codes."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, asks: np.ndarray, turn: np.ndarray, k: int, least: float, margin: float | None, max_probes: int, both: bool):
        order = np.argsort(keys, kind="stable")
        self.k, self.least, self.margin, self.probes, self.both, self.turn = k, least, margin, max_probes, both, turn
        dim = vectors.shape[1]
        keys, x, asks = keys[order], vectors[order], asks[order]
        small = max(1, len(x) // SMALL_ROWS)
        drawn = x[np.linspace(0, len(x) - 1, min(len(x), small * SAMPLE_PER_CELL)).astype(np.int64)]
        self.centers = fit_centroids(drawn, small, rounds=4)
        own = _nearest_center(x, self.centers)
        order = np.argsort(own, kind="stable")
        self.keys, self.x, self.asks = keys[order], x[order], asks[order]
        own = own[order]
        self.first = np.searchsorted(own, np.arange(len(self.centers) + 1))
        self.tree = Tree(self.centers[:1], np.array([0, len(self.centers)]), self.centers, np.ones(len(self.centers), np.int64))
        # sign bits of the rotated residual, its length, its inner product with its code, and the part of the similarity that no visitor changes
        residual = self.x - self.centers[own]
        rho = np.sqrt(np.einsum("ij,ij->i", residual, residual))
        turned = residual @ turn
        self.codes = np.packbits(turned > 0, axis=1)
        fit = np.maximum(np.abs(turned).sum(axis=1) / np.maximum(rho, 1e-12) / np.sqrt(dim), 1e-3)
        self.fixed = np.einsum("ij,ij->i", residual, self.centers[own])
        self.weight = rho / (np.sqrt(dim) * fit)
        self.width = EPSILON * rho * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(dim - 1) + 1e-6
        self.best = _Best(len(self.x), k)

    def ask(self, keys: np.ndarray, q: np.ndarray, places: np.ndarray | None = None) -> _Best:
        """What ``q`` finds here; ``places`` are the rows' places if they are base rows.  With ``both``, base rows take up what they are found by."""
        best = self.best if places is not None else _Best(len(q), self.k)
        places = np.arange(len(q)) if places is None else places
        near, dist = self.tree.near(q, self.probes)
        i, j = np.nonzero(_within(near, dist, self.centers, self.margin))
        cell = near[i, j]
        order = np.argsort(cell, kind="stable")
        i, cell = i[order], cell[order]
        turned = q @ self.turn
        edges = np.searchsorted(cell, np.arange(len(self.centers) + 1))
        for c in range(len(self.centers)):
            for s in range(edges[c], edges[c + 1], CHUNK):
                at = i[s : min(s + CHUNK, edges[c + 1])]
                self._visit(c, at, keys, q, turned, places, best)
        return best

    def _visit(self, c: int, at: np.ndarray, keys: np.ndarray, q: np.ndarray, turned: np.ndarray, places: np.ndarray, best: _Best) -> None:
        low, high = self.first[c], self.first[c + 1]
        if low == high:
            return
        rows, k, center = slice(low, high), self.k, self.centers[c]
        signs = np.unpackbits(self.codes[rows], axis=1, count=q.shape[1]).astype(np.float32) * 2 - 1
        # estimate and bound of all pairs in one product: code, part of the visitor alone, part of the base row alone, width of the bound
        shifted = q[at] - center
        length = np.sqrt(np.einsum("ij,ij->i", shifted, shifted))
        one = np.ones(max(len(at), high - low), np.float32)
        asks = np.column_stack((turned[at] - center @ self.turn, q[at] @ center, one[: len(at)], length))
        held = np.column_stack((signs * self.weight[rows, None], one[: high - low], self.fixed[rows], self.width[rows]))
        upper = asks @ held.T
        mine, theirs = best.floor(places[at], self.least), self.best.floor(rows, self.least)
        hit = upper >= mine[:, None]
        if self.both:
            hit |= upper >= theirs
        if np.count_nonzero(hit) > 8 * k * len(at):  # many: the k-th best lower bounds of either side spare most
            held[:, -1] *= -1
            lower = asks @ held.T
            if high - low > k + 1:  # k + 1: the row itself may be among them
                mine = np.maximum(mine, np.partition(lower, high - low - k - 1, axis=1)[:, high - low - k - 1])
            hit = upper >= mine[:, None]
            if self.both:
                if len(at) > k + 1:
                    theirs = np.maximum(theirs, np.partition(lower, len(at) - k - 1, axis=0)[len(at) - k - 1])
                hit |= upper >= theirs
        i, j = np.nonzero(hit)
        other = keys[at[i]] != self.keys[low + j]
        i, j = i[other], j[other]
        sims = np.concatenate([np.einsum("ij,ij->i", q[at[i[s : s + 200_000]]], self.x[low + j[s : s + 200_000]]) for s in range(0, max(len(i), 1), 200_000)])
        enough = sims >= self.least
        i, j, sims = at[i[enough]], j[enough] + low, sims[enough]
        best.add(places[i], self.keys[j], sims)
        if self.both:
            self.best.add(j, keys[i], sims)


def _search(turn: np.ndarray, k: int, least: float, margin: float | None, max_probes: int, both: bool):
    """Search each block of each cell: base rows come first, visitors are taken in portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(turn)
        at, heap, block = None, [], None

        def close():
            keys, vectors, roles = (np.concatenate(p) for p in zip(*heap))
            made = _Block(keys, vectors, roles == 0, turn, k, least, margin, max_probes, both)
            asking = np.flatnonzero(made.asks)
            for s in range(0, len(asking), CHUNK * 4):
                p = asking[s : s + CHUNK * 4]
                made.ask(made.keys[p], made.x[p], p)
            return made

        for batch in batches:
            cell, part, role, keys = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "block", "role", "k"))
            vectors = _vectors(batch.column("v"), dim)
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff((role == 2).astype(np.int8)) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(cell)]):
                if s == e:
                    continue
                here = (int(cell[s]), int(part[s]))
                if here != at:
                    if heap:
                        block = close()
                    if block is not None:
                        yield block.best.batch(block.keys)
                    at, heap, block = here, [], None
                if role[s] != 2:
                    heap.append((keys[s:e], vectors[s:e], role[s:e]))
                    continue
                if heap:
                    block, heap = close(), []
                if block is not None:
                    for p in range(s, e, CHUNK * 4):
                        q = slice(p, min(p + CHUNK * 4, e))
                        yield block.ask(keys[q], vectors[q]).batch(keys[q])
        if heap:
            block = close()
        if block is not None:
            yield block.best.batch(block.keys)

    return run


def _fit_leaves(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells below each root from its sample rows, which come together."""
        for root, vectors in _by_root(batches, dim):
            fitted = fit_centroids(vectors, max(1, round(len(vectors) / SAMPLE_PER_CELL)))
            shown = np.bincount(_nearest_center(vectors, fitted), minlength=len(fitted))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fitted), root, np.int32)), pa.array(shown.astype(np.int64)), _binary(fitted)], names=["root", "shown", "center"])

    return run


def _by_root(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray]]:
    at, heap = None, []
    for b in batches:
        if not b.num_rows:
            continue
        roots = b.column("root").to_numpy(zero_copy_only=False)
        rows = _vectors(b.column("v"), dim)
        edges = np.flatnonzero(np.diff(roots)) + 1
        for s, e in zip([0, *edges], [*edges, len(roots)]):
            if roots[s] != at and heap:
                yield at, np.concatenate(heap)
                heap = []
            at = int(roots[s])
            heap.append(rows[s:e].copy())
    if heap:
        yield at, np.concatenate(heap)


def _fit_tree(rows: DataFrame, total: int, cells: int, dim: int) -> Tree:
    """Fitted on rows drawn by a digest of their keys: ``SAMPLE_PER_CELL`` a cell, of which the driver gets those of one level and the centers."""
    lot = F.pmod(F.xxhash64("k"), F.lit(1 << 30))

    def draw(want: int, *columns) -> DataFrame:
        return rows.where(lot < int(min(1.0, 1.3 * want / max(total, 1)) * (1 << 30))).select("v", *columns)

    one = cells <= ONE_LEVEL
    want = SAMPLE_PER_CELL * (cells if one else int(np.ceil(np.sqrt(cells))))
    drawn = draw(want, lot.alias("lot")).orderBy("lot").limit(want).toArrow()
    sample = _vectors(drawn["v"], dim) if drawn.num_rows else np.zeros((1, dim), np.float32)
    fitted = fit_centroids(sample, cells if one else want // SAMPLE_PER_CELL)
    if one:
        shown = np.bincount(_nearest_center(sample, fitted), minlength=len(fitted)) / max(len(sample), 1)
        roots, first = fitted[:1], np.array([0, len(fitted)])
    else:
        held = rows.sparkSession.sparkContext.broadcast(fitted)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(_nearest_center(_vectors(b.column(0), dim), held.value).astype(np.int32)), b.column(0)], names=["root", "v"])

        placed = draw(SAMPLE_PER_CELL * cells).mapInArrow(place, "root int, v binary").repartition("root").sortWithinPartitions("root", "v")
        got = placed.mapInArrow(_fit_leaves(dim), "root int, shown long, center binary").toArrow()
        order = np.argsort(got["root"].to_numpy(), kind="stable")
        root, shown = got["root"].to_numpy()[order], got["shown"].to_numpy()[order]
        present = np.unique(root)
        roots, first = fitted[present], np.append(np.searchsorted(root, present), len(root))
        fitted, shown = _bytes(got["center"], 4 * dim).view(np.float32)[order], shown / max(shown.sum(), 1)
    return Tree(roots, first, fitted, np.maximum(1, np.ceil(shown * total / BLOCK_ROWS)).astype(np.int64))


def _copies_limit(total: int, k: int) -> int:
    """A vector with more exact copies than this is searched once; so there are at most a million of such vectors, which are broadcast."""
    return max(16, k + 1, -(-total // 1_000_000))


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, least: float = -1.0, dim: int = 64, margin: float | None = 0.1, inner: float | None = 0.12, max_probes: int = 16, every_query: int = 1) -> DataFrame:
    """``(a, b, similarity, rank)``: for each row ``a`` whose key is divisible by ``every_query`` its ``k`` most similar rows of at least ``least``.

    ``margin`` holds for cells, ``inner`` for the small cells in them; both suit searches
    of all rows.  With ``None`` as ``margin`` each query goes to its ``max_probes``
    nearest cells and, in each, to as many small cells.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "knn")
    slim = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<float>"))
    marks = scratch.save(slim.mapInArrow(_prepare(dim, False), "k long, g1 long, g2 long"), "marks")
    total = marks.count()
    hot = marks.groupBy("g1", "g2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > _copies_limit(total, k)).drop("n")
    hot = scratch.save(hot, "hot")  # at most a million rows
    members = marks.join(F.broadcast(hot), ["g1", "g2"]).select("k", "rep")
    prepared = slim.mapInArrow(_prepare(dim, True), "k long, g1 long, g2 long, v binary")
    single = prepared.join(F.broadcast(hot), ["g1", "g2"], "left").where("rep is null or k = rep")
    rows = single.select(F.when(F.col("k") % every_query == 0, 0).otherwise(1).alias("role"), "k", "v")
    both = every_query == 1
    cells = max(1, -(-total // CELL_ROWS))
    turn = rotation(dim)

    def hits_of(part: DataFrame, held: int, label: str) -> DataFrame:
        tree = _fit_tree(part, held, max(1, -(-held // CELL_ROWS)), dim)
        tasks = 2 * int(tree.blocks.sum())  # a task holds few cells, however many there are
        sent = part.select("role", "k", "v").mapInArrow(_route(spark.sparkContext.broadcast(tree), margin, max_probes), _ROUTED)  # at most about MAX_CELLS rows
        placed = sent.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", F.col("role") == 2)
        return scratch.save(placed.mapInArrow(_search(turn, k, least, None if margin is None else inner, max_probes, both), "a long, b long, s double"), f"hits{label}")

    if cells <= MAX_CELLS:
        hits = hits_of(rows, total, "")
    else:
        tree = _fit_tree(rows, total, -(-2 * cells // MAX_CELLS), dim)
        tree.blocks[:] = 1
        routed = rows.mapInArrow(_route(spark.sparkContext.broadcast(tree), margin, max_probes), _ROUTED)
        path = f"{scratch.path}/regions"
        routed.write.partitionBy("cell").parquet(path)
        found = []
        for cell in range(len(tree.centers)):
            part = spark.read.schema("block int, role int, k long, v binary, cell int").parquet(path).where(F.col("cell") == cell)
            held = part.where("role <> 2").count()
            if held:
                found.append(hits_of(part, held, str(cell)))
        hits = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "a long, b long, s double")

    # put the hot copies back: the first of them beside the rows that found their group, and beside each other
    first = members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("k"))).where(f"rn <= {k + 1}")
    first = scratch.save(first.select(F.col("rep").alias("f_rep"), F.col("k").alias("f_k")), "first")
    asking = hits.join(F.broadcast(hot.select(F.col("rep").alias("h_rep"))), F.col("a") == F.col("h_rep"), "left_anti")
    wide = asking.join(first, F.col("b") == F.col("f_rep"), "left").select("a", F.coalesce("f_k", "b").alias("b"), "s")
    among = members.join(first, (F.col("rep") == F.col("f_rep")) & (F.col("k") != F.col("f_k"))).select(F.col("k").alias("a"), F.col("f_k").alias("b"), F.lit(1.0).alias("s"))
    every = wide.unionByName(among).where(f"a % {every_query} = 0")
    once = every.repartition("a").groupBy("a", "b").agg(F.max("s").alias("s"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))).where(f"rank <= {k}")
    return ranked.select("a", "b", F.col("s").alias("similarity"), "rank")


def similar_pairs(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.9, **how) -> DataFrame:
    """``(a, b)``, the smaller key first: at least one row is among the other's ``k`` most similar, and the similarity is at least ``least``."""
    found = nearest(df, key, vector, k, least, **how)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
