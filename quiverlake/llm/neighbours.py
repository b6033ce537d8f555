"""Most similar embeddings for every vector, by cells around centres or by shifted space-filling curves.

With a floor of the cosine that tells the alike from the others (``dense`` or more), rows are compared in full in
:class:`Cells` around centres, cut into parts that many tasks share.

Without one, every vector is projected several times to a few dimensions and placed on a Hilbert curve of
the projection. Each ordering is range-partitioned and sorted in Spark; a task streams along
its stretch of the curve and compares each block of rows with itself and the blocks beside
it. Inside a large dense group a curve tells little about who is nearest, so the members of such
groups are also compared in full, cut into cells that many tasks share. The candidates of all
merge by id and the best ``k`` remain. Work per row is a constant (orderings x window), whatever
the number of rows, and inside a large dense group grows with the group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import from_binary, live_embeddings, to_binary, unit, usable

FOUND = "id string, found array<struct<s: double, id: string>>"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer cells (rows x dims, each below 2**bits).

    The coordinates are turned into the curve's transposed form and its bits interleaved.
    """
    n, dims = cells.shape
    x = [cells[:, i].astype(np.int64) for i in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Curves:
    """Projections, shifts and partition bounds, fitted on a bounded sample of the embeddings.

    The sample sets only directions, scales and where to cut the ranges; every row is placed
    and searched. Keys are taken of directions rounded to ``places`` decimals, so copies of a
    vector, also scaled ones, share a key.
    """

    def __init__(self, sample: np.ndarray, dim: int, orderings: int, parts: int, dims: int = 6, bits: int = 10, spread: int = 24, seed: int = 7, places: int = 4):
        rng = np.random.default_rng(seed)
        self.orderings, self.bits, self.dims, self.places = orderings, bits, dims, places
        if len(sample) < 2:
            sample = rng.normal(size=(256, dim))
        u = np.round(unit(sample), places)
        mean = u.mean(axis=0)
        values, axes = np.linalg.eigh(np.cov((u - mean).T))
        axes = axes[:, ::-1][:, : max(dims, min(spread, dim))]
        self.mean, self.bases, self.knots, self.shifts, self.cuts = mean, [], [], [], []
        for _ in range(orderings):
            turn, _r = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
            base = axes @ turn[:, :dims]
            p = (u - mean) @ base
            self.bases.append(base)
            self.knots.append(np.quantile(p, np.linspace(0, 1, 257)[1:-1], axis=0))
            self.shifts.append(rng.random(dims) * 0.5)
        for o in range(orderings):
            keys = np.sort(self.keys(u, o))
            at = np.linspace(0, len(keys), parts + 1)[1:-1].astype(int)
            self.cuts.append(np.unique(keys[at]) if len(at) else np.empty(0, np.int64))

    def keys(self, u: np.ndarray, o: int) -> np.ndarray:
        p = (u - self.mean) @ self.bases[o]
        top = (1 << self.bits) - 1
        cells = np.empty(p.shape, np.int64)
        for i in range(self.dims):
            grid = self.knots[o][:, i]
            at = np.interp(p[:, i], grid, np.linspace(0, 1, len(grid)))  # even mass along every axis
            cells[:, i] = ((at * 0.5 + self.shifts[o][i]) * top).astype(np.int64)
        return hilbert_keys(cells, self.bits)

    def part(self, keys: np.ndarray, o: int) -> np.ndarray:
        return np.searchsorted(self.cuts[o], keys, side="right")


class DenseGroups:
    """Balls (cosine to a centre at least ``dense``) that hold about ``least`` rows or more, cut into cells for full comparison.

    The sample shows where the balls are and about how large; every row of the table is placed. A
    ball of more than ``rows`` rows is cut into chunks by a hash of the direction, so that copies stay
    together. A cell holds two chunks and compares them with each other; one cell of each chunk,
    its owner, also compares it with itself.
    """

    def __init__(self, sample: np.ndarray, total: int, least: int, rows: int = 16_384, dense: float = 0.84, places: int = 4, seed: int = 5):
        self.dense, self.places, self.chunks, self.cells, self.owned, centers = dense, places, [], [], [], []
        if len(sample) and total >= least:
            u = unit(sample).astype(np.float32)
            near = np.concatenate([(u[i : i + 1024] @ u.T >= dense).sum(axis=1) for i in range(0, len(u), 1024)])
            share = len(u) / total
            left = near >= max(8, 0.8 * least * share)
            while left.any():
                pivot = int(np.where(left, near, -1).argmax())
                c = u[pivot]
                for _ in range(3):
                    c = u[u @ c >= dense].sum(axis=0)
                    c /= np.linalg.norm(c)
                inside = u @ c >= dense
                left &= ~inside
                left[pivot] = False
                centers.append(c)
                self._cut(max(1, -int(-inside.sum() / share // rows)))
        self.centers = np.array(centers, np.float32)
        self.mix = np.random.default_rng(seed).integers(0, 2**63, sample.shape[1] if sample.ndim > 1 else 0, np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def everything(cls, total: int, dim: int, rows: int = 16_384) -> DenseGroups:
        """One group of all rows: every pair of rows shares a cell, so that the search is exact."""
        all_rows = cls(np.empty((0, dim)), 0, 1)
        all_rows.dense, all_rows.centers = -2.0, np.zeros((1, dim), np.float32)
        all_rows._cut(max(1, -(-total // rows)))
        return all_rows

    def _cut(self, n: int) -> None:
        """Cells of one more group with ``n`` chunks; ``chunks[group][chunk]`` are the cells of a chunk."""
        pairs = [(0, 0)] if n == 1 else [(i, j) for j in range(n) for i in range(j)]
        at = {p: len(self.cells) + i for i, p in enumerate(pairs)}
        self.cells += [n] * len(pairs)
        owner = [at[min(i, (i + 1) % n), max(i, (i + 1) % n)] for i in range(n)]
        self.owned += [{i for i in p if owner[i] == at[p]} for p in pairs]
        self.chunks.append([[c for p, c in at.items() if i in p] for i in range(n)])

    def keys(self, u: np.ndarray) -> np.ndarray:
        """Hashes below 2**63 of directions rounded to ``places`` decimals."""
        whole = np.rint(u * 10**self.places).astype(np.int64).astype(np.uint64)
        return ((whole * self.mix).sum(axis=1, dtype=np.uint64) >> np.uint64(1)).astype(np.int64)

    def place(self, u: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows, keys) of directions rounded to ``places`` decimals; keys order a cell by chunk."""
        if not len(self.centers):
            return
        inside = u.astype(np.float32) @ self.centers.T >= self.dense
        some = np.flatnonzero(inside.any(axis=1))
        if not len(some):
            return
        keys = self.keys(u[some])
        for g, cells in enumerate(self.chunks):
            member = inside[some, g]
            chunk = chunk_of(keys, len(cells))
            for i, at in enumerate(cells):
                rows = np.flatnonzero(member & (chunk == i))
                if len(rows):
                    for cell in at:
                        yield cell, some[rows], keys[rows]


def chunk_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Chunk 0..n-1 of keys below 2**63, in the order of the keys."""
    return (keys >> 32) * n >> 31


class Cells(DenseGroups):
    """Cells around at most ``most`` centres, where rows meet all rows whose cosine to them is at least ``floor``.

    A row is settled if its cosine to its nearest centre is at least ``near``. Every row goes to all centres within the
    angle of ``near`` plus that of ``floor``, so a settled row meets all rows alike it in its centre's cell. A row that
    isn't settled, of a small group or alone, goes to its ``spread`` nearest centres besides; two of these meet if they
    share one. Centres are the densest places of the sample first, then rows far from them; up to ``whole`` rows there is one.

    Cells are cut into chunks like dense groups, so large ones that a row's copies stay below about ``copies`` on average,
    as long as a chunk then has at most ``most_rows`` rows. ``tasks``: the task of each cell, by their expected costs.
    """

    def __init__(self, sample: np.ndarray, total: int, floor: float, near: float = 0.9, spread: int = 6, most: int = 4096, rows_per_center: int = 256, whole: int = 8192, rows: int = 16_384, most_rows: int = 131_072, copies: float = 0.75, task_bytes: float = 6e6, dense: float = 0.84):
        super().__init__(sample[:0], 0, 1)
        dim = sample.shape[1]
        self.near, self.spread = np.float32(near), spread
        self.wide = np.float32(np.cos(min(np.pi, np.arccos(near) + np.arccos(min(1.0, floor)))) - 1e-3)
        self.centers = np.zeros((1, dim), np.float32)
        if total > whole and len(sample):
            self._center(unit(sample).astype(np.float32), min(most, total // rows_per_center), dense)
        row, at = self._members(unit(sample).astype(np.float32)) if len(sample) else (np.empty(0, int), np.empty(0, int))
        expected = np.maximum(1, np.bincount(at, minlength=len(self.centers))) * max(1.0, total / max(1, len(sample)))
        size = min(most_rows, max(rows, (expected**2).sum() / max(1, total) / copies))
        for n in expected:
            self._cut(max(1, int(-(-n // size))))
        several = np.array([len(c) for c in self.chunks])
        self.first = np.concatenate([[0], np.cumsum(several)])  # of each centre's chunks
        lists = [np.array(cells) for chunks in self.chunks for cells in chunks]
        self.starts, self.flat = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists)
        held = np.concatenate([np.full(max(1, n * (n - 1) // 2), e * min(2, n) / n) for n, e in zip(several.tolist(), expected)])
        self.n_tasks = max(1, min(len(held), int(-(-held.sum() * (4 * dim + 48) // task_bytes))))
        self.tasks, cost, loads = np.empty(len(held), np.int32), held**2 + 4096 * held, [(0.0, i) for i in range(self.n_tasks)]
        for c in np.argsort(-cost, kind="stable"):
            load, i = heapq.heappop(loads)
            self.tasks[c] = i
            heapq.heappush(loads, (load + cost[c], i))

    def _center(self, u: np.ndarray, most: int, dense: float) -> None:
        near = np.concatenate([(u[i : i + 1024] @ u.T >= dense).sum(axis=1) for i in range(0, len(u), 1024)])
        left, centers = np.ones(len(u), bool), []
        for pivot in np.argsort(-near, kind="stable"):
            if not left[pivot]:
                continue
            c = u[pivot]
            for _ in range(2 if near[pivot] > 2 else 0):
                c = u[u @ c >= dense].sum(axis=0)
                c /= np.linalg.norm(c)
            left &= u @ c < dense
            left[pivot] = False
            centers.append(c)
            if len(centers) == most:
                break
        self.centers = np.array(centers, np.float32)

    def _members(self, f: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(row, centre) of every centre a row goes to."""
        out = []
        for i in range(0, len(f), step):
            s = f[i : i + step] @ self.centers.T
            inside = s >= self.wide
            loose = np.flatnonzero(s.max(axis=1) < self.near)
            if s.shape[1] <= self.spread:
                inside[loose] = True
            elif len(loose):
                inside[loose[:, None], np.argpartition(s[loose], -self.spread, axis=1)[:, -self.spread :]] = True
            r, c = np.nonzero(inside)
            out.append((r + i, c))
        return tuple(np.concatenate(x) for x in zip(*out))

    def place_all(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and key of each copy of directions."""
        keys = self.keys(u)
        row, at = self._members(u.astype(np.float32))
        n = np.diff(self.first)[at]
        chunk = self.first[at] + chunk_of(keys[row], n)
        many = np.diff(self.starts)[chunk]
        place = np.repeat(self.starts[chunk] - np.cumsum(many) + many, many) + np.arange(many.sum())
        row = np.repeat(row, many)
        return row, self.flat[place], keys[row]


def _block_candidates(s: np.ndarray, k: int, floor: float | np.ndarray, axis: int = 1, size: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each row (``axis`` 1) or column (0) of ``s`` that can be among its ``k`` largest and reach ``floor`` (of all or of each): (line, place in it).

    The k-th largest of the maxima of groups of entries is a lower bound of the k-th entry. A group is every ``n``-th entry, so
    that maxima are taken along whole rows of memory, and only groups that reach the bound are looked at again.
    """
    n, w = s.shape if axis == 1 else s.shape[::-1]
    groups = w // size
    floors = np.broadcast_to(np.asarray(floor, np.float32), n)
    lines = floors[:, None] if axis == 1 else floors
    if groups <= k:
        i, j = np.nonzero(s >= lines)
        return (i, j) if axis == 1 else (j, i)
    whole = groups * size
    tops = s[:, :whole].reshape(n, size, groups).max(axis=1) if axis == 1 else s[:whole].reshape(size, groups, n).max(axis=0).T
    reach = (tops >= floors[:, None]).sum(axis=1)
    some = np.flatnonzero(reach)
    tops, bound, crowded = tops[some], floors[some], np.flatnonzero(reach[some] > k)
    bound[crowded] = np.maximum(np.partition(tops[crowded], groups - k, axis=1)[:, groups - k] - np.float32(2e-6), bound[crowded])
    r, g = np.nonzero(tops >= bound[:, None])
    at, places = some[r], g[:, None] + np.arange(size) * groups
    p, q = np.nonzero((s[at[:, None], places] if axis == 1 else s[places, at[:, None]]) >= bound[r][:, None])
    out = at[p], places[p, q]
    if whole < w:
        i, j = np.nonzero(s[:, whole:] >= lines) if axis == 1 else np.nonzero(s[whole:].T >= floors[:, None])
        out = np.concatenate([out[0], i]), np.concatenate([out[1], j + whole])
    return out


def _search_stretch(batches: Iterator[pa.RecordBatch], dim: int, k: int, floor: float, block: int, reach: int = 8, dense: float = 0.84, cells: dict[int, tuple[int, set[int]]] | None = None, centers: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Stream one or several sorted stretches; yields ``id, found: list<struct<s, id>>``.

    A block is compared with itself and the one before; and, as long as a sample of the pairs shows that both lie
    in one dense group (a twentieth reach ``dense``), with up to ``reach`` blocks before, since there the order along
    the curve tells little. ``cells``: parts that are compared in full, with their group's number of chunks and the
    chunks they own; ``centers``: of the groups, whose blocks need no comparison elsewhere. Rows of a run of copies beyond the first k+1 ids point to the first k and take no further
    part: the copies' smallest ids come first at equal similarity.
    """
    low = np.float32(floor - 1e-5)

    def best(ids, rows, cols_ids, scores):
        """Best k of each row from (row, other id, score)."""
        scores = np.round(scores, 6)
        keep = scores >= floor
        rows, cols_ids, scores = rows[keep], cols_ids[keep], scores[keep]
        order = np.lexsort((cols_ids, -scores, rows))
        rows, cols_ids, scores = rows[order], cols_ids[order], scores[order]
        first = np.searchsorted(rows, np.arange(len(ids) + 1))
        rank = np.arange(len(rows)) - first[rows]
        keep = rank < k
        return rows[keep], cols_ids[keep], scores[keep]

    def emit(ids, rows, others, scores):
        counts = np.bincount(rows, minlength=len(ids))
        some = np.flatnonzero(counts)
        offsets = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(-scores), pa.array(others, pa.string())], ["s", "id"]))
        return pa.RecordBatch.from_arrays([pa.array(ids[some], pa.string()), found], ["id", "found"])

    def pairs(a, b, own):
        """Candidates among rows of a against b, and of b against a."""
        s = a["f"] @ b["f"].T
        if own:
            np.fill_diagonal(s, -2)
        for left, right, axis in ((a, b, 1),) if own else ((a, b, 1), (b, a, 0)):
            i, j = _block_candidates(s, k, left["low"], axis)
            if len(i):
                left["got"].append((i, right["ids"][j], np.einsum("ij,ij->i", unit(left["x"][i]), unit(right["x"][j]))))
                left["n"] += len(i)
                if left["n"] > 2 * k * len(left["ids"]):
                    settle(left)

    def settle(a):
        """Keep the best k so far of each row of a block; a row that has k looks for better ones only."""
        i, others, s = best(a["ids"], *(np.concatenate(x) for x in zip(*a["got"])))
        full = np.flatnonzero(np.bincount(i, minlength=len(a["ids"])) == k)
        a["low"][full] = np.maximum(low, s[np.searchsorted(i, full, side="right") - 1] - 1e-5)
        a["got"], a["n"] = [(i, others, s)], 0

    def finish(a):
        if a["got"]:
            out = emit(a["ids"], *best(a["ids"], *(np.concatenate(x) for x in zip(*a["got"]))))
            if out.num_rows:
                yield out

    recent: list[dict] = []  # the blocks before, oldest first

    def one_group(a, b):
        x, y = a["f"][:: max(1, len(a["f"]) // 64)], b["f"][:: max(1, len(b["f"]) // 64)]
        return (x @ y.T >= dense).mean() >= 0.05

    def wanted(a, b, back, own):
        """Whether a block is compared with itself or, at ``back``, an earlier one."""
        if own is None:
            return not (a["balls"] & b["balls"]).any() and (not back or one_group(a, b))
        return b["chunks"][0] != a["chunks"][1] or a["chunks"][1] in own

    pend_ids, pend_x, pend_keys, pend_n = [], [], [], 0
    head, head_ids, part = None, [], None

    def flush(final):
        nonlocal pend_ids, pend_x, pend_keys, pend_n
        n, own = (cells or {}).get(int(part), (1, None)) if part is not None else (1, None)
        while pend_n >= block or (final and pend_n):
            ids, x, keys = np.concatenate(pend_ids), np.concatenate(pend_x), np.concatenate(pend_keys)
            a = {"ids": ids[:block].copy(), "x": x[:block].copy(), "got": [], "n": 0}  # not views, which would hold all that is pending
            a["low"] = np.full(len(a["ids"]), low, np.float32)
            a["f"] = unit(a["x"]).astype(np.float32)
            a["balls"] = (a["f"] @ centers.T >= dense + 1e-3).all(axis=0) if centers is not None and len(centers) else np.zeros(0, bool)  # wholly inside, whatever the rounding
            a["chunks"] = chunk_of(keys[:block][[0, -1]], n).tolist()
            pend_ids, pend_x, pend_keys, pend_n = [ids[block:]], [x[block:]], [keys[block:]], max(0, len(ids) - block)
            if wanted(a, a, 0, own):
                pairs(a, a, True)
            for back, b in enumerate(reversed(recent)):
                if wanted(a, b, back, own):
                    pairs(b, a, False)
            recent.append(a)
            if own is None and len(recent) > reach:
                yield from finish(recent.pop(0))
        if final:
            while recent:
                yield from finish(recent.pop(0))

    for batch in batches:
        parts = batch.column("part").to_numpy()
        edges = np.flatnonzero(np.diff(parts)) + 1
        ids_all, keys_all = batch.column("id").to_numpy(zero_copy_only=False), batch.column("key").to_numpy()
        x_all = from_binary(batch.column("vec"), dim)
        u_all = unit(x_all) if batch.num_rows else None
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if a == b:
                continue
            if part is not None and parts[a] != part:
                yield from flush(True)
                head, head_ids = None, []
            part = parts[a]
            ids, u = ids_all[a:b], u_all[a:b]
            before = np.vstack([u[:1] if head is None else head, u[:-1]])
            same = np.abs(u - before).max(axis=1) < 1e-6
            if head is None:
                same[0] = False
            if same.any():
                keep, extra_rows, extra_ids = np.ones(len(ids), bool), [], []
                for i in range(len(ids)):
                    if not same[i]:
                        head_ids = [ids[i]]
                    elif len(head_ids) <= k:
                        head_ids.append(ids[i])
                    else:
                        keep[i] = False
                        extra_rows.append(i)
                        extra_ids.extend(head_ids[:k])
                if extra_rows:
                    rows = np.repeat(np.arange(len(extra_rows)), k)
                    yield emit(ids[extra_rows], rows, np.array(extra_ids, object), np.ones(len(rows)))
                kept_ids, kept_x, kept_keys = ids[keep], x_all[a:b][keep], keys_all[a:b][keep]
            else:
                head_ids = [ids[-1]]
                kept_ids, kept_x, kept_keys = ids, x_all[a:b], keys_all[a:b]
            head = u[-1:]
            pend_ids.append(kept_ids)
            pend_x.append(kept_x)
            pend_keys.append(kept_keys)
            pend_n += len(kept_ids)
            yield from flush(False)
    yield from flush(True)


def nearest(embeddings: DataFrame, *, fit: np.ndarray, total: int, dim: int, k: int = 5, floor: float = -1.0, orderings: int = 3, block: int = 2048, rows_per_part: int = 40_000, seed: int = 7, exact: bool = False, dense: float = 0.84) -> DataFrame:
    """The ``k`` most similar other ids of every id: ``id, found: array<struct<s: -cosine, id>>``.

    ``embeddings``: ``id string, vec binary`` (float32 bytes), one row per id; ``total``: about how many.
    ``fit``: a bounded sample of embeddings for the curves' directions and range bounds; all rows
    are indexed and searched. ``found`` is sorted by cosine (double precision, 6 decimals) and
    then by id. Others under ``floor`` are not reported, and an id with none is left out.
    With a ``floor`` of at least ``dense`` all rows are compared in :class:`Cells`: a pair is found for certain if one of the two
    is near a centre, else if they share one of their nearest centres; groups are compared in full, at a cost that grows with
    the square of their size. With a lower one results are approximate: a neighbour is found if it lies within the window of the
    row in one of the orderings, or in one :class:`DenseGroups` ball with it. With ``exact`` every row is compared with every
    other, in cells spread over the tasks, at a cost that grows with the square of their number. Empty input gives an empty result.
    """
    if floor >= dense and not exact:
        return _nearest_in_cells(embeddings, Cells(fit, total, floor, dense=dense), dim=dim, k=k, floor=floor, block=block)
    parts = max(1, -(-total // rows_per_part))
    orderings = 0 if exact else orderings
    curves = Curves(fit, dim, orderings, parts, seed=seed)
    groups = DenseGroups.everything(total, dim) if exact else DenseGroups(fit, total, 2 * block, places=curves.places)
    stretches_n = orderings * parts
    n_parts = stretches_n + len(groups.cells)
    cells = {stretches_n + i: x for i, x in enumerate(zip(groups.cells, groups.owned))}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = np.round(unit(from_binary(b.column("vec"), dim)), curves.places)
            for o in range(orderings):
                keys = curves.keys(u, o)
                yield pa.RecordBatch.from_arrays([pa.array((o * parts + curves.part(keys, o)).astype(np.int32)), pa.array(keys), b.column("id"), b.column("vec")], ["part", "key", "id", "vec"])
            for cell, rows, keys in groups.place(u):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), stretches_n + cell, np.int32)), pa.array(keys), b.column("id").take(at), b.column("vec").take(at)], ["part", "key", "id", "vec"])

    placed = embeddings.mapInArrow(place, "part int, key bigint, id string, vec binary")
    # every stretch and every cell is a partition of its own, by its number
    stretches = placed.repartitionById(n_parts, "part").sortWithinPartitions("part", "key", "id")
    found = stretches.mapInArrow(lambda it: _search_stretch(it, dim, k, floor, block, cells=cells, centers=groups.centers), FOUND)
    return _merged(found, k)


def _nearest_in_cells(embeddings: DataFrame, groups: Cells, *, dim: int, k: int, floor: float, block: int) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, cell, keys = groups.place_all(unit(from_binary(b.column("vec"), dim)))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(groups.tasks[cell]), pa.array(cell.astype(np.int32)), pa.array(keys), b.column("id").take(at), b.column("vec").take(at)], ["task", "part", "key", "id", "vec"])

    cells = dict(enumerate(zip(groups.cells, groups.owned)))
    placed = embeddings.mapInArrow(place, "task int, part int, key bigint, id string, vec binary")
    parts = placed.repartitionById(groups.n_tasks, "task").select("part", "key", "id", "vec").sortWithinPartitions("part", "key", "id")
    return _merged(parts.mapInArrow(lambda it: _search_stretch(it, dim, k, floor, block, cells=cells), FOUND), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    return merged.select("id", F.slice("found", 1, k).alias("found"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """``id_a < id_b, cosine`` of the pairs in which one is among the found of the other."""
    p = found.select("id", F.explode("found").alias("f"))
    return p.select(F.least("id", "f.id").alias("id_a"), F.greatest("id", "f.id").alias("id_b"), (-F.col("f.s")).alias("cosine")).groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def fit_sample(df: DataFrame, *, vec_col: str, dim: int, fit_rows: int, total: int, seed: int = 11) -> np.ndarray:
    """About ``fit_rows`` usable embeddings of a table, live or not, for fitting; at most twice as many."""

    def pack(batches):
        for b in batches:
            rows, x = usable(b.column("vec"), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([to_binary(x)], ["vec"])

    picked = df.select(F.col(vec_col).cast("array<float>").alias("vec")).sample(fraction=min(1.0, fit_rows / max(total, 1)), seed=seed)
    return from_binary(picked.mapInArrow(pack, "vec binary").limit(2 * fit_rows).toArrow().column("vec"), dim)


def nearest_records(docs: DataFrame, *, dim: int = 64, k: int = 5, floor: float = -1.0, vec_col: str = "precomputed_vector", order: tuple[str, ...] = ("received_at", "batch_no"), fit_rows: int = 20_000, **more) -> DataFrame:
    """:func:`nearest` over the live rows of a versioned table.

    Nulls, wrong lengths, NaN and zero embeddings have no neighbours and are no one's neighbour.
    The curves are fitted on a row sample of about ``fit_rows`` of the raw table.
    """
    total = docs.count()
    fit = fit_sample(docs, vec_col=vec_col, dim=dim, fit_rows=fit_rows, total=total)
    embeddings = live_embeddings(docs, vec_col=vec_col, order=list(order), dim=dim)
    return nearest(embeddings, fit=fit, total=total, dim=dim, k=k, floor=floor, **more)
