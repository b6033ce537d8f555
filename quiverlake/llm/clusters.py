"""Grouping records into similarity clusters.

Distributed k-means, seeded by parallel oversampling, cuts the records into cells; beyond
``MOST_CENTROIDS`` cells each coarse cell is cut again by k-means of its own, and a cell that is
still large once more. Every record goes to its nearest cells. Inside a cell the links between
records (cosine at least ``alike``) are found exactly, and components that share records across
cells are merged. So the centroids decide only who is compared, not who is alike.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.runtime import discard, materialise, sorted_groups
from .arrays import from_binary, live_embeddings, to_binary, unit
from .words import words

MOST_CENTROIDS = 4096  # of one k-means on the driver: 4096 x 64 floats are 1 MB
MOST_CELLS = 262_144  # leaves of the centroid tree sent to every task: 64 MB at 64 dimensions
MOST_ROWS = 32_768  # members of a cell beyond which it is cut again
SPLIT_ABOVE = 6144  # members of a cell beyond which big groups are peeled off before all pairs are compared
BUCKETS = 1 << 18  # hashed words whose document frequency is counted


def _hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash of a word, its count in the row)`` of every different word of every row."""
    rows, known, at = [], {}, []
    for i, text in enumerate(texts):
        ws = words(text)
        rows.append(np.full(len(ws), i))
        at.extend(known.setdefault(w, len(known)) for w in ws)
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    pairs, counts = np.unique(np.concatenate(rows) * len(known) + np.array(at), return_counts=True)
    h = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in known), np.int64, len(known))
    return pairs // len(known), h[pairs % len(known)], counts


def hashed_features(texts: list[str | None], dim: int = 64, weight: np.ndarray | None = None) -> np.ndarray:
    """Texts as hashed weighted word features, for records that have no vector of their own.

    Each different word adds 1 + log of its count, times ``weight`` of its bucket, with a hashed sign at a hashed
    place. Null and wordless texts give zeros, which are not usable.
    """
    out = np.zeros((len(texts), dim), np.float32)
    row, h, n = _hashed_words(texts)
    value = (1 + np.log(n)) * (1.0 if weight is None else weight[h % BUCKETS]) * np.where(h >> 31, 1, -1)
    np.add.at(out, (row, h % dim), value)
    return out


def text_points(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", dim: int = 256) -> DataFrame:
    """``id, vec`` of one row per id by :func:`hashed_features`, words weighted by their rarity over all documents.

    Null, blank and wordless texts give no row. What reaches the driver is one count for each of at most ``BUCKETS``.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def count(batches):
        df = np.zeros(BUCKETS, np.int64)
        for b in batches:
            row, h, _ = _hashed_words(b.column("text").to_pylist())
            for bucket in np.unique(row * BUCKETS + h % BUCKETS) % BUCKETS:
                df[bucket] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["bucket", "n"])

    got = rows.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = max(1, rows.count())
    weight = np.full(BUCKETS, math.log(total + 1))
    weight[got.column("bucket").to_numpy()] = np.log((total + 1) / got.column("n").to_numpy())

    def features(batches):
        for b in batches:
            x = hashed_features(b.column("text").to_pylist(), dim, weight)
            at = np.flatnonzero((x != 0).any(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), to_binary(np.ascontiguousarray(x[at]))], ["id", "vec"])

    return rows.mapInArrow(features, "id string, vec binary")


def _best(u: np.ndarray, centers: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of the ``want`` nearest centers, nearest first."""
    s = u @ centers.T
    rows = np.arange(len(u))
    which, cosine = [], []
    for _ in range(min(want, len(centers))):
        a = s.argmax(axis=1)
        which.append(a)
        cosine.append(s[rows, a])
        s[rows, a] = -2
    return np.stack(which, 1), np.stack(cosine, 1)


def _each(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 8192):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            yield part, unit(from_binary(part.column("vec"), dim)).astype(np.float32)


def _draw(points: DataFrame, centers: np.ndarray | None, want: int, dim: int, seed: int) -> np.ndarray:
    """``want`` records drawn without replacement, weighted by squared distance to the centers.

    Each record gets the key -log(u)/d2 and the smallest keys win, so one pass does it and no
    total is needed; a task passes on its ``want`` smallest. u is a hash of the record's id, so
    a lost task draws the same records again.
    """
    hashed = points.select("vec", F.xxhash64("id", F.lit(seed)).alias("h"))

    def pick(batches):
        keys, vecs = np.empty(0), np.empty((0, dim), np.float32)
        for part, u in _each(batches, dim):
            h = ((part.column("h").to_numpy() >> 11 & (1 << 53) - 1) + 0.5) / 2.0**53
            d2 = np.ones(len(u)) if centers is None else np.maximum(2 - 2 * _best(u, centers, 1)[1][:, 0], 1e-9)
            key = -np.log(h) / d2
            keys, vecs = np.concatenate([keys, key]), np.vstack([vecs, u])
            if len(keys) > want:
                top = np.argpartition(keys, want - 1)[:want]
                keys, vecs = keys[top], vecs[top]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), to_binary(np.ascontiguousarray(vecs))], ["key", "vec"])

    got = hashed.mapInArrow(pick, "key double, vec binary").orderBy("key").limit(want).toArrow()
    return from_binary(got.column("vec"), dim).copy()


def _sums(points: DataFrame, centers: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and mean direction of the records nearest to each center, summed in two levels."""
    k = len(centers)

    def local(batches):
        total, count = np.zeros((k, dim)), np.zeros(k, np.int64)
        for _, u in _each(batches, dim):
            a = _best(u, centers, 1)[0][:, 0]
            order = np.argsort(a, kind="stable")
            cells, starts = np.unique(a[order], return_index=True)
            total[cells] += np.add.reduceat(u[order].astype(np.float64), starts, axis=0)
            count += np.bincount(a, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), to_binary(np.ascontiguousarray(total[some].astype(np.float32)))], ["cell", "n", "vec"])

    def merge(batches):
        total, count = {}, {}
        for b in batches:
            for c, n, x in zip(b.column("cell").to_pylist(), b.column("n").to_pylist(), from_binary(b.column("vec"), dim)):
                total[c] = total.get(c, 0) + x.astype(np.float64)
                count[c] = count.get(c, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([count[c] for c in total], pa.int64()), to_binary(np.array([total[c] for c in total], np.float32))], ["cell", "n", "vec"])

    schema = "cell int, n bigint, vec binary"
    got = points.mapInArrow(local, schema).repartition("cell").mapInArrow(merge, schema).toArrow()
    count, mean = np.zeros(k, np.int64), centers.astype(np.float64).copy()
    cells = got.column("cell").to_numpy()
    count[cells] = got.column("n").to_numpy()
    mean[cells] = from_binary(got.column("vec"), dim)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    return count, np.where(norm > 1e-9, mean / np.maximum(norm, 1e-9), centers).astype(np.float32)


def _recluster(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the drawn candidates, then three Lloyd steps; on the driver, bounded by 3 k points."""
    rng = np.random.default_rng(seed)
    if len(points) <= k:
        return points
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    near = points @ points[chosen[0]]
    for _ in range(k - 1):
        p = weight * np.maximum(2 - 2 * near, 0)
        if p.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        near = np.maximum(near, points @ points[chosen[-1]])
    centers = points[chosen]
    for _ in range(3):
        a = (points @ centers.T).argmax(axis=1)
        total = np.zeros_like(centers, dtype=np.float64)
        np.add.at(total, a, points * weight[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), centers).astype(np.float32)
    return centers


def kmeans_centroids(points: DataFrame, *, dim: int, k: int, rounds: int = 2, steps: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means over ``id, vec`` and the records nearest to each before the last step.

    Seeding draws ``k / 2`` records and, in ``rounds`` rounds, ``k`` more each, weighted by squared distance to those
    drawn; they are weighted by the records nearest to them and reclustered. ``steps`` Lloyd steps follow. Every
    draw and step is a pass over all records; the driver holds the candidates (at most 5/2 k) and centroids.
    """
    k = min(k, MOST_CENTROIDS)
    some = _draw(points, None, max(1, k // 2), dim, seed)
    for r in range(rounds):
        more = _draw(points, some if len(some) else None, k, dim, seed + r + 1)
        some = np.unique(np.vstack([some, more]), axis=0)
    if not len(some):
        return np.zeros((1, dim), np.float32), np.zeros(1, np.int64)
    count, mean = _sums(points, some, dim)
    centers = _recluster(mean, np.maximum(count, 0.5).astype(np.float64), k, seed)
    for _ in range(steps):
        count, centers = _sums(points, centers, dim)
    return centers, count


class CellTree:
    """Centroids in one or two levels; ``nearest`` gives the cells of records."""

    def __init__(self, coarse: np.ndarray, leaves: np.ndarray | None = None, owner: np.ndarray | None = None):
        self.coarse = coarse
        self.leaves = None if leaves is None else [(np.flatnonzero(owner == c), leaves[owner == c]) for c in range(len(coarse))]

    def nearest(self, u: np.ndarray, cells: int) -> np.ndarray:
        """Rows x ``cells`` numbers of cells, nearest first; -1 where there are fewer. In a tree: of the leaves below the nearest ``cells`` coarse ones."""
        coarse, _ = _best(u, self.coarse, cells)
        if self.leaves is None:
            return coarse
        out, score = np.full((len(u), cells * coarse.shape[1]), -1), np.full((len(u), cells * coarse.shape[1]), -2.0)
        for j in range(coarse.shape[1]):
            order = np.argsort(coarse[:, j], kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(coarse[order, j]) != 0, [True]]))
            for a, b in zip(edges, edges[1:]):
                rows = order[a:b]
                names, x = self.leaves[coarse[rows[0], j]]
                if len(names):
                    which, s = _best(u[rows], x, cells)
                    at = slice(j * cells, j * cells + which.shape[1])
                    out[rows, at], score[rows, at] = names[which], s
        first = np.argsort(-score, axis=1, kind="stable")[:, :cells]
        return np.take_along_axis(out, first, axis=1)


def cell_tree(points: DataFrame, *, dim: int, total: int, rows_per_cell: int, seed: int = 3, sample_per_leaf: int = 16, most_flat: int = MOST_CENTROIDS) -> CellTree:
    """Cells of about ``rows_per_cell`` records, at most ``MOST_CELLS`` of them.

    Up to ``most_flat`` cells they are one k-means over all records. Beyond, its centroids are the square root of the
    cells, and inside each coarse cell the leaves are fitted, in the tasks, on about ``sample_per_leaf`` records a leaf.
    """
    k = min(MOST_CELLS, max(1, total // rows_per_cell))
    if k <= most_flat:
        return CellTree(kmeans_centroids(points, dim=dim, k=k, seed=seed)[0])
    coarse, _ = kmeans_centroids(points, dim=dim, k=math.ceil(math.sqrt(k)), seed=seed)
    share, most = min(1.0, sample_per_leaf * k / total), 4 * sample_per_leaf * math.ceil(math.sqrt(k))

    def assign(batches):
        for part, u in _each(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(_best(u, coarse, 1)[0][:, 0].astype(np.int32)), part.column("vec")], ["cell", "vec"])

    def fit(batches):
        for g in sorted_groups(batches, "cell"):
            g = g.combine_chunks()
            u = unit(from_binary(g.column("vec"), dim)).astype(np.float32)
            x = _recluster(u, np.ones(len(u)), max(1, len(u) // sample_per_leaf), seed)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), g.column("cell")[0].as_py(), np.int32)), to_binary(np.ascontiguousarray(x))], ["cell", "vec"])

    drawn = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).mapInArrow(assign, "cell int, vec binary")
    # a coarse cell may hold a third of the records: its sample is thinned before it reaches a task
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("vec")))
    got = drawn.withColumn("r", rank).where(F.col("r") <= most).select("cell", "vec").sortWithinPartitions("cell").mapInArrow(fit, "cell int, vec binary").toArrow()
    return CellTree(coarse, from_binary(got.column("vec"), dim), got.column("cell").to_numpy())


def _expand(adj: np.ndarray, labels: np.ndarray, at: np.ndarray) -> None:
    """Label the components of a boolean adjacency; ``labels[at]`` holds -1 where not yet labelled."""
    degree = adj.sum(axis=1)
    todo = np.ones(len(at), bool)
    for i in np.flatnonzero(degree > 1):
        if not todo[i]:
            continue
        seen = adj[i].copy()
        front = np.flatnonzero(seen)
        while len(front):
            step = adj[front].any(axis=0) & ~seen
            front = np.flatnonzero(step)
            seen |= step
        labels[at[seen]] = at[i]
        todo &= ~seen
    labels[at[todo]] = at[todo]


def link_cell(u: np.ndarray, alike: float, rng: np.random.Generator) -> np.ndarray:
    """A component label for every row of a cell; two rows share it iff linked by a chain of cosines >= alike.

    Big groups are peeled off first: a pivot's neighbours and then, within the angle that can
    still reach the group, everything linked to it. What remains is compared in full, in blocks.
    """
    n = len(u)
    labels = np.full(n, -1)
    f = u.astype(np.float32)
    floor = alike - 5e-7  # cosines count as rounded to 6 decimals
    left = np.arange(n)
    theta = np.arccos(alike)
    while len(left) > SPLIT_ABOVE:
        trial = left[rng.choice(len(left), min(64, len(left)), replace=False)]
        s = f[left] @ f[trial].T
        sizes = (s >= alike).sum(axis=0)
        best = int(sizes.argmax())
        if sizes[best] < len(left) // 64:
            break
        inside = np.zeros(n, bool)
        front = left[s[:, best] >= floor + 1e-5]
        inside[front] = inside[trial[best]] = True
        rest = left[~inside[left]]
        while len(front) and len(rest):
            mean = f[front].mean(axis=0)
            mean /= np.linalg.norm(mean)
            reach = np.arccos(np.clip((f[front] @ mean).min(), -1, 1)) + theta
            near = rest[f[rest] @ mean >= np.cos(min(reach + 1e-3, np.pi))] if reach < np.pi else rest
            new = []
            for i in range(0, len(near), 1024):
                part, hit = near[i : i + 1024], None
                open_rows = np.arange(len(part))
                hit = np.zeros(len(part), bool)
                for j, width in _steps(len(front)):  # most are settled by the first few rows
                    m = (f[part[open_rows]] @ f[front[j : j + width]].T).max(axis=1)
                    sure = m >= floor + 1e-5
                    for r in np.flatnonzero(~sure & (m >= floor - 1e-5)):
                        sure[r] = (u[front[j : j + width]] @ u[part[open_rows[r]]]).max() >= floor
                    hit[open_rows[sure]] = True
                    open_rows = open_rows[~sure]
                    if not len(open_rows):
                        break
                new.append(part[hit])
            front = np.concatenate(new) if new else near[:0]
            inside[front] = True
            rest = left[~inside[left]]
        labels[inside] = np.flatnonzero(inside)[0]
        left = rest
    if len(left) <= SPLIT_ABOVE:
        s = f[left] @ f[left].T
        adj = s >= floor
        close = np.flatnonzero(np.abs(s - floor) < 1e-5)
        if len(close):
            i, j = close // len(left), close % len(left)
            adj[i, j] = np.einsum("ij,ij->i", u[left[i]], u[left[j]]) >= floor
            adj |= adj.T
        _expand(adj, labels, left)
        return labels
    # many small groups: compared in blocks, linked as arrays
    roots = np.arange(len(left))
    for i in range(0, len(left), 2048):
        for j in range(i, len(left), 2048):
            s = f[left[i : i + 2048]] @ f[left[j : j + 2048]].T
            a, b = np.nonzero(s >= floor - 1e-5)
            close = np.flatnonzero(s[a, b] < floor + 1e-5)
            a, b = a + i, b + j
            if len(close):
                keep = np.ones(len(a), bool)
                keep[close] = np.einsum("ij,ij->i", u[left[a[close]]], u[left[b[close]]]) >= floor
                a, b = a[keep], b[keep]
            _link(roots, a, b)
    labels[left] = left[roots]
    return labels


def _link(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the groups of rows ``a`` with those of ``b``, pair by pair; ``roots`` holds the smallest row of each group."""
    while True:
        x, y = roots[a], roots[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(roots, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def _steps(n: int):
    at, width = 0, 128
    while at < n:
        yield at, width
        at, width = at + width, min(width * 4, 8192)


_KEYS = np.random.default_rng(17).integers(0, 2**63, (2, 4096), np.uint64) * np.uint64(2) + np.uint64(1)


def _same_direction(points: DataFrame, dim: int, salts: int = 16) -> DataFrame:
    """``id, rep`` of the records that share their direction (to 6 decimals) with another; ``rep`` is the smallest id.

    Counted by two 64-bit keys of the direction, combined on the map side; the join back is salted,
    so copies of one vector may be most of the rows.
    """

    def key(batches):
        for part, u in ((p, unit(from_binary(p.column("vec"), dim))) for b in batches for p in [b] if b.num_rows):
            q = np.rint(u * 1e6).astype(np.int64).view(np.uint64)
            h = [(q * k[:dim]).sum(axis=1).view(np.int64) for k in _KEYS]
            yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, h)], ["id", "h1", "h2"])

    keyed = points.mapInArrow(key, "id string, h1 bigint, h2 bigint")
    several = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    salted = several.select("h1", "h2", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["h1", "h2", "salt"]).select("id", "rep")


def _cut_again(placed: DataFrame, dim: int, most_rows: int, seed: int, levels: int = 8) -> DataFrame:
    """Cut cells of more than ``most_rows`` members by a k-means of their own, their members going to the two nearest children.

    The children's centroids are fitted on a bounded sample of the cell and travel with its rows, before them in
    the order of a partition; a cell is spread over salted partitions, so one may hold a third of all rows. A cell
    that cutting no longer makes smaller stays as it is: :func:`link_cell` takes any size.
    """
    done: list[DataFrame] = []
    for level in range(levels):
        placed = materialise(placed, "cells")
        sizes = materialise(placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most_rows), "sizes")
        top = sizes.agg(F.max("n")).first()[0]
        if top is None:
            break
        # the list of large cells is short beside their rows; beyond 10,000 it is joined by shuffle
        named = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
        done.append(placed.join(named, "cell", "left_anti"))
        large = placed.join(named, "cell")
        children, salts = 64, max(4, -(-top // 500_000))
        wanted = 32 * children
        part = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < F.ceil((1 << 30) * F.lit(1.0) * wanted / F.col("n"))

        def fit(batches):
            for g in sorted_groups(batches, "cell"):
                g = g.combine_chunks()
                u = unit(from_binary(g.column("vec"), dim)).astype(np.float32)
                x = _recluster(u, np.ones(len(u)), children, seed)
                yield pa.RecordBatch.from_arrays([g.column("cell").combine_chunks().slice(0, 1), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["cell", "vec"])

        centers = large.where(part).select("cell", "vec").repartition("cell").sortWithinPartitions("cell").mapInArrow(fit, "cell string, vec binary")
        heads = centers.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("string").alias("id"), "vec")
        rows = large.select("cell", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "id", "vec")

        def assign(batches):
            now, x = None, None
            for b in batches:
                cells, ids = b.column("cell").to_pylist(), b.column("id")
                edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1] or not ids[i].is_valid), len(cells)]
                for i, j in zip(edges, edges[1:]):
                    if i < j and not ids[i].is_valid:
                        now, x = cells[i], np.frombuffer(b.column("vec")[i].as_py(), np.float32).reshape(-1, dim)
                        i += 1
                    if i < j:
                        g = b.slice(i, j - i)
                        which, _ = _best(unit(from_binary(g.column("vec"), dim)).astype(np.float32), x, 2)
                        for c in which.T:
                            yield pa.RecordBatch.from_arrays([pa.array([f"{now}/{n}" for n in c]), g.column("id"), g.column("vec")], ["cell", "id", "vec"])

        cut = heads.unionByName(rows).repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.col("id").asc_nulls_first()).mapInArrow(assign, "cell string, id string, vec binary")
        before, placed = top, materialise(cut, "cells")
        now = placed.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if now > 0.8 * before:
            break
    for d in done:
        placed = placed.unionByName(d.select("cell", "id", "vec"))
    return placed


def similarity_groups(points: DataFrame, *, dim: int, alike: float = 0.84, rows_per_cell: int = 512, cells: int = 3, at_least: int = 2, total: int | None = None, seed: int = 3, exact: bool = False, most_rows: int = MOST_ROWS) -> DataFrame:
    """``cluster_id, id`` of the groups with at least ``at_least`` records.

    ``points``: ``id string, vec binary``, one row per id, read several times (pass a written table).
    Records belong together if their cosine is at least ``alike``, directly or through others;
    ``cluster_id`` is the smallest id of the group. Links are exact among records that share one
    of their ``cells`` nearest cells; with ``exact`` every record is compared with every other, in pairs of
    blocks that are spread over the tasks, at a cost that grows with the square of their number. Records of
    the same direction are compared once, through the smallest id among them, and all belong to its group, so
    no cell fills up with copies. Empty input gives an empty result; records alike to none are in no group.
    """
    total = points.count() if total is None else total
    copies = materialise(_same_direction(points, dim), "copies")
    if not copies.isEmpty():
        points = materialise(points.join(copies.where("id <> rep"), "id", "left_anti").select("id", "vec"), "distinct")

    def link(batches):
        for group in sorted_groups(batches, "cell"):
            group = group.combine_chunks()
            ids = group.column("id").to_numpy(zero_copy_only=False)
            u = unit(from_binary(group.column("vec"), dim))
            labels = link_cell(u, alike, np.random.default_rng(seed))
            order = np.lexsort((ids, labels))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(labels[order]) != 0]))
            sizes = np.diff(np.concatenate([cuts, [len(order)]]))
            keep = np.repeat(sizes > 1, sizes)
            names = np.repeat(ids[order[cuts]], sizes)
            yield pa.RecordBatch.from_arrays([pa.array(ids[order][keep], pa.string()), pa.array(names[keep], pa.string())], ["id", "comp"])

    # about 6 MB a task, whatever the number of records
    tasks = lambda copies: max(1, math.ceil(total * copies * (4 * dim + 48) / 6e6))
    if exact:
        blocks = max(2, math.ceil(total / 8192))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        pairs = points.select("id", "vec", block.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).where("a <> b")
        placed = pairs.select(F.concat_ws("/", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")).alias("cell"), "id", "vec")
        placed = placed.repartition(tasks(blocks - 1), "cell")
    else:
        tree = cell_tree(points, dim=dim, total=total, rows_per_cell=rows_per_cell, seed=seed)
        sent = points.sparkSession.sparkContext.broadcast(tree)

        def assign(batches):
            for part, u in _each(batches, dim):
                for c in sent.value.nearest(u, cells).T:
                    some = pa.array(np.flatnonzero(c >= 0))
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)).take(some), part.column("id").take(some), part.column("vec").take(some)], ["cell", "id", "vec"])

        placed = points.mapInArrow(assign, "cell int, id string, vec binary")
        # the largest cell, from so many records that one of ``most_rows`` shows by about 64 of its members
        share = min(1.0, 64 / most_rows)
        few = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).mapInArrow(assign, "cell int, id string, vec binary")
        if (few.groupBy("cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) / share > 0.75 * most_rows:
            placed = _cut_again(placed.withColumn("cell", F.col("cell").cast("string")), dim, most_rows, seed)
        placed = placed.repartition(tasks(cells), "cell")
    linked = placed.sortWithinPartitions("cell").mapInArrow(link, "id string, comp string")
    # a record has at most as many components as cells
    member = materialise(linked.groupBy("id").agg(F.min("comp").alias("comp"), F.collect_set("comp").alias("comps")), "member")
    edges = member.where(F.size("comps") > 1).select(F.col("comp").alias("a"), F.explode("comps").alias("b"))
    if edges.isEmpty():
        placed = member.select("id", F.col("comp").alias("root"))
    else:
        roots = connected_components(edges)
        # components named in an edge are few beside the records; their names are unique here
        placed = member.join(roots, member.comp == roots.node, "left").select("id", F.coalesce("root", "comp").alias("root"))
    others = copies.where("id <> rep")
    # a representative linked to no one still leads its copies; each copy takes its representative's group
    leaders = copies.where("id = rep").select(F.col("id").alias("rep")).join(placed.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"))
    salted = leaders.select("rep", "root", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    followers = others.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salted, ["rep", "salt"]).select("id", "root")
    alone = leaders.join(placed.select(F.col("id").alias("rep")), "rep", "left_anti").select(F.col("rep").alias("id"), "root")
    return _of_size(placed.unionByName(alone).unionByName(followers), at_least)


def _of_size(placed: DataFrame, at_least: int, salts: int = 16) -> DataFrame:
    """Keep the rows of groups with enough members. Counting combines on the map side; the join is
    salted, so one group with most of the rows is spread over ``salts`` tasks."""
    big = placed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("root", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(big, ["root", "salt"]).select(F.col("root").alias("cluster_id"), "id")


def describe_groups(groups: DataFrame, points: DataFrame, *, dim: int, typical: int = 3) -> DataFrame:
    """``cluster_id, size, typical``: each group's number of records and the ``typical`` ids nearest its mean direction.

    Sums are taken per task first, so a group may hold most of the rows. Ties: the smaller id.
    """
    joined = groups.join(points, "id").select("cluster_id", "id", "vec")

    def partial(batches):
        total: dict = {}
        for b in batches:
            u = unit(from_binary(b.column("vec"), dim)) if b.num_rows else np.empty((0, dim))
            names, inverse = np.unique(b.column("cluster_id").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            sums = np.zeros((len(names), dim))
            np.add.at(sums, inverse, u)
            for name, s, n in zip(names, sums, np.bincount(inverse, minlength=len(names))):
                a = total.get(name)
                total[name] = (a[0] + s, a[1] + int(n)) if a else (s, int(n))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([n for _, n in total.values()], pa.int64()), to_binary(np.array([s for s, _ in total.values()], np.float32))], ["cluster_id", "n", "mean"])

    def whole(batches):
        total: dict = {}
        for b in batches:
            for c, n, s in zip(b.column("cluster_id").to_pylist(), b.column("n").to_pylist(), from_binary(b.column("mean"), dim)):
                a = total.get(c)
                total[c] = (a[0] + s, a[1] + n) if a else (s.astype(np.float64), n)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([n for _, n in total.values()], pa.int64()), to_binary(np.array([s for s, _ in total.values()], np.float32))], ["cluster_id", "n", "mean"])

    schema = "cluster_id string, n bigint, mean binary"
    means = joined.mapInArrow(partial, schema).repartition("cluster_id").mapInArrow(whole, schema)

    def score(batches):
        for b in batches:
            if b.num_rows:
                s = np.einsum("ij,ij->i", unit(from_binary(b.column("vec"), dim)), unit(from_binary(b.column("mean"), dim)))
                yield pa.RecordBatch.from_arrays([b.column("cluster_id"), b.column("n"), b.column("id"), pa.array(np.round(s, 6))], ["cluster_id", "n", "id", "s"])

    scored = joined.join(means, "cluster_id").select("cluster_id", "n", "id", "vec", "mean").mapInArrow(score, "cluster_id string, n bigint, id string, s double")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    pair = F.struct((-F.col("s")).alias("s"), "id")
    w = Window.partitionBy("cluster_id", "salt").orderBy(F.desc("s"), "id")
    first = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)  # limited per map task, then per salt
    first = first.groupBy("cluster_id", "n").agg(F.collect_list(pair).alias("t"))
    both = first.select("cluster_id", "n", F.slice(F.array_sort("t"), 1, typical).alias("t"))
    return both.select("cluster_id", F.col("n").alias("size"), F.transform("t", lambda x: x["id"]).alias("typical"))


def live_points(docs: DataFrame, *, vec_col: str = "precomputed_vector", order: tuple[str, ...] = ("received_at", "batch_no"), dim: int = 64) -> DataFrame:
    return materialise(live_embeddings(docs, vec_col=vec_col, order=list(order), dim=dim), "points")
