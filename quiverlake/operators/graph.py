"""Proximity-graph indexes, one graph per Spark partition: HNSW and Vamana.

``build`` turns a table into index rows, each holding the graph of at most ``rows_per_graph`` embeddings;
``search`` runs a beam search in every graph and merges the results. Rebuilding the rows of changed partitions
replaces graph compaction.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quant import Product
from .runtime import bounded_rows
from .search import rank_by


def similarities(x: np.ndarray, rows, q: np.ndarray, metric: str) -> np.ndarray:
    y = x[rows]
    if metric == "l2":
        d = y - q
        return 1 / (1 + np.einsum("ij,ij->i", d, d))
    d = y @ q
    if metric == "mip":
        return np.where(d >= 0, d + 1, 1 / (1 - np.minimum(d, 0)))
    if metric == "cosine":
        n = np.sqrt(np.einsum("ij,ij->i", y, y) * (q @ q))
        d = d / np.where(n == 0, 1, n)
    return (1 + d) / 2


def beam(x, links, q, start, width, metric, keep=None, score=None):
    """Best-first search over one layer: ``[(similarity, node)]`` best first, at most ``width`` visited results.

    With ``keep`` (a boolean per node) the walk passes through all nodes but collects only kept ones. ``score`` (nodes -> similarities)
    stands in for the exact similarities.
    """
    score = score or (lambda rows: similarities(x, rows, q, metric))
    s = score(np.array(start))
    seen = set(start)
    front = [(-v, n) for v, n in zip(s.tolist(), start)]
    heapq.heapify(front)
    best = [(v, -n) for v, n in zip(s.tolist(), start) if keep is None or keep[n]]
    heapq.heapify(best)
    while front:
        v, node = heapq.heappop(front)
        if len(best) >= width and -v < best[0][0]:
            break
        new = [n for n in links.get(node, ()) if n not in seen]
        if not new:
            continue
        seen.update(new)
        for sv, n in zip(score(np.array(new)).tolist(), new):
            if len(best) < width or sv > best[0][0]:
                heapq.heappush(front, (-sv, n))
                if keep is None or keep[n]:
                    heapq.heappush(best, (sv, -n))
                    if len(best) > width:
                        heapq.heappop(best)
    return sorted(((v, -n) for v, n in best), key=lambda t: (-t[0], t[1]))


def spread(x, candidates, most, metric, slack: float = 1.0, refill: bool = True):
    """Neighbours that are not closer to an already chosen one than to the node itself (times ``slack``); the rest refills."""
    chosen, passed = [], []
    for v, n in candidates:
        if len(chosen) == most:
            break
        if not chosen or similarities(x, np.array(chosen), x[n], metric).max() <= v * slack:
            chosen.append(n)
        else:
            passed.append(n)
    return chosen + passed[: most - len(chosen)] if refill else chosen


class Hnsw:
    """Layers of links; a node's top layer is floor(-ln U / ln M), at most 32; twice M links on the lowest layer."""

    def __init__(self, x: np.ndarray, metric: str = "cosine", m: int = 16, ef_construction: int = 100, seed: int = 42):
        self.x, self.metric, self.m = x.astype(np.float64), metric, m
        rng = np.random.default_rng(seed)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = None
        for node in range(len(x)):
            self._insert(node, min(32, int(-np.log(1 - rng.random()) / np.log(m))), ef_construction)

    def _insert(self, node, top, width):
        while len(self.layers) <= top:
            self.layers.append({})
        q, at = self.x[node], [] if self.entry is None else [self.entry]
        for level in range(len(self.layers) - 1, -1, -1):
            links = self.layers[level]
            start = [n for n in at if n in links]
            if level > top:
                at = [beam(self.x, links, q, start, 1, self.metric)[0][1]] if start else at
                continue
            links[node] = []
            if start:
                found = beam(self.x, links, q, start, width, self.metric)
                most = self.m * 2 if level == 0 else self.m
                links[node] = spread(self.x, found, self.m, self.metric)
                for n in links[node]:
                    links[n].append(node)
                    if len(links[n]) > most:
                        s = similarities(self.x, np.array(links[n]), self.x[n], self.metric)
                        order = sorted(zip(s.tolist(), links[n]), key=lambda t: (-t[0], t[1]))
                        links[n] = spread(self.x, order, most, self.metric)
                at = [n for _, n in found]
        if self.entry is None or top >= len(self.layers) - 1 and node in self.layers[-1] and len(self.layers[-1]) == 1:
            self.entry = node

    def search(self, q, k, width, keep=None, starts: int = 1, coded: float = 0.0):
        """The ``k`` best by a beam of ``width``. ``starts`` seeds from layer 1 walk together; with ``coded`` the walk goes by the
        product codes and the best ``k x coded`` are ranked exactly."""
        if self.entry is None:
            return []
        score = None
        if coded and self.codec is not None:
            tables = np.stack([np.pad(t, (0, 256 - len(t))) for t in self.codec.tables(q)])
            at_code, norm = np.arange(tables.shape[0]), np.sqrt(q @ q) or 1.0
            score = lambda rows: (1 + tables[at_code, self.codes[rows]].sum(axis=1) / (norm * self.norms[rows])) / 2 if self.metric == "cosine" else tables[at_code, self.codes[rows]].sum(axis=1) - (self.norms[rows] ** 2 / 2 if self.metric == "l2" else 0)
        at = [self.entry]
        for level in range(len(self.layers) - 1, 0, -1):
            start = [n for n in at if n in self.layers[level]]
            if start:
                at = [n for _, n in beam(self.x, self.layers[level], q, start, starts if level == 1 else 1, self.metric, score=score)[: starts if level == 1 else 1]]
        wide = max(k, width, int(np.ceil(k * coded)))
        found = beam(self.x, self.layers[0], q, at, wide, self.metric, keep, score)
        if score is None:
            return found[:k]
        some = np.array([n for _, n in found[: max(k, int(np.ceil(k * coded)))]], np.int64)
        exact = similarities(self.x, some, q, self.metric) if len(some) else np.empty(0)
        return sorted(zip(exact.tolist(), some.tolist()), key=lambda t: (-t[0], t[1]))[:k]

    codec = codes = norms = None

    def add_codes(self, codec) -> None:
        """Product codes of all nodes, beside the links."""
        self.codec, self.codes, self.norms = codec, codec.encode(self.x.astype(np.float32)), np.maximum(np.linalg.norm(self.x, axis=1), 1e-30)

    def without(self, dead: np.ndarray) -> None:
        """Drop nodes. Links between the others stay; a node that lost some is offered the neighbours of those it lost."""
        new = np.cumsum(~dead) - 1
        layers = []
        for level, links in enumerate(self.layers):
            most, out = self.m * 2 if level == 0 else self.m, {}
            for node, own in links.items():
                if dead[node]:
                    continue
                kept = [n for n in own if not dead[n]]
                if len(kept) < len(own):
                    reach, seen, todo = set(kept), set(), [n for n in own if dead[n]]
                    while todo:  # through lost nodes to the next live ones
                        n = todo.pop()
                        if n not in seen:
                            seen.add(n)
                            for x in links.get(n, ()):
                                (todo.append if dead[x] and len(seen) < 64 else reach.add)(x)
                    pool = np.array([n for n in reach if n != node and not dead[n]], np.int64)
                    if len(pool):
                        s = similarities(self.x, pool, self.x[node], self.metric)
                        kept = spread(self.x, sorted(zip(s.tolist(), pool.tolist()), key=lambda t: (-t[0], t[1])), most, self.metric)
                out[int(new[node])] = [int(new[n]) for n in kept]
            layers.append(out)
        while len(layers) > 1 and not layers[-1]:
            layers.pop()
        self.layers, self.x = layers, self.x[~dead]
        if self.codes is not None:
            self.codes, self.norms = self.codes[~dead], self.norms[~dead]
        self.entry = next(iter(layers[-1]), None) if len(self.x) else None


class Vamana:
    """A flat graph of at most ``r`` links: random start, then two passes of robust pruning (slack 1, then ``alpha``) around the medoid."""

    def __init__(self, x: np.ndarray, metric: str = "cosine", r: int = 32, width: int = 64, alpha: float = 1.1, seed: int = 42):
        self.x, self.metric = x.astype(np.float64), metric
        n, rng = len(x), np.random.default_rng(seed)
        self.entry = int(similarities(self.x, np.arange(n), self.x.mean(axis=0), metric).argmax()) if n else None
        self.links = {i: [int(j) for j in rng.choice(n, min(r, n - 1) + 1, replace=False) if j != i][:r] for i in range(n)}
        for slack in (1.0, alpha):
            for i in rng.permutation(n).tolist():
                found = beam(self.x, self.links, self.x[i], [self.entry], width, metric)
                pool = {j: v for v, j in found if j != i}
                known = [j for j in self.links[i] if j not in pool]
                if known:
                    pool.update(zip(known, similarities(self.x, np.array(known), self.x[i], metric).tolist()))
                self.links[i] = spread(self.x, sorted(((v, j) for j, v in pool.items()), key=lambda t: (-t[0], t[1])), r, metric, slack, refill=False)
                for j in self.links[i]:
                    if i not in self.links[j]:
                        self.links[j].append(i)
                        if len(self.links[j]) > r:
                            s = similarities(self.x, np.array(self.links[j]), self.x[j], metric)
                            self.links[j] = spread(self.x, sorted(zip(s.tolist(), self.links[j]), key=lambda t: (-t[0], t[1])), r, metric, slack, refill=False)

    def search(self, q, k, width, keep=None, starts: int = 1, coded: float = 0.0):
        return beam(self.x, self.links, q, [self.entry], max(k, width), self.metric, keep)[:k] if self.links else []


def build(df: DataFrame, kind: str = "hnsw", *, id_col: str = "id", vec_col: str = "vector", metric: str = "cosine", rows_per_graph: int = 10_000, total: int | None = None, codes: int = 0, **options) -> DataFrame:
    """``part int, graph binary``: one row per graph of about ``rows_per_graph`` rows, spread by a hash of the id.

    Null embeddings are left out; all embeddings must have one length. ``codes`` (HNSW): so many bytes of product codes for each node.
    """
    total = df.count() if total is None else total
    parts = max(1, -(-total // rows_per_graph))
    rows = df.where(F.col(vec_col).isNotNull()).select(F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("part"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    make = {"hnsw": Hnsw, "vamana": Vamana}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .runtime import sorted_groups

        for g in sorted_groups(batches, "part"):
            g = g.combine_chunks()
            x = g.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(g.num_rows, -1)
            made = make(x, metric, **options)
            if codes:
                made.add_codes(Product.train(x[:: max(1, len(x) // 4096)], codes))
            blob = pickle.dumps((g.column("id").to_pylist(), made))
            yield pa.RecordBatch.from_arrays([g.column("part").combine_chunks().slice(0, 1), pa.array([blob], pa.binary())], ["part", "graph"])

    return rows.repartition(parts, "part").sortWithinPartitions("part", "id").mapInArrow(run, "part int, graph binary")


def search(index: DataFrame, queries: DataFrame, k: int, *, width: int = 100, id_type: str = "bigint", allowed: DataFrame | None = None, most_queries: int = 4096, most_allowed: int = 1_000_000, starts: int = 1, coded: float = 0.0) -> DataFrame:
    """``qid, id, score, rank`` by beam search of every graph. ``allowed`` (a bounded list of ids) filters inside the walk.

    Queries are at most ``most_queries`` a call; larger sets are split by the caller. More than ``most_allowed`` allowed
    ids are an error.
    """
    rows = queries.select("qid", F.col("qvec").cast("array<double>").alias("v")).where("v is not null").limit(most_queries + 1).collect()
    if len(rows) > most_queries:
        raise ValueError(f"more than {most_queries} queries in a call")
    kept = None if allowed is None else {r[0] for r in bounded_rows(allowed, most_allowed, "the list of allowed ids")}
    sent = index.sparkSession.sparkContext.broadcast(([r.qid for r in rows], [np.array(r.v) for r in rows], kept))
    q_type = queries.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, embeddings, kept = sent.value
        for b in batches:
            for blob in b.column("graph").to_pylist():
                ids, graph = pickle.loads(blob)
                keep = None if kept is None else [i in kept for i in ids]
                out = [(q, ids[n], s) for q, v in zip(names, embeddings) for s, n in graph.search(v, k, width, keep, starts, coded)]
                if out:
                    a, i, s = zip(*out)
                    yield pa.RecordBatch.from_arrays([pc.cast(pa.array(a), _arrow(q_type)), pc.cast(pa.array(i), _arrow(id_type)), pa.array(s, pa.float64())], ["qid", "id", "score"])

    return rank_by(index.mapInArrow(run, f"qid {q_type}, id {id_type}, score double"), ["qid"], "score", "id", k)


def compact(index: DataFrame, dead: DataFrame, most_dead: int = 1_000_000) -> DataFrame:
    """The index rows without the ids of ``dead`` (a bounded list; rebuild beyond it), each HNSW graph mended in its task."""
    gone = frozenset(r[0] for r in bounded_rows(dead, most_dead, "the list of deleted ids"))
    sent = index.sparkSession.sparkContext.broadcast(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("graph").to_pylist()):
                ids, graph = pickle.loads(blob)
                lost = np.array([i in sent.value for i in ids], bool)
                if lost.any():
                    graph.without(lost)
                    ids = [i for i, x in zip(ids, lost) if not x]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pickle.dumps((ids, graph))], pa.binary())], ["part", "graph"])

    return index.mapInArrow(run, "part int, graph binary")


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
