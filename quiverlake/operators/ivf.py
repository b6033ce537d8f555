"""A clustered index on storage: lists of rows under their centroid, with product codes of the residuals.

``build`` writes one folder: ``rows`` (partitioned by ``cluster_id``, so that a probe list prunes the scan), ``lists``
(a row per cluster: centroid, radius, size, spill target, key dimensions) and ``codec``. ``search`` routes the queries
over the lists, which are model state, and scans the probed partitions only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cluster, quant
from .search import _keep_best, rank_by

KEY_DIMS = 8  # fixed value: dimensions of a cluster whose partial distance is tried first


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with ``dim`` values, and those as doubles."""
    fit = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    return fit, column.take(pa.array(fit, pa.int64())).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), dim).astype(np.float64)


def _floats(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32) if len(x) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def place(df: DataFrame, centroids: np.ndarray, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``id, vector, cluster_id, second, d``: the nearest and second nearest centroid of every row and the distance to the first.

    Ties go to the smaller cluster; rows without a vector of the centroids' length are left out.
    """
    dim, id_type = centroids.shape[1], df.schema[id_col].dataType.simpleString()
    half = (centroids**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, x = _matrix(b.column("v"), dim)
            for at in range(0, len(fit), 8192):
                rows, y = fit[at : at + 8192], x[at : at + 8192]
                s = half - y @ centroids.T
                near = s.argmin(axis=1)
                d = np.sqrt(((y - centroids[near]) ** 2).sum(axis=1))
                second = near
                if len(centroids) > 1:
                    s[np.arange(len(y)), near] = np.inf
                    second = s.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(rows)), _floats(y), pa.array(near.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(d)], ["id", "vector", "cluster_id", "second", "d"])

    return df.select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, f"id {id_type}, vector array<float>, cluster_id int, second int, d double")


def key_dimensions(placed: DataFrame, dim: int, most: int = KEY_DIMS) -> DataFrame:
    """``cluster_id, key_dims``: the dimensions of largest variance in each cluster, largest first. Sums leave the tasks, not rows."""

    def sums(batches):
        total: dict = {}
        for b in batches:
            fit, x = _matrix(b.column("vector"), dim)
            own = b.column("cluster_id").to_numpy()[fit]
            for c in np.unique(own):
                y = x[own == c]
                n, s, q = total.get(c, (0, 0.0, 0.0))
                total[c] = (n + len(y), s + y.sum(0), q + (y**2).sum(0))
        for c, (n, s, q) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, c, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, float(n))), pa.array(s), pa.array(q)], ["cluster_id", "pos", "n", "s", "q"])

    parts = placed.select("cluster_id", "vector").mapInArrow(sums, "cluster_id int, pos int, n double, s double, q double")
    whole = parts.groupBy("cluster_id", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = F.struct((-(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("v"), "pos")
    return whole.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_list(spread)), 1, most).alias("k")).select("cluster_id", F.transform("k", lambda x: x["pos"]).alias("key_dims"))


def spill_targets(placed: DataFrame) -> DataFrame:
    """``cluster_id, target``: the cluster that is most often second nearest for the rows of a cluster (ties: the smaller)."""
    counts = placed.where("second <> cluster_id").groupBy("cluster_id", "second").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster_id").agg(F.max(F.struct("n", (-F.col("second")).alias("t")))["t"].alias("t")).select("cluster_id", (-F.col("t")).alias("target"))


def build(df: DataFrame, path: str, lists: int, *, id_col: str = "id", vec_col: str = "vector", pq: int = 0, spill: bool = True, steps: int = 50, seed: int = 42, centroids: DataFrame | None = None, rows_per_file: int = 500_000) -> StoredIndex:
    """Train, place and write the index. ``pq`` subspaces of residual codes (0: none). ``centroids`` (``cluster_id, centroid``) stand in for training.

    The centroids are fitted on 256 rows a list (:func:`cluster.fit_kmeans`), the codec on ``quant.SAMPLE_ROWS`` residuals; every row is placed and coded. A large list
    is written by several tasks.
    """
    spark = df.sparkSession
    model = cluster.fit_kmeans(df, lists, vec_col=vec_col, steps=steps, seed=seed) if centroids is None else centroids
    names, c = cluster._model(model, 65_536)
    if list(names) != list(range(len(names))):
        raise ValueError("clusters must be numbered from 0")
    placed = place(df, c, id_col=id_col, vec_col=vec_col)
    codec = None
    if pq:
        some = placed.select("cluster_id", "vector")
        total = some.count()
        share = min(1.0, quant.SAMPLE_ROWS / max(1, total))
        got = some.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * share) + 1).limit(2 * quant.SAMPLE_ROWS).toArrow().combine_chunks()
        _, x = _matrix(got.column("vector").combine_chunks(), c.shape[1])
        codec = quant.Product.train((x - c[got.column("cluster_id").to_numpy()]).astype(np.float32), pq)

    def code(batches):
        for b in batches:
            _, x = _matrix(b.column("vector"), c.shape[1])
            own = codec.encode((x - c[b.column("cluster_id").to_numpy()]).astype(np.float32)) if codec else None
            codes = pa.array([r.tobytes() for r in own], pa.binary()) if codec else pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("id", "vector", "cluster_id", "second", "d")), codes], ["id", "vector", "cluster_id", "second", "d", "code"])

    coded = placed.mapInArrow(code, f"id {placed.schema['id'].dataType.simpleString()}, vector array<float>, cluster_id int, second int, d double, code binary")
    files = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-(df.count()) // rows_per_file))))
    coded.repartition("cluster_id", files).sortWithinPartitions("cluster_id", "d").write.partitionBy("cluster_id").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    about = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
    targets = spill_targets(rows) if spill else spark.createDataFrame([], "cluster_id int, target int")
    lists_df = model.select(F.col("cluster_id").cast("int").alias("cluster_id"), "centroid").join(about, "cluster_id", "left").join(targets, "cluster_id", "left").join(key_dimensions(rows, c.shape[1]), "cluster_id", "left")
    lists_df.select("cluster_id", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("key_dims", F.array().cast("array<int>")).alias("key_dims")).coalesce(1).write.parquet(f"{path}/lists")
    spark.createDataFrame([(bytearray(pickle.dumps(codec)),)], "codec binary").coalesce(1).write.parquet(f"{path}/codec")
    return StoredIndex(spark, path)


class StoredIndex:
    """An index that :func:`build` wrote."""

    def __init__(self, spark: SparkSession, path: str, most: int = 65_536):
        self.spark, self.path = spark, path
        self.rows = spark.read.parquet(f"{path}/rows")
        self.lists = spark.read.parquet(f"{path}/lists")
        got = self.lists.orderBy("cluster_id").limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} lists")
        self.centroids = np.array([r.centroid for r in got], np.float64)
        self.radius, self.target, self.n = (np.array([r[x] for r in got]) for x in ("radius", "target", "n"))
        self.key_dims = [np.array(r.key_dims, np.int64) for r in got]
        self.codec = pickle.loads(bytes(spark.read.parquet(f"{path}/codec").first()[0]))

    def route(self, q: np.ndarray, nprobe: int, gamma: float = 0.0, metric: str = "l2") -> list[np.ndarray]:
        """Probed clusters of each query, nearest first. With ``gamma`` the spill targets of probes near the best one are added:
        within (1 + gamma) of its distance, or at least (1 - gamma) of its similarity."""
        c = self.centroids
        s = q @ c.T
        if metric == "l2":
            far = np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * s, 0)
        else:
            far = -(s / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None], 1e-30) if metric == "cosine" else s)
        order = np.argsort(far, axis=1, kind="stable")[:, : min(nprobe, len(c))]
        out = []
        for f, near in zip(far, order):
            more = []
            if gamma > 0 and len(near):
                best = f[near[0]]
                bound = best * (1 + gamma) if metric == "l2" else best * (1 - gamma)
                more = [t for t in self.target[near[f[near] <= bound]] if t >= 0 and t not in near]
            out.append(np.concatenate([near, np.array(list(dict.fromkeys(more)), np.int64)]))
        return out

    def _queries(self, queries: DataFrame, most: int):
        rows = queries.select("qid", F.col("qvec").cast("array<double>").alias("v")).where("qid is not null and v is not null").dropDuplicates(["qid"]).orderBy("qid").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} queries in a call; split them")
        rows = [r for r in rows if len(r.v) == self.centroids.shape[1]]
        return [r.qid for r in rows], np.array([r.v for r in rows], np.float64).reshape(len(rows), self.centroids.shape[1])

    def search(self, queries: DataFrame, k: int, *, nprobe: int, metric: str = "l2", gamma: float = 0.0, min_score: float | None = None, codes: bool = False, rescore: int = 4, prune: bool = True, most_queries: int = 4096) -> DataFrame:
        """``qid, id, score, rank`` on the raw scale: minus the squared distance (``l2``), the dot product (``dot``, ``mip``) or the ``cosine``.

        ``prune`` skips, for ``l2``, lists and rows that cannot reach a query's k best in the task so far: by the triangle
        inequality over the list's radius and the row's distance to its centroid, and by the distance in the list's key
        dimensions; it changes no result. With ``codes`` the residual codes are scanned in place of the rows, the
        ``k x rescore`` best go on, and unless ``rescore`` is 1 they are ranked by their exact scores.
        """
        names, q = self._queries(queries, most_queries)
        if not len(names):
            return self.spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, score double, rank int")
        probed = self.route(q, nprobe, gamma, metric)
        asked: dict[int, np.ndarray] = {}
        for i, cs in enumerate(probed):
            for c in cs:
                asked.setdefault(int(c), []).append(i)
        asked = {c: np.array(i) for c, i in asked.items()}
        wanted = self.rows.where(F.col("cluster_id").isin(sorted(asked)))
        schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {self.rows.schema['id'].dataType.simpleString()}, score double"
        if codes:
            if self.codec is None:
                raise ValueError("the index holds no codes")
            coarse = rank_by(wanted.select("id", "cluster_id", "code").mapInArrow(self._scan_codes(names, q, asked, k * rescore, metric, schema), schema + ", cluster_id int"), ["qid"], "score", "id", k * rescore)
            if rescore == 1:
                found = coarse.select("qid", "id", "score")
            else:
                found = self._exact(coarse.select("qid", "id", "cluster_id"), wanted, queries, metric)
        else:
            found = wanted.select("id", "cluster_id", "d", "vector").mapInArrow(self._scan(names, q, asked, k, metric, prune and metric == "l2", schema), schema)
        if min_score is not None:
            found = found.where(F.col("score") >= min_score)
        return rank_by(found, ["qid"], "score", "id", k)

    @staticmethod
    def _exact(candidates: DataFrame, rows: DataFrame, queries: DataFrame, metric: str) -> DataFrame:
        from ..functions import vecmath as V

        both = candidates.join(rows.select("cluster_id", "id", "vector"), ["cluster_id", "id"]).join(queries.select("qid", "qvec"), "qid")
        score = {"l2": -V.square_distance(F.col("vector"), F.col("qvec")), "cosine": V.cosine(F.col("vector"), F.col("qvec"))}.get(metric, V.dot(F.col("vector"), F.col("qvec")))
        return both.select("qid", "id", score.alias("score"))

    def _scan(self, names, q, asked, k, metric, prune, schema):
        sent = self.spark.sparkContext.broadcast((names, q, asked))
        centroids, radius, key_dims, dim = self.centroids, self.radius, self.key_dims, self.centroids.shape[1]
        target = _arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, asked = sent.value
            qn = (q**2).sum(1)
            rows, ids, best = np.empty(0, np.int64), None, np.empty(0)
            bound = np.full(len(q), -np.inf)  # a query's k-th best score so far
            for b in batches:
                if not b.num_rows:
                    continue
                fit, x_all = _matrix(b.column("vector"), dim)
                id_all = b.column("id").take(pa.array(fit)).to_numpy(zero_copy_only=False)
                own, d_all = b.column("cluster_id").to_numpy()[fit], b.column("d").to_numpy()[fit]
                ids = id_all[:0] if ids is None else ids
                for c in np.unique(own):
                    at, who = np.flatnonzero(own == c), asked[int(c)]
                    if prune:
                        reach = np.sqrt(np.maximum(qn[who] + (centroids[c] ** 2).sum() - 2 * q[who] @ centroids[c], 0))
                        who = who[np.maximum(reach - radius[c] - 1e-6, 0) ** 2 <= -bound[who]]
                    if not len(who):
                        continue
                    x, d, pid = x_all[at], d_all[at], id_all[at]
                    if prune and np.isfinite(bound[who]).all():
                        reach = np.sqrt(np.maximum(qn[who] + (centroids[c] ** 2).sum() - 2 * q[who] @ centroids[c], 0))
                        near = (np.maximum(np.abs(reach[:, None] - d[None]) - 1e-6, 0) ** 2 <= -bound[who][:, None]).any(axis=0)
                        keys = key_dims[c]
                        if len(keys):
                            part = ((q[who][:, None, keys] - x[None][:, :, keys]) ** 2).sum(axis=2)
                            near &= (part <= -bound[who][:, None] + 1e-9).any(axis=0)
                        x, pid = x[near], pid[near]
                    if not len(x):
                        continue
                    dot = q[who] @ x.T
                    if metric == "l2":
                        s = -((q[who][:, None] - x[None]) ** 2).sum(axis=2) if len(who) * x.size < 4_000_000 else -np.maximum(qn[who][:, None] + (x**2).sum(1)[None] - 2 * dot, 0)
                    elif metric == "cosine":
                        s = dot / np.sqrt(np.maximum(qn[who][:, None] * (x**2).sum(1)[None], 1e-300))
                    else:
                        s = dot
                    i, j = np.nonzero(s >= bound[who][:, None])
                    rows, ids, best = _keep_best(np.concatenate([rows, who[i]]), np.concatenate([ids, pid[j]]), np.concatenate([best, s[i, j]]), k)
                    full = np.bincount(rows, minlength=len(q)) == k
                    low = np.full(len(q), np.inf)
                    np.minimum.at(low, rows, best)
                    bound[full] = low[full]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows]), pa.array(ids.tolist()), pa.array(best)], ["qid", "id", "score"]).cast(target)

        return run

    def _scan_codes(self, names, q, asked, wide, metric, schema):
        sent = self.spark.sparkContext.broadcast((names, q, asked))
        centroids, codec = self.centroids, self.codec
        target = _arrow_schema(schema + ", cluster_id int")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, asked = sent.value
            rows, ids, best, where = np.empty(0, np.int64), None, np.empty(0), np.empty(0, np.int32)
            norms = [(book**2).sum(1) for book in codec.books]
            for b in batches:
                if not b.num_rows:
                    continue
                id_all, own = b.column("id").to_numpy(zero_copy_only=False), b.column("cluster_id").to_numpy()
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                ids = id_all[:0] if ids is None else ids
                for c in np.unique(own):
                    at = np.flatnonzero(own == c)
                    length = sum(n[codes[at, i]] for i, n in enumerate(norms))
                    for i in asked[int(c)]:
                        r = q[i] - centroids[c] if metric == "l2" else q[i]
                        s = sum(t[codes[at, m]] for m, t in enumerate(codec.tables(r)))
                        s = 2 * s - length - r @ r if metric == "l2" else s + q[i] @ centroids[c]
                        top = np.argpartition(-s, wide - 1)[:wide] if len(s) > wide else np.arange(len(s))
                        rows, ids, best, where = np.concatenate([rows, np.full(len(top), i)]), np.concatenate([ids, id_all[at][top]]), np.concatenate([best, s[top]]), np.concatenate([where, np.full(len(top), c, np.int32)])
                order = np.lexsort((ids, -best, rows))
                first = np.searchsorted(rows[order], rows[order])
                keep = order[np.arange(len(order)) - first < wide]
                rows, ids, best, where = rows[keep], ids[keep], best[keep], where[keep]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows]), pa.array(ids.tolist()), pa.array(best), pa.array(where)], ["qid", "id", "score", "cluster_id"]).cast(target)

        return run


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def split_tree(df: DataFrame, *, id_col: str = "id", vec_col: str = "vector", least: int = 64, depth: int = 16, steps: int = 20, seed: int = 42) -> DataFrame:
    """``id, node``: rows in the leaves of a tree of two-way splits; the children of node p are 2p + 1 and 2p + 2, the root is 0.

    A node of at least ``least`` rows is split by k-means of two, as long as both sides get rows. All nodes of a level are
    split at once: their centres are fitted on about 2,048 rows of each and are the only thing sent to the tasks.
    """
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vector"), F.lit(0).cast("bigint").alias("node"))
    from .runtime import discard, materialise

    now = materialise(rows, "tree")
    kind, fixed = now.schema["id"].dataType.simpleString(), set()
    for level in range(depth):
        sizes = {r.node: r["count"] for r in now.groupBy("node").count().where(F.col("count") >= least).collect() if r.node not in fixed}
        if not sizes:
            break
        share = F.create_map(*[v for n, c in sizes.items() for v in (F.lit(n), F.lit(2048.0 / c))])
        some = now.where(F.col("node").isin(list(sizes))).where(F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < (1 << 30) * F.element_at(share, F.col("node")))

        def fit(key, pdf):
            import pandas as pd

            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            c = quant._lloyd(x, 2, np.random.default_rng(seed), steps)
            return pd.DataFrame({"node": [key[0]], "centers": [c.ravel().tolist()]})

        centers = {r.node: np.array(r.centers).reshape(-1, len(r.centers) // 2) for r in some.groupBy("node").applyInPandas(fit, "node bigint, centers array<double>").collect() if len(r.centers)}

        def move(batches, centers=centers):
            for b in batches:
                node = b.column("node").to_numpy().copy()
                for n, c in centers.items():
                    at = np.flatnonzero(node == n)
                    if len(at):
                        _, x = _matrix(b.column("vector").take(pa.array(at)), c.shape[1])
                        node[at] = 2 * n + 1 + (((x - c[0]) ** 2).sum(1) > ((x - c[1]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), pa.array(node)], ["id", "vector", "node"])

        nxt = materialise(now.mapInArrow(move, f"id {kind}, vector array<float>, node bigint"), "tree")
        fixed |= {n for n, c in sizes.items() if n not in centers}
        # a node whose rows all went one way cannot be split further
        got = {r.node: r["count"] for r in nxt.groupBy("node").count().collect()}
        fixed |= {x for n in centers for x in (2 * n + 1, 2 * n + 2) if got.get(x, 0) == sizes[n]}
        discard(now)
        now = nxt
    return now.select("id", "node")


def search_with_log(index: StoredIndex, log, queries: DataFrame, k: int, *, nprobe: int, metric: str = "l2", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The index's hits and those among the rows of ``log`` (a WriteAheadLog) that it does not hold yet, which are scanned exactly.

    A logged row stands in for the indexed one of its id, the last segment for earlier ones.
    """
    from .runtime import latest_version
    from .search import search_batch

    fresh = log.replay()
    if fresh is None:
        return index.search(queries, k, nprobe=nprobe, metric=metric)
    rows = latest_version(fresh, id_col, ["segment"]).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    # as many more hits as logged ids could take away
    old = index.search(queries, k + rows.count(), nprobe=nprobe, metric=metric).select("qid", "id", "score").join(rows.select("id"), "id", "left_anti")
    new = search_batch(rows, queries, k, metric="dot" if metric == "mip" else metric)
    s = F.col("score")
    raw = {"l2": 1 - 1 / s, "cosine": 2 * s - 1}.get(metric, 2 * s - 1)
    return rank_by(old.select("qid", "id", "score").unionByName(new.select("qid", "id", raw.alias("score"))), ["qid"], "score", "id", k)


class Tiered:
    """A cluster index with a hot tier: codes of the often probed lists are kept apart and scanned in place of their rows.

    ``probed`` counts a list's visits; lists visited at least ``hot_after`` times are coded on one byte a dimension at the next
    :meth:`promote`; others stay as rows on storage. Hot lists give ``k x over`` candidates by code, which are
    ranked exactly with the rows of the cold ones.
    """

    def __init__(self, index: StoredIndex, hot_after: int = 2):
        self.index, self.hot_after, self.visits, self.hot = index, hot_after, np.zeros(len(index.centroids), np.int64), None
        self.lists: list[int] = []

    def promote(self) -> list[int]:
        from .runtime import materialise

        self.lists = np.flatnonzero(self.visits >= self.hot_after).tolist()
        rows = self.index.rows.where(F.col("cluster_id").isin(self.lists))
        self.codec = quant.train("sq8", rows)
        self.hot = materialise(quant.encode(rows, self.codec).join(rows.select("id", "cluster_id"), "id"), "hot")
        return self.lists

    def search(self, query, k: int, *, nprobe: int, over: float = 4.0, metric: str = "l2") -> DataFrame:
        q = np.asarray(query, np.float64)[None]
        lists = self.index.route(q, nprobe, metric=metric)[0].tolist()
        self.visits[lists] += 1
        hot = [c for c in lists if c in self.lists]
        wanted = self.index.rows.where(F.col("cluster_id").isin([c for c in lists if c not in hot])).select("id", "vector")
        if hot:
            codec, n = self.codec, max(k, int(np.ceil(k * over)))
            picked = quant.approximate_scores(self.hot.where(F.col("cluster_id").isin(hot)), codec, q[0]) if metric != "l2" else _by_decoded_distance(self.hot.where(F.col("cluster_id").isin(hot)), codec, q[0])
            near = picked.orderBy(F.desc("coarse"), "id").limit(n).select("id")
            wanted = wanted.unionByName(self.index.rows.where(F.col("cluster_id").isin(hot)).join(near, "id", "left_semi").select("id", "vector"))
        from .search import search

        return search(wanted, q[0].tolist(), k, metric=metric, raw=True)


def _by_decoded_distance(codes: DataFrame, codec, q: np.ndarray) -> DataFrame:
    id_type = codes.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = codec.decode(np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1), len(q))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(-((x - q) ** 2).sum(axis=1))], ["id", "coarse"])

    return codes.mapInArrow(run, f"id {id_type}, coarse double")
