"""Clustered indexes: centroids, k-means, routing to clusters, and per-dimension statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vecmath as V
from .search import rank_by


def mean_vector(df: DataFrame, vec_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Elementwise mean per group: ``centroid array<double>, n``. Sums combine on the map side by (group, position)."""
    parts = df.where(F.col(vec_col).isNotNull()).select(*by, F.posexplode(vec_col).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def dimension_variance(df: DataFrame, vec_col: str) -> DataFrame:
    """``pos, variance``: population variance of every dimension."""
    return df.select(F.posexplode(vec_col).alias("pos", "x")).groupBy("pos").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def sparsity(df: DataFrame, vec_col: str) -> DataFrame:
    """Share of zero entries over all embeddings."""
    zeros = F.sum(F.size(F.filter(vec_col, lambda x: x == 0)))
    return df.agg((zeros / F.sum(F.size(vec_col))).alias("sparsity"))


def intrinsic_dimension(df: DataFrame, vec_col: str, *, rows: int = 1024, share: float = 0.9, seed: int = 42) -> int:
    """Principal components that hold ``share`` of the variance, on a documented sample of at most ``rows`` embeddings."""
    x = np.array([r[0] for r in df.select(vec_col).where(F.col(vec_col).isNotNull()).orderBy(F.rand(seed)).limit(rows).collect()], float)
    if len(x) < 2:
        return 0
    v = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    total = v.sum()
    return int(np.searchsorted(np.cumsum(v) / total, share) + 1) if total > 0 else 0


def _model(centroids: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids are model state: at most ``most`` are accepted for sending to every task."""
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)


def nearest_centroids(df: DataFrame, centroids: DataFrame, n: int = 1, *, id_col: str = "id", vec_col: str = "vector", most: int = 65_536) -> DataFrame:
    """``id, cluster_id, d2``: the ``n`` nearest centroids of every row (ties: the smaller id), by one matrix product per
    Arrow batch. Rows without a vector of the centroids' length are left out."""
    names, c = _model(centroids, most)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, cluster_id bigint, d2 double"
    if not len(c):
        return df.sparkSession.createDataFrame([], schema)
    n = min(n, len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit = np.flatnonzero(pc.fill_null(pc.list_value_length(b.column("v")), -1).to_numpy(zero_copy_only=False) == c.shape[1])
            if not len(fit):
                continue
            x = b.column("v").take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1).astype(np.float64)
            d2 = (x**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * x @ c.T
            near = np.argsort(d2, axis=1, kind="stable")[:, :n] if n > 1 else d2.argmin(axis=1)[:, None]
            exact = ((x[:, None, :] - c[near]) ** 2).sum(axis=2)
            ids = b.column("i").take(pa.array(np.repeat(fit, n)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(names[near].ravel()), pa.array(exact.ravel())], ["id", "cluster_id", "d2"])

    return df.select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, schema)


def assign(df: DataFrame, centroids: DataFrame, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    return nearest_centroids(df, centroids, 1, id_col=id_col, vec_col=vec_col)


def quantization_error(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.avg("d2").alias("error"))


def train_kmeans(df: DataFrame, k: int, *, vec_col: str = "vector", steps: int = 50, seed: int = 42) -> DataFrame:
    """``cluster_id, centroid`` by distributed k-means with parallel seeding (spark.ml); stops early when settled."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k == 1:
        return mean_vector(df, vec_col).select(F.lit(0).cast("bigint").alias("cluster_id"), "centroid")
    x = df.where(F.col(vec_col).isNotNull()).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=steps, initMode="k-means||").fit(x)
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster_id bigint, centroid array<double>")


def fit_kmeans(df: DataFrame, k: int, *, vec_col: str = "vector", rows_per_list: int = 256, most_rows: int = 262_144, steps: int = 50, seed: int = 42) -> DataFrame:
    """``cluster_id, centroid`` by k-means on a bounded sample: ``rows_per_list`` rows a list, at most ``most_rows`` in all.

    For indexes, whose lists decide only what a search visits: one scan, then numpy on the driver.
    """
    from .quant import _lloyd, sample_embeddings

    x = sample_embeddings(df, vec_col, min(most_rows, rows_per_list * k), seed).astype(np.float64)
    c = _lloyd(x, k, np.random.default_rng(seed), steps) if len(x) else np.empty((0, 0))
    return df.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cluster_id bigint, centroid array<double>")


def split_cluster(df: DataFrame, *, vec_col: str = "vector", least: int = 64, leaves: int = 2, seed: int = 42) -> DataFrame:
    """Bisecting k-means over one oversized cluster: adds ``child``; a cluster under ``least`` rows stays whole."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    if df.limit(least).count() < least:
        return df.withColumn("child", F.lit(0))
    x = df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))
    return BisectingKMeans(k=leaves, seed=seed).fit(x).transform(x).drop("features").withColumnRenamed("prediction", "child")


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, *, spill: DataFrame | None = None, gamma: float = 0.0) -> DataFrame:
    """``qid, cluster_id, d2``: the nprobe nearest clusters of each query.

    With ``gamma`` > 0, probes within (1 + gamma) of the nearest also add their spill target (``cluster_id, target``).
    Centroids are sent to the tasks as model state.
    """
    near = nearest_centroids(queries, centroids, nprobe, id_col="qid", vec_col="qvec").withColumnRenamed("id", "qid")
    if spill is None or gamma <= 0:
        return near
    low = near.groupBy("qid").agg(F.min("d2").alias("low"))
    extra = near.join(low, "qid").where(F.col("d2") <= F.col("low") * (1 + gamma)).join(F.broadcast(spill), "cluster_id").select("qid", F.col("target").alias("cluster_id"), "d2")
    return near.unionByName(extra).groupBy("qid", "cluster_id").agg(F.min("d2").alias("d2"))


def enough_probes(assigned: DataFrame, queries: DataFrame, truth: DataFrame, centroids: DataFrame, target: float) -> int:
    """The fewest nearest clusters of a query that hold at least ``target`` of its true neighbours, over all ``queries``.

    ``assigned``: ``id, cluster_id`` of all rows; ``truth``: ``qid, id``. That share is the recall of :func:`ivf_search`
    with so many probes, since a true neighbour in a probed cluster is always found. No truth: all clusters.
    """
    lists = centroids.count()
    order = Window.partitionBy("qid").orderBy("d2", "cluster_id")
    near = probes(queries, centroids, lists).withColumn("nth", F.row_number().over(order)).select("qid", "cluster_id", "nth")
    held = truth.select("qid", "id").join(assigned.select("id", "cluster_id"), "id").join(near, ["qid", "cluster_id"])
    count = {r.nth: r["count"] for r in held.groupBy("nth").count().collect()}
    upto, total = 0, sum(count.values())
    for n in range(1, lists):
        upto += count.get(n, 0)
        if total and upto >= target * total:
            return n
    return lists


def ivf_search(table: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, *, nprobe: int, metric: str = "l2", raw: bool = False, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Search of the probed clusters: ``qid, id, score, rank``. ``table`` carries ``cluster_id`` (partition by it on disk, so
    that the probe list prunes the scan); an equi-join on the cluster brings queries and rows together."""
    p = probes(queries, centroids, nprobe).select("qid", "cluster_id").join(queries, "qid")
    score = (V.raw_score if raw else V.score)(F.col(vec_col), F.col("qvec"), metric)
    hits = table.join(F.broadcast(p) if queries.limit(10_001).count() <= 10_000 else p, "cluster_id").select("qid", F.col(id_col).alias("id"), score.alias("score"))
    return rank_by(hits, ["qid"], "score", "id", k)
