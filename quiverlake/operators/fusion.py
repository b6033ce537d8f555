"""Rank fusion and diversity re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import sorted_groups
from .search import rank_by


def rrf(lists: DataFrame, k: int, *, constant: int = 60, group: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ``list_id, id, rank``: score is the sum of 1/(constant + rank), ties by id."""
    fused = lists.groupBy(*group, "id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))
    if not group:
        return fused.orderBy(F.desc("score"), "id").limit(k)
    return rank_by(fused, list(group), "score", "id", k)


def with_ranks(lists: DataFrame, by: tuple[str, ...] = ("list_id",)) -> DataFrame:
    return lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))


def weighted(lists: DataFrame, weights: dict, k: int, *, group: tuple[str, ...] = ()) -> DataFrame:
    """Sum of weight times min-max-normalised score of each list; a list of equal scores normalises to 1."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    keys = [*group, "list_id"]
    span = lists.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    weight = F.lit(None).cast("double")
    for name, v in weights.items():
        weight = F.when(F.col("list_id") == F.lit(name), F.lit(float(v))).otherwise(weight)
    unit = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    fused = lists.join(span, keys).withColumn("part", weight * unit).groupBy(*group, "id").agg(F.sum("part").alias("score"))
    if not group:
        return fused.orderBy(F.desc("score"), "id").limit(k)
    return rank_by(fused, list(group), "score", "id", k)


def hybrid(retrieved: list[DataFrame], k: int, *, method: str = "rrf", constant: int = 60, weights: dict | None = None) -> DataFrame:
    """Fuse retrievers' ``id, score`` results. One retriever alone is passed through, raw and untruncated."""
    if len(retrieved) == 1:
        return retrieved[0].select("id", "score")
    parts = [r.select("id", "score").withColumn("list_id", F.lit(i)) for i, r in enumerate(retrieved)]
    lists = parts[0]
    for p in parts[1:]:
        lists = lists.unionByName(p)
    if method == "rrf":
        return rrf(with_ranks(lists), k, constant=constant)
    return weighted(lists, weights or {i: 1.0 for i in range(len(parts))}, k)


def mmr_order(query: np.ndarray, x: np.ndarray, k: int, trade: float = 0.5, metric: str = "cosine") -> list[int]:
    """Maximal marginal relevance: greedily the largest trade * sim(q, c) - (1 - trade) * max sim(c, chosen); ties take the first."""
    q, x = np.asarray(query, np.float64), np.asarray(x, np.float64)
    if metric == "cosine":
        q = q / (np.linalg.norm(q) or 1.0)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)

    def sim(a):
        d = x @ a
        return 1 / (1 + ((x - a) ** 2).sum(axis=1)) if metric == "l2" else (1 + d) / 2

    relevance, redundancy = sim(q), np.zeros(len(x))
    chosen: list[int] = []
    open_ = np.ones(len(x), bool)
    for _ in range(min(k, len(x))):
        value = np.where(open_, trade * relevance - (1 - trade) * redundancy, -np.inf)
        j = int(value.argmax())
        chosen.append(j)
        open_[j] = False
        s = sim(x[j])
        redundancy = s if len(chosen) == 1 else np.maximum(redundancy, s)
    return chosen


def mmr(pool: DataFrame, k: int, *, trade: float = 0.5, metric: str = "cosine") -> DataFrame:
    """MMR of every query over its candidate pool: ``qid, id, place``.

    ``pool``: ``qid, qvec, id, vector, rank``; pools are the bounded result of a search. Candidates without a vector are left out.
    """
    id_type, q_type = pool.schema["id"].dataType.simpleString(), pool.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, "qid"):
            g = g.combine_chunks()
            x = np.array(g.column("vector").to_pylist(), np.float64)
            order = mmr_order(np.array(g.column("qvec")[0].as_py(), np.float64), x, k, trade, metric)
            t = g.select(["qid", "id"]).take(pa.array(order)).append_column("place", pa.array(np.arange(1, len(order) + 1, dtype=np.int32)))
            yield from t.to_batches()

    rows = pool.where("vector is not null and qvec is not null").select("qid", "id", "vector", "qvec", "rank").repartition("qid").sortWithinPartitions("qid", "rank", "id")
    return rows.mapInArrow(run, f"qid {q_type}, id {id_type}, place int")
