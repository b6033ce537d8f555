"""One ranking from several differently-scaled scores: a Borda count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.runtime import materialise


def borda(scores: DataFrame, top: DataFrame, *, weights: dict[str, float] | None = None) -> DataFrame:
    """The best ``top_n`` ids of every query: ``qid, id, points, place``.

    ``scores``: ``qid, list, id, score`` (double), higher is better; ``top``: ``qid, top_n``, one row per query.
    In each list the ids are ranked by score, ties sharing the average of their places. An id
    without a usable score in a list (absent, null or NaN) gets the mid-rank of the places left
    over, as if all such ids were tied there. An id gains, from each list, its list's weight
    (default 1) times the places it is ahead of that mid-rank; the sum ranks, ties by the
    smaller id. Only ranks enter, so no list prevails by its range. Repeated ids of a list count
    once, with their best score. Queries without ``top_n`` and ids, lists or qids that are null
    are left out.
    """
    wanted = top.where("qid is not null and top_n is not null").groupBy("qid").agg(F.max("top_n").alias("top_n"))
    s = F.col("score")
    clean = scores.where("qid is not null and list is not null and id is not null").select("qid", "list", "id", F.when(~F.isnan(s), s.cast("double")).alias("score"))
    # read three times below, so written once
    one = materialise(clean.join(wanted.select("qid"), "qid", "left_semi").groupBy("qid", "list", "id").agg(F.max("score").alias("score")), "scores")
    # ranks come from the distinct scores of a list, counted before the shuffle
    levels = one.where("score is not null").groupBy("qid", "list", "score").agg(F.count("*").alias("same"))
    w = Window.partitionBy("qid", "list")
    placed = levels.select(
        "qid", "list", "score",
        (F.coalesce(F.sum("same").over(w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("same") + 1) / 2).alias("rank"),
        F.sum("same").over(w).alias("n_scored"),
    )
    weight = F.lit(1.0)
    for name, v in sorted((weights or {}).items()):
        weight = F.when(F.col("list") == name, F.lit(float(v))).otherwise(weight)
    # the ids of a query add half their number to every place; it is known once the ids are rows
    gains = one.join(placed, ["qid", "list", "score"], "left").select("qid", "id", weight.alias("w"), ((F.col("n_scored") + 1) / 2 - F.col("rank")).alias("ahead"))
    scored = F.col("ahead").isNotNull()
    sums = gains.groupBy("qid", "id").agg(F.coalesce(F.sum(F.when(scored, F.col("w") * F.col("ahead"))), F.lit(0.0)).alias("ahead"), F.coalesce(F.sum(F.when(scored, F.col("w"))), F.lit(0.0)).alias("w"))
    points = sums.select("qid", "id", F.round(F.col("ahead") + F.col("w") * F.count("*").over(Window.partitionBy("qid")) / 2, 6).alias("points"))
    best = points.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("points"), "id")))
    return best.join(wanted, "qid").where(F.col("place") <= F.col("top_n")).select("qid", "id", "points", "place")


def latest_runs(lists: DataFrame) -> DataFrame:
    """``qid, list, id, score``: of every retriever of a query only its last run (latest ``ran_at``, then greatest ``list_id``)."""
    run = F.struct("ran_at", "list_id")
    last = lists.where("qid is not null and retriever is not null").groupBy("qid", "retriever").agg(F.max(run).alias("run")).select("qid", "retriever", F.col("run.list_id").alias("list_id"))
    return lists.join(last, ["qid", "retriever", "list_id"], "left_semi").select("qid", F.col("retriever").alias("list"), "id", F.col("score").cast("double").alias("score"))
