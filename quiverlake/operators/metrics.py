"""Ranking quality: NDCG, recall, precision, F1, MRR; qrels from labels; latency summaries.

``run``: ``qid, doc, score`` (or ``rank``); ``qrels``: ``qid, doc, grade``. Queries without a positive grade are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(run: DataFrame) -> DataFrame:
    """Adds ``rank`` by score, ties by document."""
    if "rank" in run.columns:
        return run.select("qid", "doc", "rank")
    return run.select("qid", "doc", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc")).alias("rank"))


def _gain(grade):
    return F.pow(F.lit(2.0), grade) - 1


def per_query(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``qid, ndcg, recall, precision, f1, rr`` of every query with a positive grade; a query without results scores 0."""
    pos = qrels.where("grade > 0").groupBy("qid", "doc").agg(F.max("grade").alias("grade"))
    best = pos.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "doc")))
    ideal = best.groupBy("qid").agg(
        F.count("*").alias("n_pos"),
        F.sum(F.when(F.col("place") <= k, _gain(F.col("grade")) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("idcg"),
    )
    hit = ranked(run).join(pos, ["qid", "doc"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"),
        F.min("rank").alias("first"),
    )
    j = ideal.join(hit, "qid", "left")
    hits = F.coalesce(F.col("hits"), F.lit(0))
    p, r = hits / F.lit(float(k)), hits / F.col("n_pos")
    return j.select(
        "qid",
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        r.alias("recall"),
        p.alias("precision"),
        F.when(hits == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)).alias("f1"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def summary(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row: the mean of every metric over queries."""
    return means(per_query(run, qrels, k))


def qrels_from_labels(docs: DataFrame, queries: DataFrame, *, id_col: str = "id", label_col: str = "label", tags: bool = False) -> DataFrame:
    """Documents that share a label with a query document are relevant to it: ``qid, doc, grade``.

    ``queries`` (``qid``) is a stated set of document ids against all documents; for metrics over all documents
    :func:`per_query_by_label` needs no pairs.
    """
    d = docs.select(F.col(id_col).alias("doc"), (F.explode(label_col) if tags else F.col(label_col)).alias("label")).where("label is not null")
    a = d.withColumnRenamed("doc", "qid").join(queries.select("qid").distinct(), "qid", "left_semi")
    return a.join(d, "label").where("qid <> doc").select("qid", "doc", F.lit(1).alias("grade")).distinct()


def label_hits(run: DataFrame, docs: DataFrame, k: int, *, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """``qid, n_pos, hits, first``: what metrics by shared label need, from counts per label instead of pairs."""
    d = docs.select(F.col(id_col).alias("doc"), F.col(label_col).alias("label")).where("label is not null")
    sizes = d.groupBy("label").agg((F.count("*") - 1).alias("n_pos"))
    r = ranked(run).join(d.withColumnRenamed("label", "doc_label"), "doc").join(d.select(F.col("doc").alias("qid"), "label"), "qid")
    hit = r.where("label = doc_label and qid <> doc").groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"))
    return d.join(sizes, "label").select(F.col("doc").alias("qid"), "n_pos").join(hit, "qid", "left").fillna(0, ["hits"])


def per_query_by_label(run: DataFrame, docs: DataFrame, k: int, *, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """:func:`per_query` for relevance by shared label, from counts per label: no pairs of documents are made.

    Queries are those of ``run`` whose label another document shares.
    """
    d = docs.select(F.col(id_col).alias("doc"), F.col(label_col).alias("label")).where("label is not null")
    sizes = d.groupBy("label").agg((F.count("*") - 1).alias("n_pos"))
    r = ranked(run)
    asked = r.select("qid").distinct().join(d.withColumnRenamed("doc", "qid"), "qid").join(sizes, "label").where("n_pos > 0")
    hit = (
        r.join(d.withColumnRenamed("label", "doc_label"), "doc").join(d.withColumnRenamed("doc", "qid"), "qid").where("label = doc_label and qid <> doc").groupBy("qid")
        .agg(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"))
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_pos"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    j = asked.join(hit, "qid", "left")
    hits = F.coalesce(F.col("hits"), F.lit(0))
    p, rec = hits / F.lit(float(k)), hits / F.col("n_pos")
    return j.select(
        "qid", F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), rec.alias("recall"), p.alias("precision"),
        F.when(hits == 0, F.lit(0.0)).otherwise(2 * p * rec / (p + rec)).alias("f1"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def means(per: DataFrame) -> DataFrame:
    return per.agg(*[F.avg(c).alias(n) for c, n in (("ndcg", "ndcg"), ("recall", "recall"), ("precision", "precision"), ("f1", "f1"), ("rr", "mrr"))])


def label_coverage(docs: DataFrame, label_col: str = "label", most_unlabelled: float = 0.5) -> DataFrame:
    """``labelled, unlabelled, distinct_labels, usable``; usable while no more than the share is unlabelled."""
    c = docs.agg(F.count(label_col).alias("labelled"), F.sum(F.when(F.col(label_col).isNull(), 1).otherwise(0)).alias("unlabelled"), F.countDistinct(label_col).alias("distinct_labels"))
    return c.withColumn("usable", F.col("unlabelled") <= most_unlabelled * (F.col("labelled") + F.col("unlabelled")))


def latency(samples: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank p50, p95, p99, p99.9, mean and count."""
    ps = (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))
    w = Window.partitionBy(*by).orderBy(value)
    # distinct values with counts first, so a window holds no repeated samples
    c = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    c = c.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    aggs = [F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * p), F.col(value))).alias(name) for name, p in ps]
    return c.groupBy(*by).agg(*aggs, (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.sum("c").alias("n"))
