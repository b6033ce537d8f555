"""Semantic routing, semantic cache lookup and admission rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import search

DEFAULT_ROUTE_DISTANCE = 0.3
DEFAULT_CACHE_SCORE = 0.92
# fixed values: answers holding one of these are not cached
REFUSAL_PHRASES = [
    "unable to", "i can't", "i cannot", "please specify", "not available", "i don't have", "i'm sorry, but i can't",
    "visual content is not available", "specify which", "which image", "which page",
]


def route(routes: DataFrame, queries: DataFrame, *, default: float = DEFAULT_ROUTE_DISTANCE) -> DataFrame:
    """``qid, route, distance, matched``: the route of the nearest reference, if within that route's threshold (inclusive).

    ``routes``: ``ref_id, name, vector, threshold`` (null: the default), ``queries``: ``qid, qvec``. Distance is 1 - cosine;
    ties go to the smaller ``ref_id``. Queries stream in passes against the references.
    """
    best = search.search_batch(routes, queries, 1, metric="cosine", id_col="ref_id")
    named = best.join(routes.select(F.col("ref_id").alias("id"), "name", "threshold"), "id")
    d = F.round(2 - 2 * F.col("score"), 9)
    ok = d <= F.coalesce(F.col("threshold"), F.lit(default))
    return named.select("qid", F.when(ok, F.col("name")).alias("route"), d.alias("distance"), ok.alias("matched"))


def cache_lookup(entries: DataFrame, queries: DataFrame, *, threshold: float = DEFAULT_CACHE_SCORE, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``qid, id, score, hit``: the nearest cached entry of each query; a hit from ``threshold`` on."""
    best = search.search_batch(entries, queries, 1, metric=metric, id_col=id_col, vec_col=vec_col)
    return best.select("qid", "id", "score", (F.col("score") >= threshold).alias("hit"))


def memo_split(texts: DataFrame, memo: DataFrame, key: str = "text") -> DataFrame:
    """Texts with what is already computed for them: ``hit`` tells those that need no model call."""
    known = memo.select(key, "value").dropDuplicates([key])
    return texts.join(known, key, "left").withColumn("hit", F.col("value").isNotNull())


# Admission rules are boolean Columns, true where an answer may be cached.

def reject_refusals(text: Column) -> Column:
    t = F.lower(text)
    out = F.lit(True)
    for p in REFUSAL_PHRASES:
        out = out & ~F.coalesce(t.contains(p), F.lit(False))
    return out


def reject_short(text: Column, least: int) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))


def reject_containing(text: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & ~F.coalesce(F.lower(text).contains(p.lower()), F.lit(False))
    return out


def reject_matching(text: Column, pattern: str) -> Column:
    return ~F.coalesce(text.rlike(pattern), F.lit(False))
