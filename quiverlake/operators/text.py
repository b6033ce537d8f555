"""Full-text retrieval over DataFrames: conjunctive search and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9; every other character separates. Null gives null."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, term, tf, len``; one shuffle, combined on the map side."""
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def and_search(docs: DataFrame, query_terms: list[str], k: int, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Documents with all terms: ``id, rank, score`` = 1/rank; order is most occurrences, then id.

    Evaluated per row in the JVM: no postings are built for a single query.
    """
    wanted = F.array(*[F.lit(t) for t in query_terms])
    t = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).where(F.size(F.array_except(wanted, F.col("t"))) == 0)
    hit = t.select("id", F.size(F.filter("t", lambda x: F.array_contains(wanted, x))).alias("n")).orderBy(F.desc("n"), "id").limit(k)
    w = Window.orderBy(F.desc("n"), "id")  # over at most k rows
    return hit.withColumn("rank", F.row_number().over(w)).select("id", "rank", (F.lit(1.0) / F.col("rank")).alias("score"))


def _equals(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query_terms: list[str], k: int, *, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of any matching term: ``id, score``, best first.

    Corpus statistics cover all documents with a text; terms are counted in the row, so only
    (id, length, term counts) of matching documents are shuffled, and statistics are one row.
    """
    t = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    tf = [F.size(F.filter("t", _equals(q))).alias(f"tf{i}") for i, q in enumerate(query_terms)]
    counted = t.select("id", F.size("t").alias("len"), *tf)
    stat = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(query_terms))]).first()  # one row
    both = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(query_terms))))
    if not stat.n:
        return both.select("id", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    for i in range(len(query_terms)):
        f, df = F.col(f"tf{i}").cast("double"), float(stat[f"df{i}"])
        idf = F.log(F.lit(1.0 + (stat.n - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("len") / F.lit(stat.avg)))
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def content_kind(mime: Column, text: Column) -> Column:
    """Kind of content: by the MIME type where that tells, else by the text (empty, json or text)."""
    m = F.lower(mime)
    return (
        F.when(m.startswith("image/"), "image").when(m.startswith("audio/"), "audio").when((m == "application/json") | m.endswith("+json"), "json")
        .when(m.startswith("text/"), "text").when(m.startswith("application/octet-stream"), "binary")
        .when(text.isNull() | (text == ""), "empty").when(looks_like_json(text), "json").otherwise("text")
    )


def looks_like_json(text: Column) -> Column:
    """Whether the text, blanks aside, begins and ends with matching braces or brackets."""
    return F.coalesce(text.rlike(r"(?s)^\s*(\{.*\}|\[.*\])\s*$"), F.lit(False))


def export_text(text: Column, width: int = 120) -> Column:
    """Text for a tab-separated export: tabs and line ends become blanks, at most ``width`` characters."""
    return F.substring(F.regexp_replace(text, "[\\t\\r\\n]", " "), 1, width)
