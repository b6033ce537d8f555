"""The pN_ queries over the supplied tables; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runtime import latest_version, materialise
from . import areas, chunks, clusters, fuse_ranks, leaks, neighbours, pairs, subset, tokens

ALIKE = 0.84  # cosine from which two records count as alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_subset(spark, d, one_per_theme=True).select("qid", "id")


def p1_subset(spark: SparkSession, d: str, one_per_theme: bool = False) -> DataFrame:
    """The determinantal choice with its order; a theme may be shown by a hit that isn't its best, or twice."""
    sizes = table(spark, d, "search_queries").where("subset_size is not null").select("qid", "subset_size")
    asked = table(spark, d, "search_hits").join(sizes.select("qid").distinct(), "qid", "left_semi")
    hits = materialise(subset.hits_with_embeddings(asked, table(spark, d, "ingest_docs")), "hits")
    return subset.varied_subset(hits, sizes, alike=ALIKE, one_per_theme=one_per_theme)


def p2_pieces(spark: SparkSession, d: str, with_text: bool = True) -> DataFrame:
    a = table(spark, d, "ingest_docs").select(F.lit("ingest_docs").alias("source"), "id", "mime", "text", F.col("received_at").alias("version"), F.col("batch_no").alias("tie"))
    b = table(spark, d, "text_documents").select(F.lit("text_documents").alias("source"), "id", F.element_at("metadata", "mime").alias("mime"), "text", F.col("indexed_at").alias("version"), F.lit(0).cast("bigint").alias("tie"))
    return chunks.oversized_pieces(a.unionByName(b), table(spark, d, "chunk_limits"), with_text=with_text)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return chunks.cut_kinds(p2_pieces(spark, d, with_text=False))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    points = clusters.live_points(table(spark, d, "ingest_docs"))
    return clusters.similarity_groups(points, dim=64, alike=ALIKE, at_least=5)


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and its three most typical records."""
    points = clusters.live_points(table(spark, d, "ingest_docs"))
    groups = clusters.similarity_groups(points, dim=64, alike=ALIKE, at_least=5)
    return clusters.describe_groups(groups, points, dim=64)


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """Groups of live texts that use the same words, by hashed weighted features."""
    docs = table(spark, d, "text_documents").select("id", "text", "indexed_at")
    points = materialise(clusters.text_points(latest_version(docs, "id", ["indexed_at"])), "points")
    groups = clusters.similarity_groups(points, dim=256, alike=ALIKE)
    return clusters.describe_groups(groups, points, dim=256)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "scored_ids")
    hits = table(spark, d, "search_hits").select("qid", F.lit(" hits").alias("list"), "id", "score")
    scores = fuse_ranks.latest_runs(lists).unionByName(hits)
    enough = lists.where("retriever is not null").groupBy("qid").agg(F.countDistinct("retriever").alias("n")).where("n >= 3").select("qid")
    top = table(spark, d, "search_queries").select("qid", "top_n").join(enough, "qid", "left_semi")
    return fuse_ranks.borda(scores, top).select("qid", "id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbours.nearest_records(table(spark, d, "ingest_docs"), k=5, floor=ALIKE)
    return neighbours.similar_pairs(found).select("id_a", "id_b")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The first defect of every defective pair."""
    return p6_defects(spark, d).where("place = 1").select("pair_source", "pair_key", "defect")


def p6_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect."""
    calls = table(spark, d, "cassette_chats").select(F.lit("cassette_chats").alias("pair_source"), F.col("cassette_key").alias("pair_key"), "prompt", F.col("response_text").alias("answer"))
    chats = pairs.session_pairs(table(spark, d, "chat_messages")).select(F.lit("chat_messages").alias("pair_source"), "pair_key", "prompt", "answer")
    return pairs.flag_pairs(calls.unionByName(chats))


def p7_ids(spark: SparkSession, d: str, vocabulary: str | None = None) -> DataFrame:
    """``vocabulary``: the path of the vocabulary's file on the driver; default ``spark.quiverlake.vocabulary``, else where the box has it."""
    path = vocabulary or spark.conf.get("spark.quiverlake.vocabulary", tokens.VOCABULARY)
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"), vocabulary=path)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return areas.subject_areas(table(spark, d, "documents")).select("doc_id", "area")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents of each area and their share of all documents."""
    docs = table(spark, d, "documents")
    return areas.area_shares(areas.subject_areas(docs), docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


P2_SQL = r"""WITH l AS (SELECT lower(trim(mime)) AS k, max_chars AS m FROM chunk_limits),
a AS (SELECT id, mime, text, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, batch_no DESC) AS r FROM ingest_docs WHERE id IS NOT NULL
UNION ALL SELECT id, metadata['mime'], text, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC) FROM text_documents WHERE id IS NOT NULL),
x AS (SELECT id, text, coalesce(l.m, (SELECT m FROM l WHERE k = '*/*')) AS m FROM a LEFT JOIN l ON l.k = lower(trim(split_part(mime, ';', 1))) WHERE r = 1)
SELECT DISTINCT id AS item_id, CASE WHEN list_max([length(s) for s in string_split_regex(text, '[ \t\r\n。！？]')]) > m THEN 'forced' ELSE 'natural' END AS cut FROM x WHERE length(text) > m"""

P4_SQL = """WITH runs AS (SELECT qid, retriever, list_id, row_number() OVER (PARTITION BY qid, retriever ORDER BY max(ran_at) DESC, list_id DESC) AS r FROM scored_ids WHERE qid IS NOT NULL AND retriever IS NOT NULL GROUP BY qid, retriever, list_id),
s AS (SELECT qid, retriever AS l, id, CASE WHEN isnan(score) THEN NULL ELSE score::DOUBLE END AS score FROM scored_ids JOIN runs USING (qid, retriever, list_id) WHERE r = 1
UNION ALL SELECT qid, ' hits', id, CASE WHEN isnan(score) THEN NULL ELSE score END FROM search_hits),
t AS (SELECT qid, max(top_n) AS n FROM search_queries WHERE top_n IS NOT NULL GROUP BY qid), e AS (SELECT qid FROM scored_ids GROUP BY qid HAVING count(DISTINCT retriever) >= 3),
o AS (SELECT qid, l, id, max(score) AS score FROM s JOIN t USING (qid) JOIN e USING (qid) WHERE id IS NOT NULL GROUP BY qid, l, id), c AS (SELECT qid, count(DISTINCT id) AS ids FROM o GROUP BY qid),
r AS (SELECT qid, l, id, score, rank() OVER (PARTITION BY qid, l ORDER BY score DESC NULLS LAST) + (count(*) OVER (PARTITION BY qid, l, score) - 1) / 2.0 AS rk, count(score) OVER (PARTITION BY qid, l) AS ns FROM o),
p AS (SELECT qid, id, round(sum(CASE WHEN score IS NULL THEN 0 ELSE (ns + 1 + ids) / 2.0 - rk END), 6) AS points FROM r JOIN c USING (qid) GROUP BY qid, id)
SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, id) AS place FROM p) JOIN t USING (qid) WHERE place <= n"""


_USABLE = "len([x for x in v if isfinite(x)]) = 64 AND len(v) = 64 AND list_max([abs(x) for x in v]) > 0"
_LIVE = f"""live AS (SELECT id, precomputed_vector::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, batch_no DESC NULLS LAST) AS r FROM ingest_docs WHERE id IS NOT NULL) WHERE r = 1),
u AS (SELECT id, v FROM live WHERE {_USABLE})"""

P1_SQL = f"""WITH RECURSIVE {_LIVE}, k AS (SELECT qid, max(subset_size) AS k FROM search_queries WHERE subset_size > 0 GROUP BY qid),
h AS (SELECT qid, id, score, vector AS v FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY vector IS NOT NULL DESC, s DESC NULLS LAST) AS r FROM
(SELECT qid, id, CASE WHEN isnan(score) THEN NULL ELSE score END AS s, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, vector::DOUBLE[] AS vector FROM search_hits WHERE qid IS NOT NULL AND id IS NOT NULL)) WHERE r = 1),
f AS (SELECT qid, id, score, v FROM (SELECT h.qid, h.id, h.score, coalesce(h.v, live.v) AS v FROM h JOIN k USING (qid) LEFT JOIN live USING (id)) WHERE {_USABLE}),
e AS (SELECT a.qid, a.id AS a, b.id AS b FROM f a JOIN f b ON a.qid = b.qid AND a.id <> b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.84),
r(qid, id, root) AS (SELECT qid, id, id FROM f UNION SELECT r.qid, e.b, r.root FROM r JOIN e ON e.qid = r.qid AND e.a = r.id WHERE r.root < e.b),
t AS (SELECT qid, id, min(root) AS root FROM r GROUP BY qid, id)
SELECT qid, id FROM (SELECT t.qid, t.id, row_number() OVER (PARTITION BY t.qid, t.root ORDER BY score DESC NULLS LAST, t.id) AS n FROM t JOIN f ON f.qid = t.qid AND f.id = t.id) WHERE n = 1"""

P3_SQL = f"""WITH RECURSIVE {_LIVE}, e AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.84),
r(id, root) AS (SELECT id, id FROM u UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b), t AS (SELECT id, min(root) AS cluster_id FROM r GROUP BY id)
SELECT cluster_id, id FROM t WHERE cluster_id IN (SELECT cluster_id FROM t GROUP BY cluster_id HAVING count(*) >= 5)"""

P5_SQL = f"""WITH {_LIVE}, c AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.id <> b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.84),
n AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM c) WHERE r <= 5) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM n"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole query; the others are tested against brute force in tests/llm."""
    return {"p1_found": P1_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL}
