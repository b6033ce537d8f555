"""Every registered query over the supplied tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vecmath as V
from ..operators import cluster, filters, fusion, graph, ivf, metrics, quant, route, runtime, search, serve, table, text, tune
from ..sources import formats
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def vec(spark, d, i: int = 0) -> list[float]:
    return t(spark, d, "embeddings").where(F.col("vec_id") == i).select("embedding").first()[0]


def r6(c):
    return F.round(c, 6)


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT v AS qv, label AS ql FROM e WHERE id = 0)"
COS = "((1 + list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv)))) / 2)"
DOT = "((1 + list_dot_product(v, qv)) / 2)"
D2 = "list_sum([(v[i] - qv[i]) * (v[i] - qv[i]) for i in range(1, len(v) + 1)])"
L2 = f"(1.0 / (1 + {D2}))"
MIP = "(CASE WHEN list_dot_product(v, qv) >= 0 THEN list_dot_product(v, qv) + 1 ELSE 1.0 / (1 - list_dot_product(v, qv)) END)"


def knn_sql(score: str, where: str = "true", k: int = 10, extra: str = "") -> str:
    return f"WITH {E} SELECT id, round(score, 6) AS score{extra} FROM (SELECT *, {score} AS score FROM e, q) WHERE {where} ORDER BY score DESC, id LIMIT {k}"


def out(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumn("score", r6("score")).select("id", "score", *columns)


# -- search -----------------------------------------------------------------------------------------

@query(knn_sql(COS, f"label <> ql AND {COS} >= 0.5"))
def knn_flagship(spark, d):
    e, q = emb(spark, d), t(spark, d, "embeddings").where("vec_id = 0").select("embedding", "label").first()
    return out(search.search(e, q[0], 10, where=filters.ne("label", q[1]), min_score=0.5))


@query(knn_sql(COS))
def knn_cosine(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10))


@query(knn_sql(DOT))
def knn_dot(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, metric="dot"))


@query(knn_sql(L2))
def knn_l2(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, metric="l2"))


@query(knn_sql(MIP))
def knn_mip(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, metric="mip"))


@query(knn_sql(f"(-{D2})"))
def knn_raw_l2(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, metric="l2", raw=True))


BATCH = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v AS qv FROM e WHERE {{which}}),
s AS (SELECT qid, id, {COS} AS score FROM e, q WHERE {{where}}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)
"""


def batch(spark, d, which: str, k: int, **more) -> DataFrame:
    e = emb(spark, d)
    return search.search_batch(e, e.where(which).select(F.col("id").alias("qid"), F.col("vector").alias("qvec")), k, **more)


@query(BATCH.format(which="id < 20", where="true") + "SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def knn_batch(spark, d, which="id < 20"):
    return batch(spark, d, which, 5).withColumn("score", r6("score"))


@query(BATCH.format(which="id % 20 = 0", where="id <> qid") + "SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_batch_exclude_self(spark, d):
    return batch(spark, d, "id % 20 = 0", 10, exclude_self=True).withColumn("score", r6("score"))


@query(BATCH.format(which="true", where="id <> qid") + "SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def knn_batch_all(spark, d):
    """Every vector against all; the batched throughput path."""
    return batch(spark, d, "true", 10, exclude_self=True).withColumn("score", r6("score"))


@query(knn_sql(COS, "label = 3"))
def knn_filtered_eq(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, where=filters.eq("label", 3)))


@query(knn_sql(COS, "label IN (1, 4, 7)"))
def knn_filtered_in(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, where=filters.isin("label", [1, 4, 7])))


@query(knn_sql(COS, "label >= 2 AND label < 6"))
def knn_filtered_range(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, where=filters.and_(filters.gte("label", 2), filters.lt("label", 6))))


@query(knn_sql(COS, "(label = 1 OR label > 7) AND NOT (label = 9)"))
def knn_filtered_and_or_not(spark, d):
    f = filters.parse_json('{"and": [{"or": [{"field": "label", "eq": 1}, {"field": "label", "gt": 7}]}, {"not": {"field": "label", "eq": 9}}]}')
    return out(search.search(emb(spark, d), vec(spark, d), 10, where=f))


@query(f"WITH {E}, s AS (SELECT *, {COS} AS score FROM e, q ORDER BY score DESC, id LIMIT 40) SELECT id, round(score, 6) AS score FROM s WHERE label = 3 ORDER BY s.score DESC, id LIMIT 10")
def knn_postfilter_compat(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 10, where=filters.eq("label", 3), expansion=4.0))


@query(knn_sql(COS, f"{COS} >= 0.6", 50))
def knn_min_score(spark, d):
    return out(search.search(emb(spark, d), vec(spark, d), 50, min_score=0.6))


@query(knn_sql(COS, "id <> 0"))
def knn_more_like(spark, d):
    return out(search.more_like(emb(spark, d), 0, 10))


@query(f"""WITH {E}, s AS (SELECT id, {COS} AS score, row_number() OVER (PARTITION BY id % 4 ORDER BY {COS} DESC, id) AS r FROM e, q)
SELECT id, round(max(score), 6) AS score FROM s WHERE r <= 10 GROUP BY id ORDER BY max(score) DESC, id LIMIT 10""")
def shard_merge_topk(spark, d):
    return out(search.sharded(emb(spark, d), vec(spark, d), 10, F.pmod("id", F.lit(4))))


@query(knn_sql(COS, "id % 3 = 0"))
def rescore_candidates(spark, d):
    e = emb(spark, d)
    return out(search.rescore(e.where("id % 3 = 0").select("id"), e, vec(spark, d), 10))


HAM = "list_sum([CASE WHEN (v[i] >= 0) <> (qv[i] >= 0) THEN 1 ELSE 0 END for i in range(1, len(v) + 1)])"


@query(f"WITH {E}, h AS (SELECT *, {HAM} AS h FROM e, q), c AS (SELECT * FROM h ORDER BY h, id LIMIT 40) SELECT id, round({COS}, 6) AS score FROM c ORDER BY {COS} DESC, id LIMIT 10")
def rescore_refine(spark, d):
    q = vec(spark, d)
    h = V.hamming(V.sign_bits(F.col("vector"), 64), V.sign_bits(V.literal(q), 64))
    return out(search.refine(emb(spark, d), q, 10, -h))


@query(f"WITH {E} SELECT id, {HAM} AS hamming FROM e, q ORDER BY hamming, id LIMIT 20")
def hamming_topk(spark, d):
    h = V.hamming(V.sign_bits(F.col("vector"), 64), V.sign_bits(V.literal(vec(spark, d)), 64))
    return emb(spark, d).select("id", h.cast("bigint").alias("hamming")).orderBy("hamming", "id").limit(20)


@query(f"WITH {E}, u AS (SELECT * FROM e WHERE id % 5 <> 0 UNION ALL SELECT id, [-x for x in v], label FROM e WHERE id % 5 = 0) SELECT id, round(score, 6) AS score FROM (SELECT *, {COS} AS score FROM u, q) ORDER BY score DESC, id LIMIT 10")
def staged_read_your_writes(spark, d):
    e = emb(spark, d)
    staged = e.where("id % 5 = 0").withColumn("vector", F.transform("vector", lambda x: -x))
    return out(search.search(search.with_staged(e, staged), vec(spark, d), 10))


@query(BATCH.format(which="id < 50", where="id <> qid") + """, h AS (SELECT r.qid, e1.label = e2.label AS ok FROM r JOIN embeddings e1 ON e1.vec_id = r.qid JOIN embeddings e2 ON e2.vec_id = r.id WHERE rank <= 10),
n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label)
SELECT h.qid, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) / max(n.n), 6) AS recall FROM h JOIN embeddings e ON e.vec_id = h.qid JOIN n ON n.label = e.label GROUP BY h.qid""")
def knn_label_recall(spark, d, which="id < 50"):
    run = batch(spark, d, which, 10, exclude_self=True).select("qid", F.col("id").alias("doc"), "rank")
    h = metrics.label_hits(run, emb(spark, d), 10)
    return h.where(which.replace("id", "qid")).select("qid", r6(F.col("hits") / F.col("n_pos")).alias("recall"))


@query(BATCH.format(which="id % 50 = 0", where="id <> qid") + ", g AS (SELECT * FROM r WHERE rank <= 10) SELECT a.qid, round(count(b.id) / 10.0, 6) AS recall FROM g a LEFT JOIN (SELECT * FROM g WHERE rank <= 7) b ON a.qid = b.qid AND a.id = b.id GROUP BY a.qid")
def recall_vs_truth(spark, d, which="id % 50 = 0"):
    truth = batch(spark, d, which, 10, exclude_self=True)
    return search.recall_at(truth.where("rank <= 7"), truth, 10).withColumn("recall", r6("recall"))


# -- filters and metadata -----------------------------------------------------------------------------

@query("SELECT event_id, event_type, value FROM events WHERE NOT coalesce(event_type = 'click', false) AND coalesce(value > 50 AND value <= 90, false)")
def filter_events(spark, d):
    f = filters.and_(filters.ne("event_type", "click"), filters.gt("value", 50), filters.lte("value", 90))
    return filters.apply(t(spark, d, "events"), f).select("event_id", "event_type", "value")


@query("SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(lang = 'en', false)")
def filter_not_missing(spark, d):
    return filters.apply(t(spark, d, "documents"), filters.ne("lang", "en")).select("doc_id", "lang", "source")


@query("SELECT p_partkey FROM part WHERE false")
def filter_no_coercion(spark, d):
    return filters.apply(t(spark, d, "part"), filters.or_(filters.eq("p_size", "5"), filters.gt("p_brand", 1))).select("p_partkey")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 10 AND 20 OR p_brand IN ('Brand#11', 'Brand#22')")
def filter_json_language(spark, d):
    f = filters.parse_json({"or": [{"field": "p_size", "gte": 10, "lte": 20}, {"field": "p_brand", "in": ["Brand#11", "Brand#22"]}]})
    return filters.apply(t(spark, d, "part"), f).select("p_partkey", "p_brand", "p_size")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def filter_typed_metadata(spark, d):
    e = t(spark, d, "events").withColumn("metadata", filters.typed_metadata(F.col("props")))
    return filters.apply(e, filters.gte("k", 50), "metadata").select("event_id", F.element_at("metadata", "k")["num"].alias("k"))


@query("SELECT id, coalesce(nullif(metadata['lang'], ''), 'none') AS lang FROM text_documents WHERE NOT coalesce(metadata['lang'] = 'en', false)")
def filter_string_map(spark, d):
    x = t(spark, d, "text_documents")
    lang = F.element_at("metadata", "lang")
    return x.where(~F.coalesce(lang == "en", F.lit(False))).select("id", F.coalesce(F.when(lang != "", lang), F.lit("none")).alias("lang"))


# -- expressions -------------------------------------------------------------------------------------------

@query(f"""WITH {E} SELECT id, round(list_dot_product(v, qv), 6) AS dot, round({D2}, 6) AS d2, round(list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))), 6) AS cos,
round(list_dot_product(v[9:24], qv[9:24]), 6) AS slice_dot, round(list_sum(v), 6) AS total FROM e, q""")
def vector_expressions(spark, d):
    q, v = V.literal(vec(spark, d)), F.col("vector")
    return emb(spark, d).select("id", r6(V.dot(v, q)).alias("dot"), r6(V.square_distance(v, q)).alias("d2"), r6(V.cosine(v, q)).alias("cos"), r6(V.dot(v, q, 8, 16)).alias("slice_dot"), r6(V.total(v)).alias("total"))


@query(f"""WITH {E}, x AS (SELECT id, [v[i] + qv[i] * 0.5 for i in range(1, len(v) + 1)] AS w FROM e, q), n AS (SELECT id, w, sqrt(list_dot_product(w, w)) AS n FROM x)
SELECT id, round(list_sum([a / n for a in w]), 6) AS unit_sum, round(n, 6) AS norm, round(list_sum([3 * a for a in w]), 6) AS scaled FROM n""")
def vector_arithmetic(spark, d):
    q = V.literal(vec(spark, d))
    x = emb(spark, d).select("id", V.add_scaled(F.col("vector"), q, 0.5).alias("w"))
    return x.select("id", r6(V.total(V.normalize(F.col("w")))).alias("unit_sum"), r6(V.norm(F.col("w"))).alias("norm"), r6(V.total(V.scale(F.col("w"), 3))).alias("scaled"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, v, list_max([abs(x) for x in v]) AS top FROM e)
SELECT id, list_sum([CAST(floor(x * 127 / top + 0.5) AS INTEGER) for x in v])::BIGINT AS code_sum, max(list_max([abs(CAST(floor(x * 127 / top + 0.5) AS INTEGER)) for x in v]))::BIGINT AS code_top FROM m GROUP BY id, v, top""")
def int8_codes(spark, d):
    c = emb(spark, d).select("id", V.int8_max_abs(F.col("vector")).alias("c"))
    return c.select("id", F.aggregate("c", F.lit(0), lambda s, x: s + x).cast("bigint").alias("code_sum"), F.array_max(F.transform("c", lambda x: F.abs(x))).cast("bigint").alias("code_top"))


# -- quantizers ------------------------------------------------------------------------------------------

def _sq_sql(bits: int) -> str:
    top = (1 << bits) - 1
    return f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT id, v, [floor((least(greatest(x, -0.3), 0.3) - (-0.3)) * ({top} / (0.3 - (-0.3))) + 0.5) for x in v] AS q FROM e)
SELECT id, CAST(list_sum(q) AS BIGINT) AS levels, round(list_sum([(v[i] - (-0.3 + q[i] * (0.6 / {top}))) * (v[i] - (-0.3 + q[i] * (0.6 / {top}))) for i in range(1, len(v) + 1)]), 6) AS error FROM c"""


def _sq(spark, d, bits):
    x = emb(spark, d).withColumn("q", quant.scalar_levels(F.col("vector"), -0.3, 0.3, bits))
    return x.select("id", F.aggregate("q", F.lit(0), lambda s, v: s + v).cast("bigint").alias("levels"), r6(V.square_distance(F.col("vector"), quant.scalar_decoded(F.col("q"), -0.3, 0.3, bits))).alias("error"))


@query(_sq_sql(7))
def sq8_roundtrip(spark, d):
    return _sq(spark, d, 7)


@query(_sq_sql(4))
def sq4_roundtrip(spark, d):
    return _sq(spark, d, 4)


@query(f"WITH {E} SELECT id, round(1 - {HAM} / 64.0, 6) AS dot_like, round(1.0 / (1 + 4 * {HAM}), 6) AS l2_like, round((64 - 2 * {HAM}) / 64.0, 6) AS ip_like FROM e, q")
def sign_bit_scores(spark, d):
    h = V.hamming(V.sign_bits(F.col("vector"), 64), V.sign_bits(V.literal(vec(spark, d)), 64))
    return emb(spark, d).select("id", h.alias("h")).select("id", r6(1 - F.col("h") / 64).alias("dot_like"), r6(F.lit(1.0) / (1 + 4 * F.col("h"))).alias("l2_like"), r6((64 - 2 * F.col("h")) / 64).alias("ip_like"))


def quantized(spark, d, kind: str):
    """A codec, the codes and the oversampling that finds 0.93 of the true neighbours of up to 200 ids not divisible by 20."""
    e = emb(spark, d)
    codec = quant.train(kind, e)
    codes = runtime.materialise(quant.encode(e, codec), f"codes-{kind}")
    tried = table.stable_sample(e.where("id % 20 <> 0"), "id", 200).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return codec, codes, quant.enough_over(codes, codec, tried, search.search_batch(e, tried, 10), 10, 0.93)


def stored_codes(spark, d, kind: str):
    """The codec, its codes written once, and the oversampling that holds 0.93 of the true neighbours of other queries."""

    def make(_):
        codec, codes, over = quantized(spark, d, kind)
        return codec, codes, over

    return once(spark, d, f"codes-{kind}", make)


def _two_pass(kind):
    def run(spark, d):
        """Candidates by code, ranked by exact scores: their recall over every id divisible by 20, and a stored row's search for itself."""
        codec, codes, over = stored_codes(spark, d, kind)
        q = query_set(spark, d)
        places = quant.coarse_places(codes, codec, q, search.search_batch(emb(spark, d), q, 10))
        share = float((places <= max(10, math.ceil(10 * over))).mean())
        first = quant.two_pass_search(emb(spark, d), codes, codec, vec(spark, d), 10, over=over).limit(1)
        return first.select(F.lit(kind).alias("codec"), F.lit(share >= 0.9).alias("reached"), (F.col("id") == 0).alias("finds_itself"))

    run.__name__ = f"quantized_{kind}"
    return run


for _kind in quant.KINDS:
    query(f"SELECT '{_kind}' AS codec, true AS reached, true AS finds_itself")(_two_pass(_kind))


# -- clusters and statistics --------------------------------------------------------------------------------

@query("SELECT label, pos - 1 AS pos, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY ALL")
def centroid_by_label(spark, d):
    c = cluster.mean_vector(emb(spark, d), "vector", ("label",))
    return c.select("label", F.posexplode("centroid").alias("pos", "m"), "n").select("label", F.col("pos").cast("bigint").alias("pos"), r6("m").alias("mean"), "n")


@query("SELECT pos - 1 AS pos, round(var_pop(x), 6) AS variance FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY pos ORDER BY var_pop(x) DESC, pos LIMIT 8")
def variance_top_dims(spark, d):
    return cluster.dimension_variance(emb(spark, d), "vector").orderBy(F.desc("variance"), "pos").limit(8).select(F.col("pos").cast("bigint").alias("pos"), r6("variance").alias("variance"))


@query("SELECT round(sum(CASE WHEN x = 0 THEN 1 ELSE 0 END) / count(*), 6) AS sparsity FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def sparsity_ratio(spark, d):
    return cluster.sparsity(emb(spark, d), "vector").select(r6("sparsity").alias("sparsity"))


CENT = """p AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY ALL),
c AS (SELECT label::BIGINT AS cluster_id, list(m ORDER BY pos) AS cv FROM p GROUP BY label), e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT id, v, cluster_id, list_sum([(v[i] - cv[i]) * (v[i] - cv[i]) for i in range(1, 65)]) AS d2 FROM e, c),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS r FROM a) WHERE r = 1)"""


def label_centroids(spark, d) -> DataFrame:
    return cluster.mean_vector(emb(spark, d), "vector", ("label",)).select(F.col("label").cast("bigint").alias("cluster_id"), "centroid")


@query(f"WITH {CENT} SELECT id, cluster_id, round(d2, 6) AS d2 FROM n")
def kmeans_assign_fixed(spark, d):
    return cluster.assign(emb(spark, d), label_centroids(spark, d)).withColumn("d2", r6("d2"))


@query(f"WITH {CENT} SELECT round(avg(d2), 6) AS error FROM n")
def quantization_error(spark, d):
    return cluster.quantization_error(cluster.assign(emb(spark, d), label_centroids(spark, d))).select(r6("error").alias("error"))


@query(f"WITH {CENT} SELECT id AS qid, cluster_id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS r FROM a WHERE id < 20) WHERE r <= 3")
def ivf_probe_fixed(spark, d, which="id < 20"):
    q = emb(spark, d).where(which).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return cluster.probes(q, label_centroids(spark, d), 3).withColumn("d2", r6("d2"))


@query(f"""WITH {CENT}, b AS (SELECT id AS qid, v AS qv, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS r FROM a WHERE id < 20) WHERE r <= 3),
s AS (SELECT qid, n.id, 1.0 / (1 + {D2}) AS score FROM n JOIN b ON n.cluster_id = b.cluster_id)
SELECT qid, id, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def ivf_flat_fixed(spark, d, which="id < 20"):
    e, c = emb(spark, d), label_centroids(spark, d)
    rows = ivf.place(e, cluster._model(c, 1000)[1]).select("id", "vector", "cluster_id")
    q = e.where(which).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return cluster.ivf_search(rows, q, c, 5, nprobe=3).withColumn("score", r6("score"))


_built: dict[tuple[str, str, str], object] = {}


def once(spark, d, what: str, make):
    """What ``make(path)`` builds below this application's folder, built at its first use over a table and then reused."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _built:
        _built[key] = make(f"{runtime.stage_root(spark)}/{what}-{uuid.uuid4().hex}")
    return _built[key]


def stored_ivf(spark, d) -> ivf.StoredIndex:
    """16 lists with codes of 16 bytes for the residuals."""
    return once(spark, d, "ivf", lambda path: ivf.build(emb(spark, d), path, 16, pq=16))


def query_set(spark, d, which: str = "id % 20 = 0") -> DataFrame:
    return emb(spark, d).where(which).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))


def mean_recall(found: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    return search.recall_at(found, truth, k).agg(F.avg("recall").alias("recall"))


def reached(df: DataFrame, bound: float = 0.9) -> DataFrame:
    return df.select((F.col("recall") >= bound).alias("reached"))


REACHED = "SELECT true AS reached"


def ivf_probes(spark, d) -> int:
    """The fewest probes that hold 0.93 of the true neighbours of up to 1,000 other queries (0.9 and a margin for their number)."""

    def count(_):
        e, index = emb(spark, d), stored_ivf(spark, d)
        tried = table.stable_sample(e.where("id % 20 <> 0"), "id", 1000).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
        lists = index.lists.select(F.col("cluster_id").cast("bigint").alias("cluster_id"), "centroid")
        return cluster.enough_probes(index.rows.select("id", "cluster_id"), tried, search.search_batch(e, tried, 10), lists, 0.93)

    return once(spark, d, "probes", count)


def ivf_recall(spark, d, **how) -> DataFrame:
    q = query_set(spark, d)
    return mean_recall(stored_ivf(spark, d).search(q, 10, metric="cosine", nprobe=ivf_probes(spark, d), **how), search.search_batch(emb(spark, d), q, 10))


@query(REACHED)
def ivf_trained_recall(spark, d):
    """Whether the stored clustered index finds at least 0.9 of the true ten neighbours, over every id divisible by 20."""
    return reached(ivf_recall(spark, d))


@query(REACHED)
def ivf_pq_recall(spark, d):
    """The same by the residual codes, of which the best 80 are ranked exactly."""
    return reached(ivf_recall(spark, d, codes=True, rescore=8))


@query(REACHED)
def ivf_spill_recall(spark, d):
    """The same with the spill targets of near probes."""
    return reached(ivf_recall(spark, d, gamma=0.1))


@query("SELECT 16 AS lists, count(*) AS n, true AS radius_holds FROM embeddings")
def ivf_lists(spark, d):
    index = stored_ivf(spark, d)
    within = index.rows.join(index.lists.select("cluster_id", "radius"), "cluster_id").agg(F.min(F.col("d") <= F.col("radius")).alias("radius_holds"))
    return index.lists.agg(F.count("*").cast("int").alias("lists"), F.sum("n").alias("n")).join(within)


@query(BATCH.replace(COS, f"(-{D2})").format(which="id % 20 = 0", where="true") + "SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def ivf_pruned(spark, d):
    """All lists, those and their rows left out that the triangle inequality or the key dimensions exclude: equal to exact search."""
    return stored_ivf(spark, d).search(query_set(spark, d), 10, nprobe=16).withColumn("score", r6("score"))


@query(f"""WITH {CENT}, s AS (SELECT id, max(CASE WHEN r = 1 THEN cluster_id END) AS cluster_id, max(CASE WHEN r = 2 THEN cluster_id END) AS second FROM
(SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster_id) AS r FROM a) WHERE r <= 2 GROUP BY id), f AS (SELECT cluster_id, second, count(*) AS n FROM s WHERE second IS NOT NULL GROUP BY ALL)
SELECT cluster_id, second AS target FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, second) AS r FROM f) WHERE r = 1""")
def ivf_spill_targets(spark, d):
    _, c = cluster._model(label_centroids(spark, d), 1000)
    return ivf.spill_targets(ivf.place(emb(spark, d), c)).select(F.col("cluster_id").cast("bigint").alias("cluster_id"), F.col("target").cast("bigint").alias("target"))


@query("""WITH p AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS pos FROM embeddings), v AS (SELECT label, pos, var_pop(x) AS v FROM p GROUP BY ALL)
SELECT label, pos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v DESC, pos) AS r FROM v) WHERE r <= 8""")
def key_dimensions(spark, d):
    x = emb(spark, d).select(F.col("label").cast("int").alias("cluster_id"), "vector")
    return ivf.key_dimensions(x, 64).select(F.col("cluster_id").alias("label"), F.explode("key_dims").alias("pos")).select("label", F.col("pos").cast("bigint").alias("pos"))


@query("SELECT count(*) AS n, true AS all_small FROM embeddings")
def cluster_split(spark, d):
    """The leaves of a tree of two-way splits over all rows: none has 64 rows or more."""
    sizes = ivf.split_tree(emb(spark, d), least=64).groupBy("node").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") < 64).alias("all_small"))


@query(knn_sql(f"(-{D2})"))
def tiered_scan(spark, d):
    """A second search of the same lists: by then they are hot and give their candidates by code."""
    tiers = ivf.Tiered(stored_ivf(spark, d), hot_after=1)
    tiers.search(vec(spark, d), 10, nprobe=16)
    tiers.promote()
    return out(tiers.search(vec(spark, d), 10, nprobe=16, over=8.0))


def graph_recall(spark, d, kind) -> DataFrame:
    """Mean recall@10 of graph search with 4 graphs, against exact search."""
    e, q = emb(spark, d), query_set(spark, d)
    index = once(spark, d, kind, lambda _: runtime.materialise(graph.build(e, kind, rows_per_graph=max(100, e.count() // 4)), kind))
    return mean_recall(graph.search(index, q, 10), search.search_batch(e, q, 10))


def _graph_reached(kind):
    def run(spark, d):
        return reached(graph_recall(spark, d, kind))

    run.__name__ = f"{kind}_recall"
    return run


for _kind in ("hnsw", "vamana"):
    query(REACHED)(_graph_reached(_kind))


@query(BATCH.format(which="id < 10", where="label = 3") + "SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def graph_filtered(spark, d, which="id < 10"):
    """Wide-beamed search of the graphs that collects only rows of a label while it walks through all."""
    e = emb(spark, d)
    index = once(spark, d, "one-hnsw", lambda _: runtime.materialise(graph.build(e, "hnsw"), "hnsw"))
    return graph.search(index, query_set(spark, d, which), 5, width=4000, allowed=e.where("label = 3").select("id")).withColumn("score", r6("score"))


@query(REACHED)
def graph_filtered_recall(spark, d):
    """The same with a beam of 160, which leaves most of the graph unvisited, over every id divisible by 20."""
    e, q = emb(spark, d), query_set(spark, d)
    index = once(spark, d, "one-hnsw", lambda _: runtime.materialise(graph.build(e, "hnsw"), "hnsw"))
    some = e.where("label = 3")
    return reached(mean_recall(graph.search(index, q, 5, width=160, allowed=some.select("id")), search.search_batch(some, q, 5), 5))


@query(REACHED)
def hnsw_coded_recall(spark, d):
    """Walks over product codes with a wide beam, whose best are ranked exactly."""
    e, q = emb(spark, d), query_set(spark, d)
    index = once(spark, d, "hnsw-coded", lambda _: runtime.materialise(graph.build(e, "hnsw", codes=16), "hnsw"))
    return reached(mean_recall(graph.search(index, q, 10, width=120, coded=8.0), search.search_batch(e, q, 10)))


@query(REACHED)
def hnsw_multi_start_recall(spark, d):
    e, q = emb(spark, d), query_set(spark, d)
    index = once(spark, d, "one-hnsw", lambda _: runtime.materialise(graph.build(e, "hnsw"), "hnsw"))
    return reached(mean_recall(graph.search(index, q, 10, starts=4), search.search_batch(e, q, 10)))


@query("SELECT true AS reached, true AS without_dead")
def hnsw_compacted_recall(spark, d):
    """The graph after every fifth row was deleted: links of the rest are kept and mended, not built anew."""
    e, q = emb(spark, d), query_set(spark, d)
    index = once(spark, d, "one-hnsw", lambda _: runtime.materialise(graph.build(e, "hnsw"), "hnsw"))
    live = e.where("id % 5 <> 1")
    found = graph.search(graph.compact(index, e.where("id % 5 = 1").select("id")), q, 10)
    clean = found.agg(F.min(F.col("id") % 5 != 1).alias("without_dead"))
    return reached(mean_recall(found, search.search_batch(live, q, 10))).join(clean)


# -- fusion, routing, caches ---------------------------------------------------------------------------

TWO = f"""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), qq AS (SELECT id AS list_id, v AS qv FROM e WHERE id IN (0, 1)),
s AS (SELECT list_id, id, {COS} AS score FROM e, qq), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30)
"""


def two_lists(spark, d) -> DataFrame:
    return batch(spark, d, "id in (0, 1)", 30).withColumnRenamed("qid", "list_id")


@query(TWO + "SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 20")
def rrf_fusion(spark, d):
    return out(fusion.rrf(two_lists(spark, d), 20))


@query(TWO + ", m AS (SELECT list_id, min(score) AS lo, max(score) AS hi FROM l GROUP BY list_id), w AS (SELECT id, (CASE list_id WHEN 0 THEN 2.0 ELSE 0.5 END) * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS p FROM l JOIN m USING (list_id)) SELECT id, round(sum(p), 6) AS score FROM w GROUP BY id ORDER BY sum(p) DESC, id LIMIT 20")
def weighted_fusion(spark, d):
    return out(fusion.weighted(two_lists(spark, d), {0: 2.0, 1: 0.5}, 20))


@query("SELECT qid, id, round(sum(1.0 / (60 + list_rank)), 6) AS score FROM (SELECT qid, list_id, id, min(list_rank) AS list_rank FROM scored_ids WHERE qid IS NOT NULL GROUP BY ALL) GROUP BY qid, id")
def rrf_all_queries(spark, d):
    """Reciprocal rank fusion of all recorded lists of every query."""
    l = t(spark, d, "scored_ids").where("qid is not null").groupBy("qid", "list_id", "id").agg(F.min("list_rank").alias("rank"))  # noqa: E741
    return out(fusion.rrf(l, 1 << 30, group=("qid",)), "qid")


@query(f"""WITH {E}, c AS (SELECT id, v, {COS} AS rel FROM e, q WHERE id <> 0 ORDER BY rel DESC, id LIMIT 20), f AS (SELECT id, v AS qv FROM c ORDER BY rel DESC, id LIMIT 1),
s AS (SELECT c.id, 0.5 * c.rel - 0.5 * {COS} AS m, c.rel FROM c, f WHERE c.id <> f.id)
SELECT id, 1 AS place FROM f UNION ALL SELECT id, 2 FROM (SELECT id FROM s ORDER BY m DESC, rel DESC, id LIMIT 1)""")
def mmr_k2(spark, d):
    pool = batch(spark, d, "id = 0", 21).where("id <> 0")
    e = emb(spark, d)
    q = e.where("id = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return fusion.mmr(pool.join(e.select("id", "vector"), "id").join(q, "qid"), 2).select("id", "place")


@query()
def mmr_batch(spark, d):
    e = emb(spark, d)
    q = e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    pool = search.search_batch(e, q, 40, exclude_self=True)
    return fusion.mmr(pool.join(e.select("id", "vector"), "id").join(q, "qid"), 10)


REFS = "r AS (SELECT vec_id AS ref_id, 'label-' || label AS name, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 40)"


def _routes(spark, d):
    e = emb(spark, d).where("id < 40")
    return e.select(F.col("id").alias("ref_id"), F.concat(F.lit("label-"), "label").alias("name"), "vector", F.lit(0.75).alias("threshold"))


def _route_queries(spark, d):
    return emb(spark, d).where("id >= 40 and id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))


ROUTED = f"""WITH {REFS}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv, label FROM embeddings WHERE vec_id >= 40 AND vec_id % 10 = 0),
b AS (SELECT * FROM (SELECT qid, label, name, round(2 - 2 * {COS}, 9) AS dist, row_number() OVER (PARTITION BY qid ORDER BY {COS} DESC, ref_id) AS n FROM r, q) WHERE n = 1)
"""


@query(ROUTED + "SELECT qid, CASE WHEN dist <= 0.75 THEN name END AS route, round(dist, 6) AS distance, dist <= 0.75 AS matched FROM b")
def semantic_route(spark, d):
    return route.route(_routes(spark, d), _route_queries(spark, d)).withColumn("distance", r6("distance"))


@query(ROUTED + "SELECT threshold, round(avg(CASE WHEN (CASE WHEN dist <= threshold THEN name END) IS NOT DISTINCT FROM 'label-' || label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM b, (SELECT unnest([0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold")
def threshold_sweep(spark, d):
    best = search.search_batch(_routes(spark, d), _route_queries(spark, d), 1, id_col="ref_id").join(_routes(spark, d).select(F.col("ref_id").alias("id"), "name"), "id")
    scored = best.join(emb(spark, d).select(F.col("id").alias("qid"), F.concat(F.lit("label-"), "label").alias("expected")), "qid").select(F.round(2 - 2 * F.col("score"), 9).alias("distance"), "expected", F.col("name").alias("predicted"))
    return tune.threshold_sweep(scored, [0.3, 0.5, 0.7, 0.9]).withColumn("accuracy", r6("accuracy"))


@query(f"""WITH c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 2 = 0), q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 2 = 1),
b AS (SELECT * FROM (SELECT qid, id, {COS} AS score, row_number() OVER (PARTITION BY qid ORDER BY {COS} DESC, id) AS n FROM c, q) WHERE n = 1)
SELECT qid, id, round(score, 6) AS score, score >= 0.75 AS hit FROM b""")
def semantic_cache_hit(spark, d):
    e = emb(spark, d)
    q = e.where("id % 2 = 1").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return route.cache_lookup(e.where("id % 2 = 0"), q, threshold=0.75).withColumn("score", r6("score"))


SPLIT = ("vec_id < 40", "vec_id >= 40 AND vec_id % 10 = 0"), ("vec_id % 20 <> 0", "vec_id % 20 = 0")


def _all_routes(spark, d):
    """Routes of all rows but the queries, which are every id divisible by 20."""
    named = emb(spark, d).withColumn("name", F.concat(F.lit("label-"), "label"))
    refs = named.where("id % 20 <> 0").select(F.col("id").alias("ref_id"), "name", "vector", F.lit(0.75).alias("threshold"))
    return refs, named.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"), F.col("name").alias("expected"))


def _all_sql(name: str) -> str:
    (a, b), (x, y) = SPLIT
    assert a in SQL[name] and b in SQL[name]
    return SQL[name].replace(b, y).replace(a, x)


@query(_all_sql("semantic_route"))
def semantic_route_all(spark, d):
    refs, q = _all_routes(spark, d)
    return route.route(refs, q).withColumn("distance", r6("distance"))


@query(_all_sql("threshold_sweep"))
def threshold_sweep_all(spark, d):
    refs, q = _all_routes(spark, d)
    best = search.search_batch(refs, q, 1, id_col="ref_id").join(refs.select(F.col("ref_id").alias("id"), F.col("name").alias("predicted")), "id")
    scored = best.join(q.select("qid", "expected"), "qid").select(F.round(2 - 2 * F.col("score"), 9).alias("distance"), "expected", "predicted")
    return tune.threshold_sweep(scored, [0.3, 0.5, 0.7, 0.9]).withColumn("accuracy", r6("accuracy"))


_REFUSED = " OR ".join("lower(response_text) LIKE '%" + p.replace("'", "''") + "%'" for p in route.REFUSAL_PHRASES)


@query(f"""SELECT cassette_key, NOT coalesce({_REFUSED}, false) AS ok_refusal, coalesce(length(trim(response_text)) >= 20, false) AS ok_length, NOT coalesce(lower(response_text) LIKE '%http%', false) AS ok_contains,
NOT coalesce(regexp_matches(response_text, '[0-9]{{4}}'), false) AS ok_regex FROM cassette_chats""")
def admission_filters(spark, d):
    a = F.col("response_text")
    return t(spark, d, "cassette_chats").select("cassette_key", route.reject_refusals(a).alias("ok_refusal"), route.reject_short(a, 20).alias("ok_length"), route.reject_containing(a, "http").alias("ok_contains"), route.reject_matching(a, "[0-9]{4}").alias("ok_regex"))


@query("SELECT c.cassette_key, m.value IS NOT NULL AS hit FROM cassette_chats c LEFT JOIN (SELECT prompt, max(response_text) AS value FROM cassette_chats WHERE call_index = 1 AND prompt IS NOT NULL AND response_text IS NOT NULL GROUP BY prompt) m ON c.prompt = m.prompt")
def memo_hits(spark, d):
    c = t(spark, d, "cassette_chats")
    memo = c.where("call_index = 1 and prompt is not null and response_text is not null").groupBy("prompt").agg(F.max("response_text").alias("value"))
    return route.memo_split(c.select("cassette_key", "prompt"), memo, "prompt").select("cassette_key", "hit")


@query(knn_sql(COS, f"{COS} >= 0.55 AND (label = 1 OR label = 4) AND NOT (label = 9)"))
def store_search(spark, d):
    """A document store's search: least score, and a filter in the form frameworks send."""
    f = {"op": "AND", "left": {"op": "IN", "key": "label", "value": [1, 4]}, "right": {"op": "NE", "key": "label", "value": 9}}
    return out(serve.store_search(emb(spark, d), vec(spark, d), 10, threshold=0.55, where=f))


@query(f"WITH {E}, c AS (SELECT id, {COS} AS rel FROM e, q ORDER BY rel DESC, id LIMIT 40) SELECT 10 AS n, true AS among_candidates, true AS best_is_first")
def store_search_diverse(spark, d):
    """Facts of the re-ranked list: k rows, all among the best 4k, the best one first."""
    e, v = emb(spark, d), vec(spark, d)
    got = serve.store_search(e, v, 10, diversity=0.5).withColumn("place", F.monotonically_increasing_id())
    pool = search.search(e, v, 40).select("id", F.lit(True).alias("known"))
    j = got.join(pool, "id", "left")
    return j.agg(F.count("*").cast("int").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("among_candidates"), (F.max("score") == F.min_by("score", "place")).alias("best_is_first"))


@query(knn_sql(COS, "label = 2"))
def keyed_filter_search(spark, d):
    return out(serve.keyed_search(emb(spark, d), vec(spark, d), 10, {"__filter__": '{"field": "label", "eq": 2}', "label": 3}))


@query(knn_sql(COS))
def replica_search(spark, d):
    copies = serve.Replicas([emb(spark, d), emb(spark, d).where("true")])
    copies.next()
    return out(copies.search(search.search, vec(spark, d), 10))


@query(knn_sql(COS, "label <> 5"))
def result_cache(spark, d):
    """A search answered from the cache, the second time."""
    cache, e, q, f = serve.ResultCache(), emb(spark, d), vec(spark, d), filters.ne("label", 5)
    cache.search(e, q, 10, where=f)
    rows = cache.search(e, q, 10, where=f)
    assert cache.counts["hits"] == 1
    return out(spark.createDataFrame([(r.id, r.score) for r in rows], "id bigint, score double"))


@query("SELECT 'label-' || label AS name, count(*) AS refs FROM embeddings WHERE label IN (1, 2) GROUP BY label")
def router_names(spark, d):
    refs = emb(spark, d).select(F.col("id").alias("ref_id"), F.concat(F.lit("label-"), "label").alias("name"), "vector", F.lit(0.75).alias("threshold"))
    router = serve.Router(refs.where("name in ('label-1', 'label-3')")).with_route(refs.where("name = 'label-2'")).without("label-3")
    return router.refs.where(F.col("name").isin(router.names())).groupBy("name").agg(F.count("*").alias("refs"))


@query("WITH d AS (SELECT doc_id AS id, lang, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT id, lang, len([x for x in t if x IN ('graph', 'layer')]) AS n FROM d WHERE list_has_all(t, ['graph', 'layer'])), r AS (SELECT id, lang, row_number() OVER (ORDER BY n DESC, id) AS rank FROM h) SELECT id, rank, lang FROM r WHERE rank <= 20")
def text_hits_joined(spark, d):
    hits = text.and_search(docs(spark, d), ["graph", "layer"], 20).select("id", "rank")
    return serve.text_hits_with_rows(hits, t(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"))


@query("SELECT c_custkey, 'c' || c_custkey AS value, c_custkey % 2 = 0 AS hit FROM customer")
def memo_table(spark, d):
    """Values made once for each text: those of the second round that the first one made are hits."""
    memo = serve.MemoTable(table.Collection(spark, f"{runtime.stage_root(spark)}/memo-{uuid.uuid4().hex}", key="text"))
    texts = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("text"))
    make = lambda x: x.select("text", F.concat(F.lit("c"), "text").alias("value"))
    memo.compute(texts.where("text % 2 = 0"), make)
    return memo.compute(texts, make).select(F.col("text").cast("bigint").alias("c_custkey"), "value", "hit")


# -- ranking quality ------------------------------------------------------------------------------------

RUN = BATCH.format(which="id % 25 = 0", where="id <> qid") + """, run AS (SELECT qid, id AS doc, rank FROM r WHERE rank <= 10),
qr AS (SELECT a.vec_id AS qid, b.vec_id AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 25 = 0),
n AS (SELECT qid, count(*) AS n_pos FROM qr GROUP BY qid), ideal AS (SELECT qid, n_pos, list_sum([1 / log2(i + 1) for i in range(1, least(n_pos, 10) + 1)]) AS idcg FROM n),
h AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first FROM run JOIN qr USING (qid, doc) GROUP BY qid),
m AS (SELECT qid, coalesce(dcg / idcg, 0) AS ndcg, coalesce(hits, 0) / n_pos AS recall, coalesce(hits, 0) / 10.0 AS precision, coalesce(1.0 / first, 0) AS rr FROM ideal LEFT JOIN h USING (qid)),
f AS (SELECT *, CASE WHEN recall + precision = 0 THEN 0 ELSE 2 * recall * precision / (recall + precision) END AS f1 FROM m)
"""


def _run(spark, d, which):
    return batch(spark, d, which, 10, exclude_self=True).select("qid", F.col("id").alias("doc"), "rank")


@query(RUN + "SELECT qid, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1, round(rr, 6) AS rr FROM f")
def metrics_per_query(spark, d, which="id % 25 = 0"):
    return metrics.per_query_by_label(_run(spark, d, which), emb(spark, d), 10).select("qid", *[r6(c).alias(c) for c in ("ndcg", "recall", "precision", "f1", "rr")])


@query(RUN + "SELECT round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1, round(avg(rr), 6) AS mrr FROM f")
def metrics_summary(spark, d, which="id % 25 = 0"):
    return metrics.means(metrics.per_query_by_label(_run(spark, d, which), emb(spark, d), 10)).select(*[r6(c).alias(c) for c in ("ndcg", "recall", "precision", "f1", "mrr")])


def _over_the_set(f, old: str):
    """``<name>_set``: the query over every id divisible by 20, which grows with the data, beside the one over fewer ids."""
    name, new = f.__name__ + "_set", "id % 20 = 0"
    QUERIES[name] = functools.wraps(f)(lambda spark, d: f(spark, d, new))
    SQL[name] = SQL[f.__name__].replace(old, new)


for _f, _old in ((knn_batch, "id < 20"), (knn_label_recall, "id < 50"), (recall_vs_truth, "id % 50 = 0"), (ivf_probe_fixed, "id < 20"), (ivf_flat_fixed, "id < 20"), (graph_filtered, "id < 10"), (metrics_per_query, "id % 25 = 0"), (metrics_summary, "id % 25 = 0")):
    _over_the_set(_f, _old)


@query("SELECT a.vec_id AS qid, b.vec_id AS doc, 1 AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0")
def qrels_from_label(spark, d):
    return metrics.qrels_from_labels(emb(spark, d), emb(spark, d).where("id % 20 = 0").select(F.col("id").alias("qid")))


@query("SELECT count(lang) AS labelled, sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled, count(DISTINCT lang) AS distinct_labels, sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) <= 0.5 * count(*) AS usable FROM documents")
def label_coverage(spark, d):
    return metrics.label_coverage(t(spark, d, "documents"), "lang")


@query("""WITH c AS (SELECT event_type, value, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(c) OVER (PARTITION BY event_type) AS n FROM c)
SELECT event_type, min(CASE WHEN upto >= ceil(n * 0.5) THEN value END) AS p50, min(CASE WHEN upto >= ceil(n * 0.95) THEN value END) AS p95, min(CASE WHEN upto >= ceil(n * 0.99) THEN value END) AS p99,
min(CASE WHEN upto >= ceil(n * 0.999) THEN value END) AS p999, round(sum(value * c) / sum(c), 4) AS mean, sum(c)::BIGINT AS n FROM u GROUP BY event_type""")
def latency_percentiles(spark, d):
    return metrics.latency(t(spark, d, "events"), "value", ("event_type",)).withColumn("mean", F.round("mean", 4))


# -- text ------------------------------------------------------------------------------------------------

DOCS = "d AS (SELECT doc_id AS id, [x for x in string_split_regex(lower(text), '[^a-z0-9]+') if x <> ''] AS t FROM documents WHERE text IS NOT NULL)"


def docs(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {DOCS}, h AS (SELECT id, len([x for x in t if x IN ('graph', 'layer')]) AS n FROM d WHERE list_has_all(t, ['graph', 'layer'])), r AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM h) SELECT id, rank, round(1.0 / rank, 6) AS score FROM r WHERE rank <= 20")
def text_and_search(spark, d):
    return text.and_search(docs(spark, d), ["graph", "layer"], 20).withColumn("score", r6("score"))


BM = f"""WITH {DOCS}, c AS (SELECT id, len(t) AS l, len([x for x in t if x = 'recall']) AS f0, len([x for x in t if x = 'snapshot']) AS f1 FROM d),
s AS (SELECT count(*) AS n, avg(l) AS av, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END) AS d0, sum(CASE WHEN f1 > 0 THEN 1 ELSE 0 END) AS d1 FROM c),
b AS (SELECT id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / av)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / av)) AS score FROM c, s WHERE f0 > 0 OR f1 > 0)
"""


@query(BM + "SELECT id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 20")
def bm25_search(spark, d):
    return out(text.bm25(docs(spark, d), ["recall", "snapshot"], 20))


@query(BM + f""", v AS (SELECT vec_id AS id, {COS} AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, id LIMIT 10),
l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM b ORDER BY score DESC, id LIMIT 30) UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM v)
SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY id ORDER BY sum(1.0 / (60 + rank)) DESC, id LIMIT 10""")
def hybrid_text(spark, d):
    """Vector leg k, text leg 3k, fused by reciprocal rank."""
    return out(fusion.hybrid([search.search(emb(spark, d), vec(spark, d), 10), text.bm25(docs(spark, d), ["recall", "snapshot"], 30)], 10))


@query("""SELECT id, CASE WHEN lower(mime) LIKE 'image/%' THEN 'image' WHEN lower(mime) LIKE 'audio/%' THEN 'audio' WHEN lower(mime) = 'application/json' OR lower(mime) LIKE '%+json' THEN 'json' WHEN lower(mime) LIKE 'text/%' THEN 'text'
WHEN lower(mime) LIKE 'application/octet-stream%' THEN 'binary' WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_full_match(text, '(?s)\\s*(\\{.*\\}|\\[.*\\])\\s*') THEN 'json' ELSE 'text' END AS kind,
substr(regexp_replace(text, '[\\t\\r\\n]', ' ', 'g'), 1, 120) AS preview FROM ingest_docs""")
def export_rows(spark, d):
    return t(spark, d, "ingest_docs").select("id", text.content_kind(F.col("mime"), F.col("text")).alias("kind"), text.export_text(F.col("text")).alias("preview"))


# -- tables -----------------------------------------------------------------------------------------------

_CUST = "SELECT c_custkey, c_name, c_acctbal FROM customer"


def cust(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")


@query(f"{_CUST} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 2 = 1")
def upsert_merge(spark, d):
    c = cust(spark, d)
    return table.upsert(c, c.where("c_custkey % 2 = 1").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")), "c_custkey")


@query(f"{_CUST} WHERE NOT coalesce(c_acctbal < 0, false)")
def delete_where(spark, d):
    return table.delete_where(cust(spark, d), filters.lt("c_acctbal", 0))


@query(f"{_CUST} WHERE c_custkey % 3 <> 0")
def compact_live(spark, d):
    c = cust(spark, d)
    return table.delete_ids(c, c.where("c_custkey % 3 = 0"), "c_custkey")


@query("SELECT (SELECT count(*) FROM customer) AS physical, (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) AS live")
def collection_counts(spark, d):
    c = cust(spark, d)
    dead = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(True).alias("dead"))
    return c.join(dead, "c_custkey", "left").agg(F.count("*").alias("physical"), F.count(F.when(F.col("dead").isNull(), 1)).alias("live"))


@query("SELECT id, max_by(text, (received_at, batch_no)) IS NOT NULL AS has_text, count(*) AS versions FROM ingest_docs GROUP BY id")
def apply_change_events(spark, d):
    """Fold the versions of every record, as upserts in order of arrival, into its live row."""
    e = t(spark, d, "ingest_docs").select(F.lit("Upsert").alias("op"), F.struct("received_at", "batch_no").alias("seq"), "id", "text")
    live = table.apply_events(e.select("id", "text").limit(0), e)
    return live.select("id", F.col("text").isNotNull().alias("has_text")).join(e.groupBy("id").agg(F.count("*").alias("versions")), "id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_scan(spark, d):
    return table.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, 50)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def point_lookup(spark, d):
    return cust(spark, d).where("c_custkey = 7").select("c_custkey", "c_name")


@query("SELECT a.pos, a.c_custkey, c.c_name, c.c_custkey IS NULL AS missing FROM (SELECT range AS pos, range * 400 + 1 AS c_custkey FROM range(10)) a LEFT JOIN customer c USING (c_custkey)")
def batch_lookup_missing(spark, d):
    ids = spark.range(10).select(F.col("id").alias("pos"), (F.col("id") * 400 + 1).alias("c_custkey"))
    return table.look_up(cust(spark, d).select("c_custkey", "c_name"), ids, "c_custkey").select("pos", "c_custkey", "c_name", "missing")


@query("SELECT h.qid, h.id, max(d.mime) AS mime FROM (SELECT DISTINCT qid, id FROM search_hits) h LEFT JOIN ingest_docs d USING (id) GROUP BY h.qid, h.id")
def hit_hydration(spark, d):
    h = t(spark, d, "search_hits").select("qid", "id").distinct()
    side = t(spark, d, "ingest_docs").groupBy("id").agg(F.max("mime").alias("mime"))
    return table.with_side_table(h, side, "id").select("qid", "id", "mime")


def _sample_facts(sample: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    known = sample.join(whole.select(key, F.lit(True).alias("known")).distinct(), key, "left")
    return known.agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_different"), F.min(F.coalesce("known", F.lit(False))).alias("all_known"))


SAMPLE_FACTS = "SELECT least(100, count(*)) AS n, least(100, count(*)) AS n_different, true AS all_known FROM customer"


@query(SAMPLE_FACTS)
def stable_sample(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    return _sample_facts(table.stable_sample(c, "c_custkey", 100), c, "c_custkey")


@query(SAMPLE_FACTS)
def reservoir_sample(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    return _sample_facts(table.reservoir(c, 100), c, "c_custkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AND NOT c_acctbal < 0 UNION ALL SELECT c_custkey, upper(c_name), c_acctbal + 1 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 1 AND NOT c_acctbal + 1 < 0")
def collection_lifecycle(spark, d):
    """A collection after an add, an upsert, deletions by id and by filter, a compaction and a recovery."""
    c = table.Collection(spark, f"{runtime.stage_root(spark)}/life-{uuid.uuid4().hex}", key="c_custkey", max_deltas=2)
    rows = cust(spark, d)
    c.add(rows)
    c.upsert(rows.where("c_custkey % 2 = 1").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")))
    c.delete(rows.where("c_custkey % 3 = 0").select("c_custkey"))
    c.delete_where(filters.lt("c_acctbal", 0))
    c.compact()
    c.recover()
    return c.read()


@query("SELECT count(*) AS n, true AS spread FROM customer WHERE c_custkey % 5 <> 0")
def sharded_collection(spark, d):
    """Rows routed to three shards by the hash ring, some deleted again."""
    s = table.ShardedCollection(spark, f"{runtime.stage_root(spark)}/shards-{uuid.uuid4().hex}", 3, key="c_custkey")
    s.upsert(cust(spark, d))
    s.delete(cust(spark, d).where("c_custkey % 5 = 0").select("c_custkey"))
    return s.read().agg(F.count("*").alias("n"), (F.countDistinct("shard") == 3).alias("spread"))


@query(f"WITH {E}, u AS (SELECT * FROM e WHERE id % 50 <> 7 UNION ALL SELECT id, [-x for x in v], label FROM e WHERE id % 50 = 7), s AS (SELECT id, -{D2} AS score FROM u, q) SELECT 0::BIGINT AS qid, id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def ivf_with_log(spark, d):
    """The stored index and the rows of a log that it does not hold yet."""
    log, e = table.WriteAheadLog(spark, f"{runtime.stage_root(spark)}/log-{uuid.uuid4().hex}"), emb(spark, d)
    log.append(e.where("id % 50 = 7").select("id", F.transform("vector", lambda x: -x).alias("vector")))
    return ivf.search_with_log(stored_ivf(spark, d), log, query_set(spark, d, "id = 0"), 10, nprobe=16).select("qid", "id", r6("score").alias("score"))


@query("SELECT count(DISTINCT id) AS n FROM ingest_docs WHERE id IS NOT NULL")
def stream_ingest(spark, d):
    """The ids that a stream over all records leaves in the side table."""
    raw, root = t(spark, d, "ingest_docs"), f"{runtime.stage_root(spark)}/stream-{uuid.uuid4().hex}"
    fs, path = runtime._hadoop_path(spark, f"{d}/ingest_docs.parquet")
    files = spark.readStream.schema(raw.schema)
    # a stream watches a folder; a table of one file is that file of its folder
    files = files.parquet(str(path)) if fs.getFileStatus(path).isDirectory() else files.option("pathGlobFilter", "ingest_docs.parquet").parquet(d)
    stream = files.select("id", "text", F.lit(None).cast("binary").alias("blob"), "mime", "attrs", F.col("precomputed_vector").alias("precomputedVector"))
    side = table.Collection(spark, f"{root}/side")
    ingest.ingest(stream, table.Collection(spark, f"{root}/rows"), f"{root}/checkpoint", side=side).awaitTermination()
    return side.read().agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT id, [CAST(floor(x * 127 / list_max([abs(y) for y in v]) + 0.5) AS INTEGER) for x in v] AS c FROM e), q AS (SELECT c AS qc FROM m WHERE id = 0)
SELECT id, round(0.5 + list_dot_product(c::DOUBLE[], qc::DOUBLE[]) / (2.0 * 64 * 127 * 127), 6) AS score FROM m, q""")
def byte_dot_scores(spark, d):
    codes = emb(spark, d).select("id", V.int8_max_abs(F.col("vector")).alias("c"))
    q = codes.where("id = 0").first().c
    return codes.select("id", r6(V.byte_dot_score(F.col("c"), F.array(*[F.lit(x) for x in q]))).alias("score"))


@query("SELECT id, mime, NULL::VARCHAR AS text FROM ingest_docs")
def projected_rows(spark, d):
    """Rows without their texts, which the scan then does not read."""
    return table.project(t(spark, d, "ingest_docs").select("id", "mime", "text"), text=False)


@query(f"{_CUST} WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def unique_insert(spark, d):
    even = cust(spark, d).where("c_custkey % 2 = 0")
    return table.insert_unique(even, even.withColumn("c_custkey", F.col("c_custkey") + 10000000).select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


@query("SELECT count(*) * 64 * 4 AS n_bytes FROM embeddings")
def exported_matrix_bytes(spark, d):
    return formats.matrix_bytes(emb(spark, d)).agg(F.sum(F.octet_length("bytes")).alias("n_bytes"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def arrow_round_trip(spark, d):
    """All rows written as Arrow streams and read back."""
    path = f"{runtime.stage_root(spark)}/arrow-{uuid.uuid4().hex}"
    e = emb(spark, d).select("id", "vector", F.lit(None).cast("string").alias("text"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    formats.export_arrow(e, path, 64)
    return formats.read_arrow(spark, path).select("id", F.round(V.total(F.col("vector")), 4).alias("total"))


@query("SELECT round(quantile_cont(x, 0.005), 5) AS low, round(quantile_cont(x, 0.995), 5) AS high FROM (SELECT unnest(embedding::DOUBLE[]) AS x FROM embeddings)")
def quantile_bounds(spark, d):
    """The bounds between which the byte codes spread their levels."""
    c = quant.train("sq8", emb(spark, d))
    return spark.createDataFrame([(round(c.low, 5), round(c.high, 5))], "low double, high double")


@query("SELECT * FROM (VALUES ('dense', true), ('givens', true), ('quaternion', true)) t(rotation, orthogonal)")
def rotations(spark, d):
    """The rotations that precede sign codes keep lengths and angles."""
    import numpy as np

    makes = {"dense": quant.dense_rotation, "givens": quant.givens_rotation, "quaternion": quant.quaternion_rotation}
    return spark.createDataFrame([(n, bool(np.abs(m(64) @ m(64).T - np.eye(64)).max() < 1e-9)) for n, m in makes.items()], "rotation string, orthogonal boolean")


@query("SELECT count(*) AS n, true AS second_run_adds_nothing, true AS replica_waits, true AS replica_follows FROM (SELECT DISTINCT c_custkey FROM customer)")
def stream_resume(spark, d):
    """A change stream applied twice from one checkpoint, and a replica that moves on when told."""
    root, raw = f"{runtime.stage_root(spark)}/resume-{uuid.uuid4().hex}", cust(spark, d)
    events = raw.select(F.lit("Upsert").alias("op"), F.col("c_custkey").alias("seq"), "c_custkey", "c_name", "c_acctbal")
    events.write.parquet(f"{root}/events")
    c = table.Collection(spark, f"{root}/rows", key="c_custkey")

    def go():
        ingest.follow_events(spark.readStream.schema(events.schema).parquet(f"{root}/events"), c, f"{root}/checkpoint").awaitTermination()
        return c.generation

    first = go()
    again, replica = go(), ingest.Replica(c)
    c.upsert(raw.limit(1).withColumn("c_acctbal", F.lit(-1.0).cast(raw.schema["c_acctbal"].dataType)))
    waits = replica.generation == again
    follows = replica.refresh() and replica.generation == c.generation
    return replica.read().agg(F.count("*").alias("n"), F.lit(first == again).alias("second_run_adds_nothing"), F.lit(waits).alias("replica_waits"), F.lit(follows).alias("replica_follows"))


@query(f"{_CUST} WHERE c_custkey % 2 = 1")
def shipped_generation(spark, d):
    """A generation shipped to another collection."""
    root = f"{runtime.stage_root(spark)}/ship-{uuid.uuid4().hex}"
    a, b = (table.Collection(spark, f"{root}/{x}", key="c_custkey") for x in "ab")
    a.add(cust(spark, d))
    a.delete(cust(spark, d).where("c_custkey % 2 = 0").select("c_custkey"))
    a.export_generation(f"{root}/shipped")
    b.import_generation(f"{root}/shipped")
    return b.read()


# -- tuning, projections, batches -----------------------------------------------------------------------------

AXES = [tune.Choice("m", (8, 16, 32)), tune.Choice("ef", (64, 128)), tune.Choice("quantizer", ("none", "sq8"))]


@query("SELECT i AS trial, [8, 16, 32][(i % 3) + 1] AS m, [64, 128][((i // 3) % 2) + 1] AS ef, ['none', 'sq8'][((i // 6) % 2) + 1] AS quantizer FROM (SELECT range AS i FROM range(12))")
def grid_trials(spark, d):
    return tune.grid_frame(spark, AXES)


@query("""SELECT i AS trial, round(0.7 * (1 - 1.0 / (m + ef)) + 0.3 * 0.9 - 0.2 * least(greatest(m * ef / 2048.0, 0), 1), 6) AS objective FROM
(SELECT i, [8, 16, 32][(i % 3) + 1] AS m, [64, 128][((i // 3) % 2) + 1] AS ef FROM (SELECT range AS i FROM range(12)))""")
def objective_score(spark, d):
    g = tune.grid_frame(spark, AXES)
    recall = 1 - F.lit(1.0) / (F.col("m") + F.col("ef"))
    return g.select("trial", r6(tune.objective({"recall": (recall, 0.7), "ndcg": (F.lit(0.9), 0.3)}, {"cost": (F.col("m") * F.col("ef") * 1.0, 0.2, 2048.0)})).alias("objective"))


# worked out by hand for 64 dimensions, 16 lists and the metric cosine
@query("""SELECT * FROM (VALUES (1000, 256000::BIGINT, 396856::BIGINT, 516028::BIGINT, 264441::BIGINT, 338062::BIGINT, 324024::BIGINT, 284768::BIGINT), (100000, 25600000, 39680056, 51600028, 26004441, 26870062, 32400024, 28400768),
(5000000, 1280000000, 1984000080, 2580000028, 1300004441, 1340070062, 1620000024, 1420000768)) t(n, flat, hnsw, vamana, ivf, ivf_pq, flat_sq8, flat_rabitq)""")
def index_memory(spark, d):
    df = spark.createDataFrame([(1000,), (100000,), (5000000,)], "n bigint")
    dim, n = F.lit(64).cast("bigint"), F.col("n")
    kinds = {"flat": ("flat", "none"), "hnsw": ("hnsw", "none"), "vamana": ("vamana", "none"), "ivf": ("ivf", "sq8"), "ivf_pq": ("ivf_pq", "none"), "flat_sq8": ("flat", "sq8"), "flat_rabitq": ("flat", "rabitq")}
    return df.select(F.col("n").cast("int").alias("n"), *[tune.index_bytes(kind, n, dim, quantizer=q).alias(name) for name, (kind, q) in kinds.items()])


@query("SELECT true AS within, true AS reproducible, true AS better_than_random")
def sampled_trials(spark, d):
    """Random trials stay in their ranges and repeat with their seed; the sequential sampler's best beats the random ones' mean."""
    axes = [tune.IntRange("m", 4, 64, log=True), tune.FloatRange("x", 0.0, 1.0), tune.Choice("k", ("a", "b"))]
    value = lambda p: -abs(p["m"] - 16) / 60 - (p["x"] - 0.3) ** 2 + (p["k"] == "a")
    trials = tune.random_trials(axes, 200)
    within = all(4 <= p["m"] <= 64 and 0 <= p["x"] <= 1 and p["k"] in "ab" for p in trials)
    best = max(v for _, v in tune.run_study(tune.TreeParzen(axes).next, value, 40))
    return spark.createDataFrame([(within, trials == tune.random_trials(axes, 200), best > sum(map(value, trials)) / len(trials))], "within boolean, reproducible boolean, better_than_random boolean")


@query("SELECT vec_id AS id, round(list_sum([x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) for x in embedding::DOUBLE[]]), 6) AS unit_sum FROM embeddings")
def sphereize(spark, d):
    return emb(spark, d).select("id", r6(V.total(tune.sphereize(F.col("vector")))).alias("unit_sum"))


@query("SELECT count(*) AS n, true AS ordered, true AS uncorrelated FROM embeddings")
def pca_2d(spark, d):
    """Facts of the projection on two principal components: the first varies more, and they are not correlated."""
    x = tune.pca_projection(emb(spark, d)).select("id", F.col("projected")[0].alias("a"), F.col("projected")[1].alias("b"))
    return x.agg(F.count("*").alias("n"), (F.var_pop("a") >= F.var_pop("b")).alias("ordered"), (F.abs(F.corr("a", "b")) < 1e-6).alias("uncorrelated"))


@query("SELECT n, dim, CASE WHEN dim > 4 * n THEN 'pca' WHEN n < 5000 THEN 'tsne' WHEN n <= 100000 THEN 'umap' ELSE 'pca' END AS projection FROM (SELECT unnest([10, 1000, 10000, 6000000]) AS n, unnest([64, 64, 3, 128]) AS dim)")
def projection_recommender(spark, d):
    return spark.createDataFrame([(10, 64), (1000, 64), (10000, 3), (6000000, 128)], "n int, dim int").select("n", "dim", tune.recommend_projection(F.col("n"), F.col("dim"), F.lit(0.0)).alias("projection"))


@query("SELECT source, (n - 1) // 16 AS batch, count(*) AS docs FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL) GROUP BY ALL")
def batch_boundaries(spark, d):
    x = t(spark, d, "documents").where("source is not null").select("source", "doc_id", "text")
    b = ingest.batch_numbers(x, "doc_id", by="source", max_docs=16, size=F.coalesce(F.octet_length("text"), F.lit(0)))
    return b.groupBy("source", "batch").agg(F.count("*").alias("docs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
