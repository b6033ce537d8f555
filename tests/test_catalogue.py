import math

import pytest

import compare
from quiverlake.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, con, name):
    assert compare.differences(spark, con, name, catalogue.queries()[name], SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert catalogue.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "score"] and df.count() <= 10


def test_ivf_recall(spark, small):
    assert catalogue.ivf_recall(spark, small).first()[0] >= 0.5


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_ivf_recall_reaches_the_target(spark, small, size):
    assert catalogue.ivf_recall(spark, small.replace("sf0.001", size)).first()[0] >= 0.9


def quantized_recall(spark, d, kind):
    codec, codes, over = catalogue.quantized(spark, d, kind)
    e = catalogue.emb(spark, d)
    q = e.where("id % 20 = 0").selectExpr("id as qid", "vector as qvec")
    places = catalogue.quant.coarse_places(codes, codec, q, catalogue.search.search_batch(e, q, 10))
    return over, float((places <= max(10, math.ceil(10 * over))).mean()), float((places <= 40).mean())


@pytest.mark.parametrize("kind", ["sign", "pq"])
def test_quantized_recall_reaches_the_target(spark, small, kind):
    assert quantized_recall(spark, small.replace("sf0.001", "sf0.01"), kind)[1] >= 0.9


@pytest.mark.parametrize("name", ["knn_batch", "knn_label_recall", "recall_vs_truth", "ivf_probe_fixed", "ivf_flat_fixed", "graph_filtered", "metrics_per_query"])
def test_sets_hold_every_id_divisible_by_20(spark, small, name):
    want = {r[0] for r in catalogue.emb(spark, small).where("id % 20 = 0").select("id").collect()}
    assert {r.qid for r in catalogue.queries()[f"{name}_set"](spark, small).collect()} == want


def test_metadata_filter_is_pushed_into_the_scan(spark, small):
    import io
    from contextlib import redirect_stdout

    from quiverlake.operators import filters, search

    e = spark.read.parquet(f"{small}/embeddings.parquet")
    out = io.StringIO()
    with redirect_stdout(out):
        search.search(e, [0.1] * 64, 5, id_col="vec_id", vec_col="embedding", where=filters.eq("label", 3)).explain("formatted")
    assert "TakeOrderedAndProject" in out.getvalue() and "EqualTo(label,3)" in out.getvalue()
