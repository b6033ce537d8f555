import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverlake.functions import vecmath as V
from quiverlake.operators import serve, cluster, components, filters, fusion, graph, metrics, quant, route, search, table, tune

META = "id string, vector array<float>, color string, size double, active boolean, tags array<string>"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("d1", [1.0, 0, 0, 0], "red", 10.0, True, ["a", "b"]), ("d2", [0, 1.0, 0, 0], "blue", 20.0, False, ["b", "c"]),
        ("d3", [0, 0, 1.0, 0], "red", 30.0, True, ["c", "d"]), ("d4", [0, 0, 0, 1.0], "green", 40.0, False, None),
    ]
    return spark.createDataFrame([(a, [float(x) for x in v], *r) for a, v, *r in rows], META)


@pytest.mark.parametrize(("f", "want"), [
    (filters.eq("color", "red"), ["d1", "d3"]), (filters.eq("active", True), ["d1", "d3"]), (filters.between("size", 15, 35), ["d2", "d3"]),
    (filters.eq("tags", "b"), ["d1", "d2"]), (filters.isin("tags", ["a", "d"]), ["d1", "d3"]), (filters.not_(filters.eq("tags", "b")), ["d3", "d4"]),
    (filters.eq("size", "10"), []), (filters.gt("color", 1), []), (filters.ne("nothing", 1), ["d1", "d2", "d3", "d4"]), (None, ["d1", "d2", "d3", "d4"]),
])
def test_filters(docs, f, want):
    found = search.search(docs, [1, 0, 0, 0], 10, where=f)
    rows = {r.id: r.score for r in found.collect()}
    assert sorted(rows) == want
    assert all(abs(s - (1.0 if i == "d1" else 0.5)) < 1e-9 for i, s in rows.items())


def test_filters_over_typed_metadata(spark):
    df = spark.createDataFrame([(1, '{"a": "5", "b": 5, "c": true, "t": ["x", "y"], "n": null}'), (2, "{}"), (3, None)], "id int, j string")
    df = df.withColumn("metadata", filters.typed_metadata(F.col("j")))
    ids = lambda f: [r.id for r in filters.apply(df, f, "metadata").orderBy("id").collect()]
    assert ids(filters.eq("a", "5")) == [1] and ids(filters.eq("a", 5)) == [] and ids(filters.eq("b", 5)) == [1]
    assert ids(filters.eq("t", "y")) == [1] and ids(filters.eq("c", True)) == [1] and ids(filters.ne("b", 5)) == [2, 3]


@pytest.mark.parametrize("bad", ['{"and": []}', '{"field": "a"}', '{"field": "a", "eq": 1, "gt": 2}', '{"field": "a", "in": []}', '{"field": "a", "in": [1, "x"]}', '{"field": "a", "like": "x"}', '{"field": "' + "x" * 257 + '", "eq": 1}', '{"field": "a", "gt": "1"}', "[]"])
def test_json_filter_errors(bad):
    with pytest.raises(ValueError):
        filters.parse_json(bad)


def test_top_k_and_ties(spark):
    df = spark.createDataFrame(list(enumerate([0.9, 0.5, 0.9, 0.3, 0.5])), "i int, s double")
    assert [r.i for r in search.top_k(df, "s", "i", 4).collect()] == [0, 2, 1, 4]
    assert search.top_k(df, "s", "i", 0).count() == 0


def test_batch_search_equals_single(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "id int, vector array<float>")
    q = df.where("id < 3").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    for metric in V.METRICS:
        got = search.search_batch(df, q, 7, metric=metric, queries_per_pass=2).orderBy("qid", "rank").collect()
        for i in range(3):
            one = search.search(df, rows[i][1], 7, metric=metric).collect()
            assert [r.id for r in got if r.qid == i] == [r.id for r in one]
    assert search.search_batch(df, q.limit(0), 3).count() == 0
    assert search.search_batch(df.limit(0), q, 3).count() == 0


def lists(spark, *parts):
    return spark.createDataFrame([(n, i, float(s)) for n, p in enumerate(parts) for i, s in p], "list_id int, id string, score double")


def test_fusion(spark):
    two = fusion.with_ranks(lists(spark, [("a", 2), ("b", 1)], [("a", 2), ("c", 1)]))
    r = fusion.rrf(two, 3).collect()
    assert [x.id for x in r] == ["a", "b", "c"] and abs(r[0].score - 2 / 61) < 1e-12 and abs(r[1].score - 1 / 62) < 1e-12
    w = fusion.weighted(lists(spark, [("a", 0.8), ("b", 0.2)], [("c", 1.0), ("a", 0.5)]), {0: 1.0, 1: 1.0}, 3).collect()
    assert [(x.id, x.score) for x in w] == [("a", 1.0), ("c", 1.0), ("b", 0.0)]
    w = fusion.weighted(lists(spark, [("a", 1)], [("b", 1)]), {0: 2.0, 1: 0.5}, 3).collect()
    assert [(x.id, x.score) for x in w] == [("a", 2.0), ("b", 0.5)]
    with pytest.raises(ValueError):
        fusion.weighted(two, {0: 0}, 1)
    assert fusion.hybrid([two.where("list_id = 0")], 1).count() == 2


def test_mmr():
    q, x = np.array([1.0, 0]), np.array([[1, 0.05], [1, 0.15], [0.6, 0.8]])
    assert fusion.mmr_order(q, x, 3, 1.0) == [0, 1, 2]
    order = fusion.mmr_order(q, x, 3, 0.3)
    assert order[0] == 0 and order.index(2) < order.index(1)
    assert fusion.mmr_order(q, x, 1, 0.5) == [0] and len(fusion.mmr_order(q, x, 99, 0.5)) == 3


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, s) for d, s in (("d1", 4.0), ("d2", 3.0), ("x", 2.0), ("d3", 1.0))], "qid string, doc string, score double")
    qrels = spark.createDataFrame([("q", "d1", 3), ("q", "d2", 2), ("q", "d3", 1), ("none", "d1", 0)], "qid string, doc string, grade int")
    at = lambda k: metrics.summary(run, qrels, k).first()
    assert abs(at(4).ndcg - 0.99262) < 1e-4 and at(2).precision == 1.0 and abs(at(3).precision - 2 / 3) < 1e-9 and abs(at(2).f1 - 0.8) < 1e-9 and at(2).mrr == 1.0


def test_router(spark):
    routes = spark.createDataFrame([(1, "sports", [1.0, 0.0, 0.0], 0.2), (2, "food", [0.0, 1.0, 0.0], 0.2)], "ref_id int, name string, vector array<float>, threshold double")
    q = spark.createDataFrame([(1, [0.95, 0.1, 0.05]), (2, [0.1, 0.9, 0.1]), (3, [0.1, 0.1, 0.9])], "qid int, qvec array<float>")
    got = {r.qid: r.route for r in route.route(routes, q).collect()}
    assert got == {1: "sports", 2: "food", 3: None}


@pytest.mark.parametrize("kind", sorted(quant.KINDS))
def test_quantizers(kind):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 32))
    x = (centers[rng.integers(0, 20, 1500)] + 0.4 * rng.normal(size=(1500, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codec = quant.KINDS[kind](x)
    codes = np.ascontiguousarray(codec.encode(x))
    hits = 0
    for q in x[:20]:
        true = set(np.argsort(-(x @ q))[:10])
        coarse = np.argsort(-np.asarray(codec.scores(q.astype(float), codes)), kind="stable")[:40]
        hits += len(true & set(coarse))
    assert hits / 200 >= (0.7 if kind in ("sign", "bq", "rabitq", "pq", "opq") else 0.9)
    if kind not in ("sign", "bq"):
        err = np.linalg.norm(codec.decode(codes, 32) - x, axis=1).mean()
        assert err < {"fp16": 0.001, "sq8": 0.05, "turboquant": 0.05, "nvq": 0.05, "sq4": 0.3, "extended_rabitq": 0.3}.get(kind, 0.9)


@pytest.mark.parametrize("make", [quant.dense_rotation, quant.givens_rotation, quant.quaternion_rotation])
def test_rotations_are_orthogonal(make):
    m = make(10, 5)
    assert np.allclose(m @ m.T, np.eye(10))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_union_find(spark, edges):
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame([*edges, (None, 1)], "a int, b int")
    assert {(r.node, r.root) for r in components.connected_components(df).collect()} == {(n, root(n)) for n in linked}


def test_kmeans_error_falls(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, (rng.normal(size=4) + 5 * (i % 3)).tolist()) for i in range(300)], "id int, vector array<float>")
    errors = [cluster.quantization_error(cluster.assign(df, cluster.train_kmeans(df, k))).first()[0] for k in (1, 3)]
    assert errors[1] < errors[0] / 4
    assert cluster.intrinsic_dimension(df, "vector") == 1


def test_table_operators(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, table.upsert(base, new, "id").collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        table.insert_unique(base, new, "id")
    events = spark.createDataFrame([("Upsert", 1, 1, "x"), ("Delete", 2, 1, None), ("Add", 3, 9, "n"), ("Commit", 4, None, None)], "op string, seq int, id int, v string")
    assert sorted(map(tuple, table.apply_events(base, events).collect())) == [(2, "b"), (9, "n")]


def test_collection(spark, tmp_path):
    c = table.Collection(spark, f"file://{tmp_path}/c")
    base = spark.createDataFrame([("1", 1.0), ("2", 2.0)], "id string, v double")
    assert c.add(base) == 1
    assert c.upsert(spark.createDataFrame([("2", 5.0), ("3", 3.0)], base.schema), batch=7) == 2
    assert c.upsert(base, batch=7) == 2  # replayed batch
    c.delete(spark.createDataFrame([("1",)], "id string"))
    assert c.delete_where(filters.gt("v", 4)) == 4
    assert [tuple(r) for r in c.read().collect()] == [("3", 3.0)]
    assert len(c.generations()) == 2
    c.compact()
    c._write_pointer({"gen": 4})  # a crash left an old pointer
    assert c.recover() == 5 and c.read().count() == 1
    assert c.upsert(base.limit(0)) == 5  # nothing to commit
    assert c.upsert(base, batch=3) == 5  # a replay from long ago
    gen = c.upsert(spark.createDataFrame([("9", 9.0)], base.schema))
    (tmp_path / "c" / f"gen-{gen}.json").write_text("12 {}")  # damaged
    assert c.recover() == 5 and [r.id for r in c.read().collect()] == ["3"]


def test_collection_folds_deltas_and_fences_writers(spark, tmp_path):
    c = table.Collection(spark, f"file://{tmp_path}/c", max_deltas=3, auto_commit=3)
    rows = lambda *p: spark.createDataFrame(list(p), "id string, v double")
    c.upsert(rows(("a", 0.0), ("b", 0.0)))
    for i in range(1, 6):
        c.apply(rows(("a", float(i)), (f"n{i}", 1.0)), rows(("b", 0.0)) if i == 2 else None)
    assert {r.id: r.v for r in c.read().collect()} == {"a": 5.0, **{f"n{i}": 1.0 for i in range(1, 6)}}
    assert len(c._manifest(c.generation)["deltas"]) <= 3
    c.stage(rows(("a", 7.0)))
    assert c.view().where("id = 'a'").first().v == 7.0 and c.read().where("id = 'a'").first().v == 5.0
    before = c.generation
    assert c.stage(rows(("x", 1.0), ("y", 1.0))) == before + 1 and c.read().where("id = 'a'").first().v == 7.0
    with pytest.raises(ValueError):
        c.add(rows(("x", 2.0)))
    other = table.Collection(spark, f"file://{tmp_path}/c")
    c.store.create(f"gen-{c.generation + 1}.json", "1 {}")  # another writer is ahead
    with pytest.raises(table.Conflict):
        other._publish(other.generation + 1, "data-x", [], None, None) if other.store.exists("data-x") else other.store.create(f"gen-{other.generation + 1}.json", "x")


def test_shards_and_log(spark, tmp_path):
    from quiverlake.operators import ivf

    s = table.ShardedCollection(spark, f"file://{tmp_path}/s", 3)
    rows = spark.range(60).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("v"))
    s.upsert(rows)
    s.delete_where(filters.gt("v", 49))
    s.delete(rows.where("id = '7'"))
    got = s.read()
    assert got.count() == 49 and got.select("shard").distinct().count() == 3
    moved = rows.where(table.ring_shard(F.col("id"), 3) != table.ring_shard(F.col("id"), 4)).count()
    assert 0 < moved < 35
    log = table.WriteAheadLog(spark, f"file://{tmp_path}/w")
    x = np.random.default_rng(0).normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    index = ivf.build(df, f"file://{tmp_path}/ix", 4)
    log.append(df.where("id < 3").select("id", F.transform("vector", lambda v: -v).alias("vector")))
    log.append(spark.createDataFrame([(500, x[5].tolist())], df.schema))
    q = df.where("id = 5").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    y = x.astype(float).copy()
    y[:3] *= -1
    y = np.vstack([y, x[5]])
    want = sorted(range(201), key=lambda i: (round(((y[i] - x[5]) ** 2).sum(), 9), i if i < 200 else 500))[:6]
    for metric in ("l2",):
        hits = ivf.search_with_log(index, log, q, 6, nprobe=4, metric=metric).orderBy("rank").collect()
        assert [h.id for h in hits] == [i if i < 200 else 500 for i in want]
    log.mark_indexed(1)
    assert log.replay().count() == 1 and log.truncate() == 1 and log.segments() == [2]


def test_keys_past_the_last_place_of_the_ring_go_to_the_first(spark, tmp_path):
    places = table.ring(3)
    rows = spark.range(4000).select("id", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 32)).alias("h"))
    got = rows.withColumn("shard", table.ring_shard(F.col("id"), 3)).collect()
    assert any(r.h > places[-1][0] for r in got)
    assert all(r.shard == next((s for p, s in places if p >= r.h), places[0][1]) for r in got)
    c = table.ShardedCollection(spark, f"file://{tmp_path}/ring", 3)
    c.upsert(rows)
    c.delete(rows.where("id % 5 = 0"))
    assert sorted(r.id for r in c.read().collect()) == [i for i in range(4000) if i % 5]


def test_tuning():
    axes = [tune.Choice("a", (1, 2)), tune.IntRange("b", 1, 3), tune.fixed("c", "x")]
    g = tune.grid(axes)
    assert len(g) == 6 and [p["a"] for p in g[:2]] == [1, 2] and [p["b"] for p in g[::2]] == [1, 2, 3]
    with pytest.raises(ValueError):
        tune.FloatRange("f", 0, 1).grid()
    space = [tune.IntRange("m", 4, 64, log=True), tune.FloatRange("x", 0.0, 1.0), tune.Choice("k", ("a", "b"))]
    value = lambda p: -abs(p["m"] - 16) / 60 - (p["x"] - 0.3) ** 2 + (p["k"] == "a")
    tpe = tune.TreeParzen(space)
    best = max(v for _, v in tune.run_study(tpe.next, value, 50))
    assert best > np.mean([value(p) for p in tune.random_trials(space, 200)]) and best > 0.85


def test_study_store(tmp_path):
    tune.save_trials([({"a": 1}, 0.5)], str(tmp_path / "s.jsonl"))
    tune.save_trials([({"a": 2}, 0.7)], str(tmp_path / "s.jsonl"))
    assert tune.load_trials(str(tmp_path / "s.jsonl")) == [({"a": 1}, 0.5), ({"a": 2}, 0.7)]


@pytest.mark.parametrize("make", [graph.Hnsw, graph.Vamana])
@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_graph_recall(make, metric):
    x = np.random.default_rng(5).normal(size=(500, 16))
    g = make(x, metric)
    hits = 0
    for i in range(20):
        true = np.argsort(-graph.similarities(x, np.arange(500), x[i], metric), kind="stable")[:10]
        hits += len(set(true.tolist()) & {n for _, n in g.search(x[i], 10, 100)})
    assert hits / 200 >= 0.8
    keep = [n % 5 == 0 for n in range(500)]
    assert all(n % 5 == 0 for _, n in g.search(x[0], 10, 50, keep))
    assert make(x[:0], metric).search(x[0], 3, 10) == [] and [n for _, n in make(x[:1], metric).search(x[0], 3, 10)] == [0]


def test_graph_search_refuses_more_allowed_ids_than_it_holds(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id bigint, vector array<float>")
    q = rows.where("id = 19").selectExpr("id as qid", "vector as qvec")
    index = graph.build(rows)
    assert graph.search(index, q, 20, allowed=rows.select("id"), most_allowed=20).count() == 20
    with pytest.raises(ValueError, match="allowed"):
        graph.search(index, q, 20, allowed=rows.select("id"), most_allowed=19)


def test_framework_filters_and_filter_keys():
    f = filters.translate({"op": "AND", "left": {"op": "GTE", "key": "year", "value": 2020}, "right": {"op": "NOT", "child": {"op": "NIN", "key": "k", "value": ["a"]}}})
    assert f == filters.And((filters.gte("year", 2020), filters.Not(filters.Not(filters.isin("k", ["a"])))))
    for bad in ({"op": "LIKE", "key": "a", "value": 1}, {"op": "EQ", "value": 1}, {"op": "GT", "key": "a", "value": "x"}):
        with pytest.raises(ValueError):
            filters.translate(bad)
    a, b = filters.eq("a", 1), filters.eq("b", 2)
    assert serve.filter_key(None) == serve.filter_key(filters.All()) == 0
    assert serve.filter_key(filters.and_(a, b)) == serve.filter_key(filters.and_(a, b)) != serve.filter_key(filters.and_(b, a))
    assert serve.filter_key(filters.or_(a, b)) != serve.filter_key(filters.and_(a, b))


def test_result_cache_gives_second_chances():
    c = serve.ResultCache(2)
    k = [c.key([float(i)], 1) for i in range(4)]
    c.put(k[0], ["a"])
    c.put(k[1], ["b"])
    assert c.get(k[0]) == ["a"]
    c.put(k[2], ["c"])  # 0 was used, so 1 goes
    assert c.get(k[1]) is None and c.get(k[0]) == ["a"] and c.get(k[2]) == ["c"]
    assert c.counts == {"hits": 3, "misses": 1, "puts": 3, "evictions": 1}


def test_hybrid_falls_back_to_the_leg_that_hit(spark):
    x = np.eye(4, dtype=np.float32)
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "id bigint, vector array<float>")
    text = spark.createDataFrame([(3, 2.0), (1, 1.0)], "id bigint, score double")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(serve.hybrid_or_one(rows, [0.0] * 4, text, 1)) == [3]
    assert ids(serve.hybrid_or_one(rows, [1.0, 0, 0, 0], text.limit(0), 1)) == [0]
    assert set(ids(serve.hybrid_or_one(rows, [1.0, 0, 0, 0], text, 4))) == {0, 1, 2, 3}
    assert serve.hybrid_or_one(rows, None, None, 3).count() == 0


def test_studies_tell_and_apply(spark, tmp_path):
    told = []
    history = tune.run_study([{"a": 1}, {"a": 3}, {"a": 2}], lambda p: p["a"], listener=told.append)
    assert [e["event"] for e in told] == ["started", "finished"] * 3
    assert tune.apply_trial(lambda p: p, history) == {"a": 3}
    tune.save_trials(history, f"file://{tmp_path}/study", spark)
    assert sorted(v for _, v in tune.load_trials(f"file://{tmp_path}/study", spark)) == [1, 2, 3]
    truth = spark.createDataFrame([(0, 1, 1)], "qid int, id int, rank int")
    got = tune.index_trial(lambda p: truth, lambda index, p: index, truth, {"m": 1}, k=1)
    assert got["recall"] == 1.0 and got["objective"] == 1.0 and got["p50_s"] <= got["p95_s"]
