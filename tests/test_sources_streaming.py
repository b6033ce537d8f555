import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import runtime
from quiverlake.operators.table import Collection
from quiverlake.sources import formats
from quiverlake.streaming import ingest


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "text": "x", "attrs": {"k": "v"}}\n\nnot-json\n{"id": "2", "precomputedVector": [1, 2]}\n')
    assert [r.id for r in formats.read_jsonl(spark, str(p), on_error="skip").collect()] == ["1", "2"]
    assert [r.id for r in formats.read_jsonl(spark, str(p), on_error="skip", skip=1).collect()] == ["2"]
    with pytest.raises(Exception, match="malformed JSONL"):
        formats.read_jsonl(spark, str(p)).collect()


def test_directory(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.txt").write_text("A")
    (tmp_path / "b" / "c.txt").write_text("ü")
    (tmp_path / ".hidden").write_text("no")
    assert [tuple(r) for r in formats.read_directory(spark, str(tmp_path)).collect()] == [("a.txt", "A"), ("b/c.txt", "ü")]


@pytest.mark.parametrize(("suffix", "dtype"), [("fvecs", "<f4"), ("ivecs", "<i4"), ("bvecs", "u1")])
def test_vecs(spark, tmp_path, suffix, dtype):
    m = np.arange(12).reshape(3, 4).astype(dtype)
    p = tmp_path / f"x.{suffix}"
    p.write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in m))
    assert [list(r.vector) for r in formats.read_vecs(spark, str(p)).orderBy("row").collect()] == m.tolist()


def test_vecs_in_ranges_and_folders(spark, tmp_path):
    m = np.arange(400, dtype="<f4").reshape(100, 4)
    for name, rows in (("a", m[:60]), ("b", m[60:])):
        (tmp_path / f"{name}.fvecs").write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in rows))
    got = formats.read_vecs(spark, f"file://{tmp_path}", chunk_bytes=200)
    assert got.rdd.getNumPartitions() >= 10 and sorted(tuple(r.vector) for r in got.collect()) == [tuple(r) for r in m.tolist()]
    (tmp_path / "b.fvecs").write_bytes(b"\x04\x00\x00\x00abc")
    with pytest.raises(ValueError, match="whole number"):
        formats.read_vecs(spark, str(tmp_path / "b.fvecs"))


def test_arrow_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", [1.0, 2.0], "t", {"a": "b"}), ("2", [3.0, 4.0], None, {})], "id string, vector array<float>, text string, metadata map<string,string>")
    formats.export_arrow(df, str(tmp_path / "out"), 2)
    back = formats.read_arrow(spark, str(tmp_path / "out")).select(*df.columns).orderBy("id").collect()
    assert back == df.orderBy("id").collect()


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_arrow_round_trip_below_the_shared_folder(spark, tmp_path, monkeypatch, scheme):
    """The folder that executors share may be set without a scheme, as spark-defaults.conf does, or with one slash; it is a URI to the tasks."""
    monkeypatch.setattr(runtime, "_roots", {})
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: f"{scheme}{tmp_path}/shared")
    root = runtime.stage_root(spark)
    assert root.startswith(f"file://{tmp_path}/shared/")
    df = spark.range(5).selectExpr("cast(id as string) id", "array(float(id), float(1)) vector", "'t' text", "map('k', 'v') metadata")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://another:7077")
    formats.export_arrow(df, f"{root}/out", 2)
    assert sorted(formats.read_arrow(spark, f"{root}/out").collect()) == sorted(df.collect())
    formats.export_arrow(df, f"file:{tmp_path}/one-slash", 2)
    assert formats.read_arrow(spark, f"file:{tmp_path}/one-slash").count() == 5
    with pytest.raises(ValueError, match="give a URI"):
        formats.export_arrow(df, f"{tmp_path}/bare", 2)


def test_tsv_matrix_and_hub(spark, tmp_path):
    df = spark.createDataFrame([("1", "a\tb\n" + "x" * 200, [1.0, 2.0])], "id string, text string, vector array<float>")
    formats.export_tsv(df, str(tmp_path / "t"))
    assert len(spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().text) == 120
    assert np.frombuffer(formats.matrix_bytes(df).first()[0], "<f4").tolist() == [1.0, 2.0]
    rows = formats.read_hub_rows(spark, lambda o, n: [{"id": str(i), "text": "t"} for i in range(o, o + n)], 250)
    assert rows.count() == 250
    assert formats.from_iterable(spark, [("1", "t", None, None, None)]).count() == 1


def test_batch_policy(spark):
    df = spark.range(7).select("id", F.lit("p").alias("part"), F.lit("x").alias("text"), F.lit(None).cast("binary").alias("blob"))
    got = ingest.batch_numbers(df, "id", by="part", max_docs=3).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [3, 3, 1]
    sizes = [5, 5, 1, 20, 1, 9, 1]
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(sizes)], "part string, id int, n int")
    got = ingest.batch_numbers(df, "id", by="part", max_bytes=10, size=F.col("n")).orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 1, 1, 2, 2, 3]


def test_ingest_resumes_and_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("\n".join(map(json.dumps, rows)))
    put("1.json", [{"id": "1", "text": "old"}, {"id": "2", "precomputedVector": [1.0] * 64}])
    target, side = Collection(spark, f"file://{tmp_path}/t"), Collection(spark, f"file://{tmp_path}/s")

    def go():
        q = ingest.ingest(ingest.read_jsonl_stream(spark, str(src)), target, str(tmp_path / "ck"), embed=ingest.hashing_embedder(), side=side)
        q.awaitTermination()

    go()
    first = target.generation
    go()  # nothing new
    assert target.generation == first
    put("2.json", [{"id": "1", "text": "new"}])
    go()
    assert {r.id: r.text for r in target.read().collect()} == {"1": "new", "2": None}
    assert side.read().count() == 2


def test_change_stream(spark, tmp_path):
    src = tmp_path / "ev"
    schema = "op string, seq int, id string, vector array<float>, text string, metadata map<string,string>"
    spark.createDataFrame([("Add", 1, "a", [1.0], "t", None), ("Delete", 2, "a", None, None, None), ("Upsert", 3, "b", [2.0], "u", None)], schema).write.parquet(str(src))
    target = Collection(spark, f"file://{tmp_path}/t")
    ingest.follow_events(spark.readStream.schema(schema).parquet(str(src)), target, str(tmp_path / "ck")).awaitTermination()
    replica = ingest.Replica(target)
    assert [r.id for r in replica.read().collect()] == ["b"]
    target.upsert(replica.read().withColumn("text", F.lit("v")))
    assert replica.read().first().text == "u" and replica.refresh() and replica.read().first().text == "v"


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "ok"

    assert ingest.retrying(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        ingest.retrying(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=lambda s: None)


def test_hdf5_needs_its_library(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            formats.read_hdf5(spark, "x.h5")


def test_counters_and_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "1", "text": "a"}\n{"id": "2", "text": "b"}')
    counters, feed = ingest.Counters(), ingest.CommitFeed(1)
    slow = feed.subscribe("slow")

    def tell(e):
        counters(e)
        feed(e)
        feed(e)

    target = Collection(spark, f"file://{tmp_path}/t")
    ingest.ingest(ingest.read_jsonl_stream(spark, str(tmp_path / "in")), target, str(tmp_path / "ck"), embed=ingest.hashing_embedder(), listener=tell).awaitTermination()
    assert (counters.batches, counters.rows, counters.failures) == (1, 2, 0)
    assert slow.get()["outcome"] == "committed" and feed.subscribers() == []


def test_iterables_in_chunks_and_batches_as_row_by_row(spark):
    docs = [(str(i), "t", None, None, None) for i in range(25)]
    assert formats.from_iterable(spark, iter(docs), chunk=10).count() == 25
    rng = np.random.default_rng(3)
    rows = [(p, i, int(rng.integers(0, 30))) for p in "ab" for i in range(200)]
    got = {(r.part, r.i): r.batch for r in ingest.batch_numbers(spark.createDataFrame(rows, "part string, i int, n int"), "i", by="part", max_docs=7, max_bytes=60, size=F.col("n")).collect()}
    for p in "ab":
        batch = n = total = 0
        for _, i, size in [r for r in rows if r[0] == p]:
            assert got[p, i] == batch
            n, total = n + 1, total + size
            if n >= 7 or total >= 60:
                batch, n, total = batch + 1, 0, 0
