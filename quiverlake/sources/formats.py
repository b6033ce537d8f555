"""Readers and writers: JSONL, directories, Arrow IPC, TexMex embeddings, TSV and raw matrices; HDF5 where h5py is present."""

from __future__ import annotations

import itertools
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  (pa.fs in the tasks)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runtime import qualified, stage_root
from ..operators.text import export_text

JSONL_SCHEMA = "id string, text string, mime string, attrs map<string,string>, precomputedVector array<double>"


def read_jsonl(spark: SparkSession, path: str, *, on_error: str = "fail", skip: int = 0) -> DataFrame:
    """Documents of a JSON-lines file. Blank lines are skipped; a malformed line or one without id fails, or with
    ``on_error='skip'`` is left out. ``skip`` resumes after that many valid documents (needs file order)."""
    raw = spark.read.schema(JSONL_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    raw = raw.where("_bad is null or trim(_bad) <> ''")
    bad = F.col("_bad").isNotNull() | F.col("id").isNull()
    if on_error == "fail":
        checked = raw.withColumn("id", F.when(bad, F.raise_error(F.concat(F.lit("malformed JSONL: "), F.coalesce("_bad", F.lit("no id"))))).otherwise(F.col("id")))
    else:
        checked = raw.where(~bad)
    out = checked.drop("_bad")
    return _after(out, skip) if skip else out


def _after(df: DataFrame, skip: int) -> DataFrame:
    """Leave out the first ``skip`` rows in the order of files. Only one count for each partition is collected; the rows stay where they are."""
    numbered = df.withColumn("__i", F.monotonically_increasing_id())
    part, place = F.shiftright("__i", 33), F.col("__i").bitwiseAND((1 << 33) - 1)
    first, starts = 0, []
    for r in numbered.groupBy(part.alias("p")).count().orderBy("p").collect():
        starts.append((r.p, first))
        first += r["count"]
    if not starts:
        return df
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts for x in p]), part)
    return numbered.where(start + place >= skip).drop("__i")


def read_directory(spark: SparkSession, path: str, *, as_text: bool = True, ordered: bool = True) -> DataFrame:
    """One document per regular file, recursively, dot-files left out: ``id`` is the path below ``path``; ``text`` or ``blob``.

    Sorted by id as a listing is; for large trees ``ordered=False`` spares the sort.
    """
    root = os.path.abspath(path).rstrip("/") + "/" if "://" not in path else path.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.substring_index(F.col("path"), root, -1), "^/+", "")
    out = files.select(rel.alias("id"), F.col("content")).where(~F.col("id").rlike(r"(^|/)\."))
    out = out.select("id", F.decode("content", "UTF-8").alias("text") if as_text else F.col("content").alias("blob"))
    return out.orderBy("id") if ordered else out


def from_iterable(spark: SparkSession, docs, schema: str = JSONL_SCHEMA, *, chunk: int = 50_000) -> DataFrame:
    """Documents of any iterable. They are written in chunks of ``chunk``, so the driver holds one chunk at a time."""
    source, path = iter(docs), f"{stage_root(spark)}/iterable-{uuid.uuid4().hex}"
    held = list(itertools.islice(source, chunk))
    more = list(itertools.islice(source, chunk)) if len(held) == chunk else []
    if not more:
        return spark.createDataFrame(held, schema)
    while held:
        spark.createDataFrame(held, schema).write.mode("append").parquet(path)
        held, more = more, list(itertools.islice(source, chunk)) if more else []
    return spark.read.parquet(path)


VECS = {"f": ("<f4", 4, "float"), "i": ("<i4", 4, "int"), "b": ("u1", 1, "float")}  # fixed values: element type and width by the suffix's first letter


def _store(path: str):
    """File system and path of a URI; a bare path is local."""
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def read_vecs(spark: SparkSession, path: str, *, chunk_bytes: int = 32 << 20) -> DataFrame:
    """fvecs, ivecs or bvecs by suffix, a file or a folder of them: ``row bigint, vector``; ``row`` counts within a file.

    A file is read in ranges of about ``chunk_bytes`` by as many tasks; the driver reads only each file's first four bytes.
    """
    store, at = _store(path)
    info = store.get_file_info(at)
    files = [f for f in store.get_file_info(pa.fs.FileSelector(at, recursive=True)) if f.is_file] if info.type == pa.fs.FileType.Directory else [info]
    kind = files[0].path.rsplit(".", 1)[-1][:1] if files else "f"
    dtype, width, out = VECS[kind]
    scheme = path.split("://")[0] + "://" if "://" in path else "file://"
    authority = path.split("://")[1].split("/")[0] if "://" in path and not path.startswith("file:") else ""
    ranges = []
    for f in sorted(files, key=lambda f: f.path):
        if not f.size:
            continue
        with store.open_input_file(f.path) as source:
            (dim,) = struct.unpack("<i", source.read(4))
        row = 4 + dim * width
        if dim <= 0 or f.size % row:
            raise ValueError(f"{f.path}: no whole number of {dim}-dimensional rows")
        step = max(1, chunk_bytes // row)
        name = f.path if authority and f.path.startswith(authority) else f"{authority}{f.path}"
        ranges += [(scheme + name, i, min(step, f.size // row - i), dim) for i in range(0, f.size // row, step)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first, n, dim in zip(*(b.column(c).to_pylist() for c in ("uri", "first", "n", "dim"))):
                own, name = _store(uri)
                row = 4 + dim * width
                with own.open_input_file(name) as source:
                    source.seek(first * row)
                    raw = np.frombuffer(source.read(n * row), np.uint8).reshape(n, row)
                if (raw[:, :4].copy().view("<i4") != dim).any():
                    raise ValueError(f"{uri}: rows differ in length")
                m = raw[:, 4:].copy().view(dtype)
                for i in range(0, n, 10_000):
                    part = m[i : i + 10_000]
                    flat = pa.array(part.reshape(-1).astype({"float": np.float32, "int": np.int32}[out]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + i, first + i + len(part))), pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, dim, dtype=np.int32)), flat)], ["row", "vector"])

    table = spark.createDataFrame(ranges, "uri string, first bigint, n bigint, dim int").repartition(max(1, len(ranges)))
    return table.mapInArrow(run, f"row bigint, vector array<{out}>")


def read_hdf5(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ANN-benchmark layout (train, test, neighbors, distances); needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs h5py, which is not installed") from e
    with h5py.File(path) as f:
        return {k: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(f[k][:])], "row bigint, vector array<double>") for k in ("train", "test", "neighbors", "distances") if k in f}


def read_hub_rows(spark: SparkSession, fetch, n_rows: int, *, page: int = 100, schema: str = "id string, text string, metadata map<string,string>") -> DataFrame:
    """Paged rows of a dataset service: ``fetch(offset, length)`` returns dicts and is called in the tasks, a page at a time."""
    pages = spark.range(0, n_rows, page).repartition(max(1, min(64, n_rows // page or 1)))
    columns = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for offset in b["id"]:
                rows = fetch(int(offset), min(page, n_rows - int(offset)))
                if rows:
                    import pandas as pd

                    yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    return pages.mapInPandas(run, schema)


ARROW_SCHEMA_COLUMNS = ("id", "vector", "text", "metadata_json")


def export_arrow(df: DataFrame, path: str, dim: int, *, rows: int = 1000) -> None:
    """Arrow IPC streams, one file per partition below ``path``: id, vector as a fixed-size list, text, metadata_json; batches of ``rows``.

    ``path`` is a URI of a file system that every task reaches (``hdfs:``, ``s3:``, ``file:`` on a mount); a bare path only where Spark runs
    in one process. A file gets its name once it is whole, so a repeated task leaves one.
    """
    uri = path if "://" in path else qualified(df.sparkSession, path)
    if uri.startswith("file:") and ":" not in path.split("/")[0] and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("a path without a scheme is local to each executor; give a URI")
    schema = pa.schema([pa.field("id", pa.utf8(), False), pa.field("vector", pa.list_(pa.float32(), dim), False), pa.field("text", pa.utf8()), pa.field("metadata_json", pa.utf8())])
    shaped = df.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "text", F.to_json("metadata").alias("metadata_json"))
    pa.fs.FileSystem.from_uri(uri)[0].create_dir(pa.fs.FileSystem.from_uri(uri)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = pa.fs.FileSystem.from_uri(uri)
        name, n = f"{folder}/part-{TaskContext.get().partitionId():05d}.arrow", 0
        tmp = f"{folder}/.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(tmp) as sink, pa.ipc.new_stream(sink, schema) as writer:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    p = b.slice(at, rows)
                    fixed = pa.FixedSizeListArray.from_arrays(p.column("vector").flatten().cast(pa.float32()), dim)
                    writer.write_batch(pa.RecordBatch.from_arrays([p.column("id").cast(pa.utf8()), fixed, p.column("text").cast(pa.utf8()), p.column("metadata_json").cast(pa.utf8())], schema=schema))
                    n += p.num_rows
        store.move(tmp, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "n"])

    shaped.mapInArrow(run, "file string, n bigint").collect()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Read back what :func:`export_arrow` wrote, one task per file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("content").to_pylist():
                with pa.ipc.open_stream(blob) as reader:
                    for r in reader:
                        yield pa.RecordBatch.from_arrays([r.column("id"), r.column("vector").cast(pa.list_(pa.float32())), r.column("text"), r.column("metadata_json")], list(ARROW_SCHEMA_COLUMNS))

    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInArrow(run, "id string, vector array<float>, text string, metadata_json string")
    return raw.withColumn("metadata", F.from_json("metadata_json", "map<string,string>")).drop("metadata_json")


def export_tsv(df: DataFrame, path: str, columns: tuple[str, ...] = ("id", "text")) -> None:
    df.select(*[export_text(F.col(c).cast("string")).alias(c) for c in columns]).write.option("sep", "\t").option("header", "true").csv(path)


def matrix_bytes(df: DataFrame, vec_col: str = "vector") -> DataFrame:
    """``bytes``: little-endian float32 rows, one chunk per Arrow batch, in partition order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary())], ["bytes"])

    return df.select(F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, "bytes binary")
