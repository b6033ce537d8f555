"""Session-level helpers: reliable materialisation, live versions, sorted-group iteration."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is chosen and set, but only if Spark runs in one process
    (tests); on a cluster a machine-local folder would be lost on the executors, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quiverlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the file system that Spark takes it to lie on, with ``file:///`` for a local one."""
    fs, p = _hadoop_path(spark, path)
    return re.sub("^file:/+", "file:///", fs.makeQualified(p).toString())


def stage_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, as a URI; the JVM deletes it when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = qualified(spark, f"{shared_dir(spark)}/quiverlake/{app}")
        fs, p = _hadoop_path(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _roots[app] = root
    return _roots[app]


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of any executor. The table goes with the
    application, or before with :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "_stage_path", None)
        if path:
            fs, p = _hadoop_path(t.sparkSession, path)
            fs.delete(p, True)


def latest_version(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key``: the greatest by ``order`` (descending, nulls last).

    Rows with a null key have no identity and are left out. Spark plans this as
    WindowGroupLimit, so each map task forwards one row of a key at most, however often
    the key repeats.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    rn = f"__rn_{uuid.uuid4().hex[:8]}"
    return df.where(F.col(key).isNotNull()).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Split a stream of batches sorted by ``key`` into one table per key value.

    Only the current group is held back, so memory follows the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(key)
        if batch.num_rows > 1:
            cuts = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *(cuts.nonzero()[0] + 1).tolist(), batch.num_rows]
        else:
            starts = [0, 1]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a side that must be small, failing loudly when it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; use the partitioned path")
    return rows


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
