"""Micro-batch ingest on Structured Streaming into a versioned collection."""

from __future__ import annotations

import queue
import random
import threading
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runtime import latest_version
from ..operators.table import Collection

DOC_SCHEMA = "id string, text string, blob binary, mime string, attrs map<string,string>, precomputedVector array<float>"


def payload_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("blob"), F.lit(0))


def batch_numbers(docs: DataFrame, order: str, *, by: str, max_docs: int = 1024, max_bytes: int = 32 << 20, size: Column | None = None) -> DataFrame:
    """``by, order, batch``: the flush boundaries of a policy, per source partition ``by``, in ``order``.

    A batch is flushed by the document that makes it reach ``max_docs`` or ``max_bytes``. Where a boundary falls
    depends on the one before, so the sorted rows of a partition are streamed once.
    """
    rows = docs.select(F.col(by).alias("by"), F.col(order).alias("pos"), (size if size is not None else payload_bytes()).cast("bigint").alias("size"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("by", "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, n, total = object(), 0, 0, 0  # of the open batch: its source, number, documents and bytes
        for b in batches:
            sizes = pc.fill_null(b.column("size"), 0).to_numpy(zero_copy_only=False)
            keys, out = b.column("by"), np.empty(b.num_rows, np.int64)
            change = pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1))).to_numpy(zero_copy_only=False).nonzero()[0] + 1 if b.num_rows > 1 else np.empty(0, np.int64)
            for i, j in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                if i == j:
                    continue
                if keys[i] != now:
                    now, batch, n, total = keys[i], 0, 0, 0
                upto = np.cumsum(sizes[i:j])
                while i < j:  # a step for each flush
                    base = upto[len(upto) - (j - i)] - sizes[i]
                    by_bytes = int(np.searchsorted(upto, base + max_bytes - total)) - (len(upto) - (j - i)) + 1
                    take = min(j - i, max(1, max_docs - n), max(1, by_bytes))
                    out[i : i + take] = batch
                    n, total, i = n + take, total + int(sizes[i : i + take].sum()), i + take
                    if n >= max_docs or total >= max_bytes:
                        batch, n, total = batch + 1, 0, 0
            yield pa.RecordBatch.from_arrays([b.column("by"), b.column("pos"), pa.array(out)], ["by", "pos", "batch"])

    done = rows.repartition("by").sortWithinPartitions("by", "pos").mapInArrow(run, f"by {kinds['by']}, pos {kinds['pos']}, batch bigint")
    return done.select(F.col("by").alias(by), F.col("pos").alias(order), "batch")


def hashing_embedder(dim: int = 64) -> Callable[[str], Column]:
    """A deterministic text -> vector function for pipelines without a model: hashed words, unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 31 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed


def retrying(fn: Callable[[], object], *, attempts: int = 5, base: float = 0.1, factor: float = 2.0, jitter: float = 0.2, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """Call ``fn`` with exponential backoff and jitter; wrong arguments and states (ValueError, TypeError) are not retried."""
    for i in range(attempts):
        try:
            return fn()
        except (ValueError, TypeError):
            raise
        except Exception:
            if i == attempts - 1:
                raise
            sleep(min(most, base * factor**i) * (1 + random.uniform(-jitter, jitter)))


def read_jsonl_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(DOC_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(stream: DataFrame, target: Collection, checkpoint: str, *, embed: Callable | None = None, side: Collection | None = None, on_error: str = "fail", dead_letters: str | None = None, once: bool = True, latency: str = "1 second", listener: Callable[[dict], None] | None = None):
    """Start ``stream -> embed -> vector collection -> side table``; returns the query.

    At least once with idempotent commits: the collection remembers the batch id, so a batch
    replayed after a crash is not applied twice. Within a batch the last row of an id wins.
    Rows with a precomputed vector are not embedded again. ``on_error``: ``fail`` stops the query, ``continue`` writes
    the batch to ``dead_letters`` and goes on. Unless ``once``, a batch starts at the latest ``latency`` after the one before.
    ``listener`` is told of every batch: its number, rows, retries and outcome.
    """
    vector = F.col("precomputedVector")
    if embed is not None:
        vector = F.coalesce(vector, F.when(F.col("text").isNotNull(), embed("text")))

    def write(batch: DataFrame, number: int) -> None:
        try:
            rows = batch.where("id is not null").withColumn("__seq", F.monotonically_increasing_id())
            rows = latest_version(rows, "id", ["__seq"]).drop("__seq")
            tries = []
            retrying(lambda: (tries.append(1), target.upsert(rows.select("id", vector.alias("vector"), "text", F.col("attrs").alias("metadata")).where("vector is not null"), number)))
            if side is not None:
                retrying(lambda: side.upsert(rows.select("id", "text", "blob", "mime"), number))
            if listener is not None:
                listener({"batch": number, "rows": rows.count(), "retries": len(tries) - 1, "generation": target.generation, "outcome": "committed"})
        except Exception as e:
            if listener is not None:
                listener({"batch": number, "outcome": "failed", "error": repr(e)})
            if on_error == "fail":
                raise
            if dead_letters:
                batch.write.mode("append").parquet(dead_letters)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=latency)).start()


class Counters:
    """Totals of an ingest, as its ``listener``: batches, rows, retries and failures."""

    def __init__(self):
        self.batches = self.rows = self.retries = self.failures = 0

    def __call__(self, event: dict) -> None:
        if event["outcome"] == "failed":
            self.failures += 1
        else:
            self.batches, self.rows, self.retries = self.batches + 1, self.rows + event["rows"], self.retries + event["retries"]


class CommitFeed:
    """Hands events to any number of subscribers, each with a queue of ``most`` of them; one whose queue is full is dropped."""

    def __init__(self, most: int = 1024):
        self.most, self._queues, self._lock = most, {}, threading.Lock()

    def subscribe(self, name: str) -> queue.Queue:
        with self._lock:
            return self._queues.setdefault(name, queue.Queue(self.most))

    def subscribers(self) -> list[str]:
        return sorted(self._queues)

    def __call__(self, event: dict) -> None:
        with self._lock:
            for name, q in list(self._queues.items()):
                try:
                    q.put_nowait(event)
                except queue.Full:
                    del self._queues[name]


def follow_events(stream: DataFrame, target: Collection, checkpoint: str, *, once: bool = True):
    """Apply a change stream (``op, seq, id, vector, text, metadata``) batch by batch; the last event of an id decides."""

    def write(batch: DataFrame, number: int) -> None:
        columns = [c for c in batch.columns if c not in ("op", "seq")]
        last = latest_version(batch.where("op <> 'Commit'"), target.key, ["seq"])
        target.apply(last.where("op <> 'Delete'").select(*columns), last.where("op = 'Delete'").select(target.key), number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


class Replica:
    """A read-only follower: ``refresh`` moves to the newest generation, readers keep theirs until then."""

    def __init__(self, source: Collection):
        self.source, self.generation = source, source.generation

    def read(self) -> DataFrame:
        return self.source.read(self.generation)

    def refresh(self) -> bool:
        newest = self.source.generation
        changed, self.generation = newest != self.generation, newest
        return changed
