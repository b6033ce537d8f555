"""Versioned collections: immutable generations in a directory, with upsert, delete, compaction and recovery."""

from __future__ import annotations

import hashlib
import json
import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters


# -- pure operators ---------------------------------------------------------------------------------

def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` stand in for those of ``base`` with the same key; others are added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def insert_unique(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append, refusing keys that exist or repeat."""
    if not rows.groupBy(key).count().where("count > 1").isEmpty() or not rows.join(base.select(key), key, "left_semi").isEmpty():
        raise ValueError("duplicate id")
    return base.unionByName(rows)


def delete_ids(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def delete_where(base: DataFrame, f) -> DataFrame:
    c = f if isinstance(f, Column) else filters.to_column(f, filters.FlatFields(base.schema))
    return base.where(~F.coalesce(c, F.lit(False)))


def apply_events(base: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Fold ordered change events (``op`` Add/Upsert/Delete, ``seq``) into a table: the last event of a key decides."""
    from .runtime import latest_version

    last = latest_version(events.where(F.col("op") != "Commit"), key, ["seq"])
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where(F.col("op") != "Delete").select(*base.columns))


def page(df: DataFrame, order: str, offset: int, limit: int, most: int = 1000) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(min(limit, most))


def look_up(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows for the asked ids in their order (``pos``), with ``missing`` for unknown ones."""
    return ids.join(table.withColumn("__there", F.lit(True)), key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there").orderBy("pos")


def reservoir(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows uniformly without replacement; takes n per task before merging."""
    return df.orderBy(F.rand(seed)).limit(n)


def stable_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same n rows on every run: those with the smallest hashes."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def with_side_table(hits: DataFrame, side: DataFrame, key: str) -> DataFrame:
    return hits.join(side, key, "left")


def project(df: DataFrame, *, vector: bool = True, text: bool = True, metadata: bool = True) -> DataFrame:
    """Leave out what is not asked for, so the scan does not read it; the columns stay, as nulls."""
    for name, wanted in (("vector", vector), ("text", text), ("metadata", metadata)):
        if name in df.columns and not wanted:
            df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    return df


# -- generations on storage ---------------------------------------------------------------------------

class Conflict(RuntimeError):
    """Another writer committed the generation that this one was about to write."""


class Store:
    """Files below a path on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jpath(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._p(name))

    def names(self) -> list[str]:
        p = self._jpath(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def sizes(self, name: str) -> dict[str, int]:
        """Size of every file below ``name``, by its name below the store."""
        out, todo = {}, [name]
        while todo:
            at = todo.pop()
            for s in self._fs.listStatus(self._p(at)):
                child = f"{at}/{s.getPath().getName()}"
                if s.isDirectory():
                    todo.append(child)
                else:
                    out[child] = s.getLen()
        return out

    def read_text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist: of several writers one succeeds, the others get :class:`Conflict`."""
        if self.exists(name):
            raise Conflict(f"{name} exists")
        try:
            out = self._fs.create(self._p(name), False)
        except Exception as e:
            raise Conflict(f"{name} exists") from e
        out.write(bytearray(text.encode()))
        out.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file in one step, so that no reader finds it missing."""
        tmp = self._p(f".{name}-{time.time_ns()}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(self.path).toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, self._p(name), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._p(name), True)


class Collection:
    """Versioned rows below ``path``: generation N is the manifest ``gen-N.json`` over a base and the deltas since.

    A write adds a delta of changed rows and deletions; readers lay deltas over the base, the last one of a key
    deciding. After ``max_deltas`` of them the base is written anew. A manifest is created once and holds the size of
    every file and a checksum of itself: two writers of one generation cannot both succeed (:class:`Conflict`; read
    and try again), and :meth:`recover` walks back past damaged generations. ``batch`` numbers must grow: a batch up
    to the last one committed is a replay and is not applied again, however old it is. A write without rows makes no
    generation. With ``auto_commit`` staged rows are committed once there are so many.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id", retain: int = 2, max_deltas: int = 8, auto_commit: int | None = None):
        self.spark, self.key, self.retain, self.max_deltas, self.auto_commit = spark, key, retain, max_deltas, auto_commit
        self.store, self.path = Store(spark, path), path.rstrip("/")
        self._staged: list[DataFrame] = []

    # manifests
    def _numbers(self) -> list[int]:
        return sorted(int(n[4:-5]) for n in self.store.names() if n.startswith("gen-") and n.endswith(".json"))

    def _manifest(self, gen: int) -> dict | None:
        """The manifest of a generation, or none if it is missing, damaged, or its files are not what it says."""
        if not self.store.exists(f"gen-{gen}.json"):
            return None
        try:
            crc, body = self.store.read_text(f"gen-{gen}.json").split(" ", 1)
            if int(crc) != zlib.crc32(body.encode()):
                return None
            m = json.loads(body)
            there = {f: n for d in [m["base"], *m["deltas"]] for f, n in self.store.sizes(d).items()}
            return m if all(there.get(f) == n for f, n in m["files"].items()) else None
        except Exception:
            return None

    def _write_pointer(self, state: dict) -> None:
        self.store.replace("CURRENT", json.dumps({"gen": state["gen"]}))

    @property
    def generation(self) -> int:
        """What readers see: the pointer's generation, 0 before the first."""
        return json.loads(self.store.read_text("CURRENT"))["gen"] if self.store.exists("CURRENT") else 0

    def generations(self) -> list[int]:
        return [g for g in self._numbers() if self._manifest(g) is not None]

    def _frame(self, m: dict) -> DataFrame:
        from .runtime import latest_version

        base = self.spark.read.parquet(f"{self.path}/{m['base']}")
        if not m["deltas"]:
            return base
        parts = [self.spark.read.parquet(f"{self.path}/{d}").withColumn("__seq", F.lit(i)) for i, d in enumerate(m["deltas"])]
        changes = parts[0]
        for p in parts[1:]:
            changes = changes.unionByName(p, allowMissingColumns=True)
        last = latest_version(changes, self.key, ["__seq"])
        live = last.where("not __dead").drop("__dead", "__seq")
        return base.join(last.select(self.key), self.key, "left_anti").unionByName(live, allowMissingColumns=True)

    def read(self, generation: int | None = None) -> DataFrame:
        gen = self.generation if generation is None else generation
        m = self._manifest(gen)
        if m is None:
            raise FileNotFoundError(f"generation {gen} is missing or damaged; see recover()")
        return self._frame(m)

    def _publish(self, gen: int, base: str, deltas: list[str], batch: int | None, last: int | None) -> int:
        files = {f: n for d in [base, *deltas] for f, n in self.store.sizes(d).items()}
        seen = batch if last is None else last if batch is None else max(batch, last)
        body = json.dumps({"gen": gen, "base": base, "deltas": deltas, "batch": seen, "files": files})
        self.store.create(f"gen-{gen}.json", f"{zlib.crc32(body.encode())} {body}")
        self._write_pointer({"gen": gen})
        kept = self.generations()[-self.retain :]
        used = {d for g in kept for m in [self._manifest(g)] if m for d in [m["base"], *m["deltas"]]}
        for g in self._numbers():
            if g not in kept and g < gen:
                self.store.delete(f"gen-{g}.json")
        for n in self.store.names():
            # a folder of a later generation may be another writer's work in hand
            if n.startswith("data-") and n not in used and int(n.split("-")[1]) <= gen:
                self.store.delete(n)
        return gen

    def _state(self) -> tuple[int, dict]:
        gen = self.generation
        return gen, (self._manifest(gen) or {"base": None, "deltas": [], "batch": None}) if gen else {"base": None, "deltas": [], "batch": None}

    def commit(self, rows: DataFrame, batch: int | None = None) -> int:
        """Put ``rows`` in place of everything, as a new base."""
        now, m = self._state()
        if batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return now
        gen = max([now, *self._numbers()]) + 1
        name = f"data-{gen}-{time.time_ns()}"
        rows.write.parquet(f"{self.path}/{name}")
        return self._publish(gen, name, [], batch, m["batch"])

    def apply(self, changes: DataFrame | None, dead: DataFrame | None = None, batch: int | None = None) -> int:
        """Commit rows that stand in for those of their key, and keys that go, as one delta."""
        now, m = self._state()
        if batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return now
        if m["base"] is None:
            if changes is None:
                return now
            return self.commit(changes, batch)
        gen = max([now, *self._numbers()]) + 1
        name = f"data-{gen}-{time.time_ns()}"
        parts = [] if changes is None else [changes.withColumn("__dead", F.lit(False))]
        if dead is not None:
            parts.append(dead.select(self.key).distinct().withColumn("__dead", F.lit(True)))
        delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        delta.write.parquet(f"{self.path}/{name}")
        if self.spark.read.parquet(f"{self.path}/{name}").isEmpty():
            self.store.delete(name)
            return now
        if len(m["deltas"]) + 1 > self.max_deltas:
            whole = self._frame({"base": m["base"], "deltas": [*m["deltas"], name]})
            base = f"data-{gen}-{time.time_ns()}"
            whole.write.parquet(f"{self.path}/{base}")
            return self._publish(gen, base, [], batch, m["batch"])
        return self._publish(gen, m["base"], [*m["deltas"], name], batch, m["batch"])

    def upsert(self, changes: DataFrame, batch: int | None = None) -> int:
        return self.apply(changes, None, batch)

    def add(self, rows: DataFrame) -> int:
        """Add rows with new keys; a key that exists or repeats is an error."""
        if self.generation:
            insert_unique(self.read().select(self.key), rows.select(self.key), self.key)
        return self.apply(rows)

    def delete(self, ids: DataFrame) -> int:
        return self.apply(None, ids.join(self.read().select(self.key), self.key, "left_semi"))

    def delete_where(self, f) -> int:
        live = self.read()
        c = f if isinstance(f, Column) else filters.to_column(f, filters.FlatFields(live.schema))
        return self.apply(None, live.where(F.coalesce(c, F.lit(False))).select(self.key))

    # staging
    def stage(self, rows: DataFrame) -> int | None:
        """Hold rows back until :meth:`flush`, or until ``auto_commit`` of them wait; later rows of a key stand in for earlier ones."""
        self._staged.append(rows)
        if self.auto_commit and sum(r.count() for r in self._staged) >= self.auto_commit:
            return self.flush()
        return None

    def staged(self) -> DataFrame | None:
        out = None
        for rows in self._staged:
            out = rows if out is None else upsert(out, rows, self.key)
        return out

    def view(self) -> DataFrame:
        """Committed rows with the staged ones laid over them: a writer reads its own writes."""
        rows = self.staged()
        if not self.generation:
            if rows is None:
                raise FileNotFoundError("empty collection")
            return rows
        return self.read() if rows is None else upsert(self.read(), rows, self.key)

    def flush(self) -> int:
        rows, self._staged = self.staged(), []
        return self.generation if rows is None else self.apply(rows)

    # maintenance
    def compact(self, files: int | None = None) -> int:
        live = self.read()
        return self.commit(live.repartition(files) if files else live.coalesce(max(1, live.rdd.getNumPartitions() // 4)))

    def recover(self) -> int:
        """Point to the newest whole generation, whatever the pointer says: its checksum and the sizes of its files must hold."""
        for gen in reversed(self._numbers()):
            if self._manifest(gen) is not None:
                if self.generation != gen:
                    self._write_pointer({"gen": gen})
                return gen
        raise FileNotFoundError("no complete generation")

    def export_generation(self, target: str) -> None:
        """Ship the current generation as it is; :meth:`import_generation` of another collection takes it."""
        self.read().write.mode("errorifexists").parquet(target)

    def import_generation(self, source: str) -> int:
        return self.commit(self.spark.read.parquet(source))


# -- shards ---------------------------------------------------------------------------------------------

def ring(shards: int, points: int = 64) -> list[tuple[int, int]]:
    """``(position, shard)`` of a hash ring with ``points`` places for each shard, in order."""
    return sorted((int.from_bytes(hashlib.blake2b(f"{s}#{i}".encode(), digest_size=4).digest()), s) for s in range(shards) for i in range(points))


def ring_shard(key: Column, shards: int, points: int = 64) -> Column:
    """The shard that owns a key: the first place of the ring at or after its hash. Another shard moves about 1 / shards of the keys."""
    places = ring(shards, points)
    h = F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 32))

    def owner(first: int, last: int) -> Column:
        """Halves the places until one shard is left; that after the last is the first again."""
        owners = {places[i % len(places)][1] for i in range(first, last + 1)}
        if len(owners) == 1:
            return F.lit(owners.pop())
        mid = (first + last) // 2
        return F.when(h <= places[mid][0], owner(first, mid)).otherwise(owner(mid + 1, last))

    return owner(0, len(places))


class ShardedCollection:
    """Collections of which each owns the keys of its stretch of the ring. Writes are routed; a commit is atomic within a shard only."""

    def __init__(self, spark: SparkSession, path: str, shards: int, key: str = "id", **options):
        self.key, self.shards = key, [Collection(spark, f"{path.rstrip('/')}/shard-{i}", key, **options) for i in range(shards)]
        self._shard = ring_shard(F.col(key), shards)

    def _own(self, rows: DataFrame, i: int) -> DataFrame:
        return rows.where(self._shard == i)

    def upsert(self, rows: DataFrame, batch: int | None = None) -> list[int]:
        return [c.upsert(self._own(rows, i), batch) for i, c in enumerate(self.shards)]

    def delete(self, ids: DataFrame) -> list[int]:
        return [c.delete(self._own(ids, i)) for i, c in enumerate(self.shards) if c.generation]

    def delete_where(self, f) -> list[int]:
        """Goes to every shard, since any may hold matching rows."""
        return [c.delete_where(f) for c in self.shards if c.generation]

    def read(self) -> DataFrame:
        """All rows with their ``shard``."""
        out = None
        for i, c in enumerate(self.shards):
            if c.generation:
                rows = c.read().withColumn("shard", F.lit(i))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError("empty collection")
        return out


# -- write-ahead log ------------------------------------------------------------------------------------

class WriteAheadLog:
    """Segments ``seg-N`` of appended rows; each exists once its mark is created, which one writer can do. ``INDEXED`` names the last segment that an index holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def segments(self) -> list[int]:
        return sorted(int(n[4:-5]) for n in self.store.names() if n.startswith("seg-") and n.endswith(".mark"))

    def append(self, rows: DataFrame) -> int:
        """Durable once it returns; on :class:`Conflict` another writer took the number and the append is to be repeated."""
        n = max(self.segments(), default=0) + 1
        data = f"data-{n}-{time.time_ns()}"
        rows.write.parquet(f"{self.path}/{data}")
        self.store.create(f"seg-{n}.mark", data)
        return n

    @property
    def indexed(self) -> int:
        return int(self.store.read_text("INDEXED")) if self.store.exists("INDEXED") else 0

    def mark_indexed(self, n: int) -> None:
        if n > self.indexed:
            self.store.replace("INDEXED", str(n))

    def replay(self, after: int | None = None) -> DataFrame | None:
        """Rows of the segments after ``after`` (default: those no index holds) with their ``segment``, or none."""
        out = None
        for n in self.segments():
            if n > (self.indexed if after is None else after):
                rows = self.spark.read.parquet(f"{self.path}/{self.store.read_text(f'seg-{n}.mark')}").withColumn("segment", F.lit(n))
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def truncate(self) -> int:
        """Drop the segments that the index holds; how many."""
        gone = [n for n in self.segments() if n <= self.indexed]
        for n in gone:
            self.store.delete(self.store.read_text(f"seg-{n}.mark"))
            self.store.delete(f"seg-{n}.mark")
        return len(gone)
