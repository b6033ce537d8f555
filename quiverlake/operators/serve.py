"""What stands around a search: stores with thresholds and diversity, hybrid search with fallbacks, replicas, routers, result caches."""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import is_dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, fusion, route, search

FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values: the public 64-bit FNV-1a constants


# -- stores -----------------------------------------------------------------------------------------

def store_search(table: DataFrame, query: list[float], k: int, *, threshold: float = 0.0, where=None, diversity: float | None = None, fetch: int = 4, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", metadata: str | None = None) -> DataFrame:
    """``id, score``: a document store's similarity search. A ``threshold`` above 0 is the least score; ``where`` is a filter, also in the
    form of :func:`filters.translate`; with ``diversity`` (0..1, the share of relevance) the best ``k x fetch`` are re-ranked for variety."""
    where = filters.translate(where) if isinstance(where, (dict, list)) else where
    least = threshold if threshold > 0 else None
    if diversity is None:
        return search.search(table, query, k, metric=metric, id_col=id_col, vec_col=vec_col, where=where, metadata=metadata, min_score=least)
    hits = search.search(table, query, k * fetch, metric=metric, id_col=id_col, vec_col=vec_col, where=where, metadata=metadata, min_score=least, with_columns=(vec_col,))
    ranked = fusion.with_ranks(hits.select(F.col(id_col).alias("id"), "score", F.col(vec_col).alias("vector"), F.lit(0).alias("qid")), ("qid",))
    q = F.array(*[F.lit(float(x)) for x in query])
    picked = fusion.mmr(ranked.withColumn("qvec", q), k, trade=diversity, metric=metric)
    return picked.join(ranked.select("id", "score"), "id").orderBy("place").select(F.col("id").alias(id_col), "score")


def keyed_search(table: DataFrame, query: list[float], k: int, options: dict | None = None, **more) -> DataFrame:
    """A search whose options may hold a filter under the key ``__filter__`` (a tree or the JSON language); all other keys are ignored."""
    f = (options or {}).get("__filter__")
    return search.search(table, query, k, where=filters.parse_json(f) if isinstance(f, (str, dict)) else f, **more)


def hybrid_or_one(table: DataFrame, query: list[float] | None, text_hits: DataFrame | None, k: int, *, index=None, total: int | None = None, metric: str = "cosine", constant: int = 60) -> DataFrame:
    """Both legs fetch 2k; fused by reciprocal rank if both hit anything, otherwise the leg that did. A zero query counts as none.

    With ``index`` (a stored clustered index) the vector leg probes ceil(sqrt(n)) lists, at least 4 and at most 32. No filter is consulted.
    """
    legs = []
    if query is not None and any(query):
        if index is None:
            legs.append(search.search(table, query, 2 * k, metric=metric).select("id", "score"))
        else:
            n = total if total is not None else table.count()
            asked = table.sparkSession.createDataFrame([(0, [float(x) for x in query])], "qid int, qvec array<double>")
            legs.append(index.search(asked, 2 * k, nprobe=min(32, max(4, math.ceil(math.sqrt(n)))), metric=metric).select("id", "score"))
    if text_hits is not None:
        legs.append(text_hits.select("id", "score").orderBy(F.desc("score"), "id").limit(2 * k))
    legs = [leg for leg in legs if not leg.isEmpty()]
    if not legs:
        return table.select("id").withColumn("score", F.lit(0.0)).limit(0)
    if len(legs) == 1:
        return legs[0].orderBy(F.desc("score"), "id").limit(k)
    return fusion.hybrid(legs, k, constant=constant)


def text_hits_with_rows(hits: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Full-text hits with the columns of their rows; hits without a row are dropped."""
    return hits.join(base, key)


# -- replicas and routers --------------------------------------------------------------------------------

class Replicas:
    """Equal copies of a table or an index, used in turn."""

    def __init__(self, copies: list):
        if not copies:
            raise ValueError("at least one replica is needed")
        self.copies, self._turn = list(copies), 0

    def next(self):
        self._turn += 1
        return self.copies[(self._turn - 1) % len(self.copies)]

    def search(self, run: Callable, *args, **more):
        """``run`` over the replica whose turn it is, such as ``search.search``."""
        return run(self.next(), *args, **more)


class Router:
    """Named routes of reference rows (``ref_id, name, vector, threshold``)."""

    def __init__(self, refs: DataFrame, default: float = route.DEFAULT_ROUTE_DISTANCE):
        self.refs, self.default = refs, default

    def names(self) -> list[str]:
        """Sorted; the names of routes are a short list by their nature, more than 100,000 are an error."""
        found = self.refs.select("name").where("name is not null").distinct().limit(100_001).collect()
        if len(found) > 100_000:
            raise ValueError("more than 100,000 routes")
        return sorted(r[0] for r in found)

    def get(self, name: str) -> DataFrame:
        return self.refs.where(F.col("name") == name)

    def with_route(self, refs: DataFrame) -> Router:
        """Routes of ``refs`` stand in for those of the same names."""
        return Router(self.refs.join(refs.select("name").distinct(), "name", "left_anti").select(self.refs.columns).unionByName(refs), self.default)

    def without(self, name: str) -> Router:
        return Router(self.refs.where(F.col("name") != name), self.default)

    def route(self, queries: DataFrame) -> DataFrame:
        return route.route(self.refs, queries, default=self.default)


# -- caches ------------------------------------------------------------------------------------------------

def _canonical(f):
    if is_dataclass(f):
        return [type(f).__name__, *[_canonical(getattr(f, k)) for k in f.__dataclass_fields__]]
    if isinstance(f, (tuple, list)):
        return [_canonical(x) for x in f]
    return f


def filter_key(f) -> int:
    """64-bit FNV-1a of a filter's tree, 0 for everything and none. The order of the parts of and/or counts."""
    if f is None or isinstance(f, filters.All):
        return 0
    h = FNV_OFFSET
    for byte in json.dumps(_canonical(f), ensure_ascii=False).encode():
        h = (h ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


class ResultCache:
    """Results of searches, at most ``size`` of them, by query, k, filter, metric and the generation of the table.

    A hit marks its entry; when the cache is full the hand passes over marked entries, clearing the mark, and the
    first unmarked one goes (CLOCK). ``counts`` has hits, misses, puts and evictions. Entries are the rows of a
    result of k rows, held on the driver.
    """

    def __init__(self, size: int = 1024):
        if size < 1:
            raise ValueError("size must be positive")
        self.size, self._rows, self.counts = size, OrderedDict(), {"hits": 0, "misses": 0, "puts": 0, "evictions": 0}

    @staticmethod
    def key(query, k: int, where=None, metric: str = "cosine", generation: int = 0) -> tuple:
        return np.asarray(query, np.float32).tobytes(), k, filter_key(where), metric, generation

    def get(self, key: tuple):
        entry = self._rows.get(key)
        self.counts["misses" if entry is None else "hits"] += 1
        if entry is None:
            return None
        entry[1] = True
        return entry[0]

    def put(self, key: tuple, rows: list) -> None:
        self.counts["puts"] += 1
        if key not in self._rows and len(self._rows) >= self.size:
            while True:
                old, entry = self._rows.popitem(last=False)
                if not entry[1]:
                    self.counts["evictions"] += 1
                    break
                entry[1] = False
                self._rows[old] = entry  # a second chance, behind the others
        self._rows[key] = [rows, False]

    def invalidate(self) -> None:
        self._rows.clear()

    def search(self, table: DataFrame, query, k: int, *, where=None, metric: str = "cosine", generation: int = 0, **more) -> list:
        """Rows of :func:`search.search`, from the cache if they are there."""
        key = self.key(query, k, where, metric, generation)
        rows = self.get(key)
        if rows is None:
            rows = search.search(table, query, k, where=where, metric=metric, **more).collect()
            self.put(key, rows)
        return rows


class MemoTable:
    """Values computed once for each text, such as embeddings or answers, kept in a collection with columns ``text, value``."""

    def __init__(self, collection):
        self.collection = collection

    def compute(self, texts: DataFrame, make: Callable[[DataFrame], DataFrame], admit=None) -> DataFrame:
        """``text, value, hit`` for every different text: known values are joined, ``make`` (``text`` -> ``text, value``) gets the others and what
        ``admit`` (a boolean Column over ``text, value``) lets in is added to the table."""
        asked = texts.select("text").where("text is not null").distinct()
        if not self.collection.generation:
            fresh = make(asked)
            self.collection.upsert(fresh if admit is None else fresh.where(admit))
            return fresh.withColumn("hit", F.lit(False))
        known = route.memo_split(asked, self.collection.read())
        fresh = make(known.where("not hit").select("text"))
        gen = self.collection.generation
        self.collection.upsert(fresh if admit is None else fresh.where(admit))
        before = route.memo_split(asked, self.collection.read(gen)).where("hit")
        return before.select("text", "value", "hit").unionByName(fresh.select("text", "value").withColumn("hit", F.lit(False)))
