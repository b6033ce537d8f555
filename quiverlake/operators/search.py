"""Top-k similarity search over DataFrames.

Single queries stay in the JVM: the score is a codegen'd expression, the filter is pushed into
the scan and the heap is TakeOrderedAndProject. Batches of queries are scored in Arrow batches
with one matrix product per block and keep k rows per query and task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute in the tasks)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vecmath as V
from . import filters
from .runtime import materialise

QUERIES_PER_PASS = 4096


def rank_by(df: DataFrame, group: list[str], score: str, tie: str, k: int, rank_col: str = "rank") -> DataFrame:
    """The k best rows of every group, ties by the smaller ``tie``; limited per task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows, ties by the smaller ``tie``; k <= 0 gives none. NaN scores are rejected by being left out."""
    return df.where(~F.isnan(score)).orderBy(F.col(score).desc(), F.col(tie).asc()).limit(max(0, k))


def search(table: DataFrame, query, k: int, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", where=None, metadata: str | None = None, min_score: float | None = None, raw: bool = False, exclude_id=None, with_columns: tuple[str, ...] = (), expansion: float | None = None) -> DataFrame:
    """Exact filtered kNN: ``id, score`` and the asked columns, best first.

    The filter comes before the scores, so k matches are found if there are k. With ``expansion`` the
    compatible behaviour is planned instead: the best ``ceil(k * expansion)`` rows are taken
    first and filtered afterwards, so fewer than k may remain. ``raw`` gives the score scale of
    clustered indexes. Rows without a vector of the query's length have no score and are left out.
    """
    q = V.literal(query)
    keep = filters.to_where(where, filters.MapFields(metadata) if metadata else filters.FlatFields(table.schema))
    score = (V.raw_score if raw else V.score)(F.col(vec_col), q, metric)
    rows = table if exclude_id is None else table.where(F.col(id_col) != F.lit(exclude_id))
    rows = rows.where(F.size(vec_col) == len(query))
    first = rows if expansion is not None else rows.where(keep)
    scored = first.withColumn("score", score).where("score is not null and not isnan(score)")
    if expansion is not None:
        scored = scored.orderBy(F.desc("score"), F.asc(id_col)).limit(int(np.ceil(k * expansion))).where(keep)
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.select(id_col, "score", *with_columns).orderBy(F.desc("score"), F.asc(id_col)).limit(max(0, k))


def search_batch(corpus: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", query_id: str = "qid", query_vec: str = "qvec", exclude_self: bool = False, min_score: float | None = None, queries_per_pass: int = QUERIES_PER_PASS) -> DataFrame:
    """Exact kNN of many queries: ``qid, id, score, rank``.

    The queries are taken in passes of ``queries_per_pass``, the only thing sent to every task, so
    what is broadcast is bounded; each pass scans the corpus once. More than one pass are written one after
    another, and the queries of one are released before the next. A task keeps its k best rows
    of a query, and a window over those takes the k best of all. Rows and queries without a usable
    vector are left out; ties go to the smaller id; a repeated query id is answered once.
    """
    rows = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).where("q is not null and v is not null").dropDuplicates(["q"]).orderBy("q")
    q_type, id_type = rows.schema["q"].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()
    source = corpus.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    schema = f"qid {q_type}, id {id_type}, score double"
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    spread = source.repartition(cores) if source.rdd.getNumPartitions() < cores else source  # a small file is one split

    def one(batch):
        dim = len(batch[0][1])
        names = [q for q, v in batch]
        m = np.array([v for _, v in batch], np.float64)
        sent = corpus.sparkSession.sparkContext.broadcast((names, m))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = sent.value
            qn, own = np.einsum("ij,ij->i", m, m), np.array(names, object)
            rows, ids, best = np.empty(0, np.int64), None, np.empty(0)
            bound = np.full(len(names), -np.inf)  # a query's k-th best so far
            for b in batches:
                col = b.column("vec")
                fit = np.flatnonzero(pa.compute.fill_null(pa.compute.list_value_length(col), -1).to_numpy(zero_copy_only=False) == dim)
                if not len(fit):
                    continue
                pid_all = b.column("id").take(pa.array(fit)).to_numpy(zero_copy_only=False)
                x = col.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), dim).astype(np.float64)
                ids = pid_all[:0] if ids is None else ids
                for at in range(0, len(x), 2048):
                    pid = pid_all[at : at + 2048]
                    s = _scores(m, qn, x[at : at + 2048], metric)
                    s[np.isnan(s)] = -np.inf
                    if exclude_self:
                        s[own[:, None] == pid[None, :]] = -np.inf
                    if min_score is not None:
                        s[s < min_score] = -np.inf
                    r, c = top_entries(s, k, bound)
                    rows, ids, best = _keep_best(np.concatenate([rows, r]), np.concatenate([ids, pid[c]]), np.concatenate([best, s[r, c]]), k)
                    full = np.bincount(rows, minlength=len(names)) == k
                    low = np.full(len(names), np.inf)
                    np.minimum.at(low, rows, best)
                    bound[full] = low[full]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in rows]), pa.array(ids.tolist()), pa.array(best)], ["qid", "id", "score"]).cast(_target)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        _target = to_arrow_schema(_parse_datatype_string(schema))
        return spread.mapInArrow(score, schema), sent

    few = rows.limit(queries_per_pass + 1).toArrow().combine_chunks()
    if few.num_rows and few.num_rows <= queries_per_pass and len(set(pa.compute.list_value_length(few.column("v")).to_pylist())) == 1:
        m = few.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, -1)
        return rank_by(one(list(zip(few.column("q").to_pylist(), m)))[0], ["qid"], "score", "id", k)
    done, batch = [], []

    def write():
        found, sent = one(batch)
        done.append(materialise(found, "pass"))
        sent.destroy()

    for r in rows.toLocalIterator():
        if batch and (len(batch) == queries_per_pass or len(r.v) != len(batch[0][1])):
            write()
            batch = []
        batch.append((r.q, r.v))
    if batch:
        write()
    if not done:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    found = done[0]
    for p in done[1:]:
        found = found.unionByName(p)
    return rank_by(found, ["qid"], "score", "id", k)


def top_entries(s: np.ndarray, k: int, floor: np.ndarray, size: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries that can be among the ``k`` largest of their row and reach the row's ``floor``.

    The k-th largest of the maxima of groups of columns is a lower bound of the k-th entry. A group is every ``n``-th column,
    so that maxima are taken along whole rows of memory, and only groups that reach the bound are looked at again.
    """
    n, w = s.shape
    groups = w // size
    if groups <= k:
        return np.nonzero((s >= floor[:, None]) & (s > -np.inf))
    whole = groups * size
    tops = s[:, :whole].reshape(n, size, groups).max(axis=1)
    some = np.flatnonzero(tops.max(axis=1) >= floor)
    tops = tops[some]
    bound = np.maximum(floor[some], np.partition(tops, groups - k, axis=1)[:, groups - k])
    r, g = np.nonzero(tops >= bound[:, None])
    rows, columns = some[r], g[:, None] + np.arange(size) * groups
    v = s[rows[:, None], columns]
    p, q = np.nonzero((v >= bound[r][:, None]) & (v > -np.inf))
    rows, columns = rows[p], columns[p, q]
    if whole < w:
        i, j = np.nonzero((s[:, whole:] >= floor[:, None]) & (s[:, whole:] > -np.inf))
        rows, columns = np.concatenate([rows, i]), np.concatenate([columns, j + whole])
    return rows, columns


def _keep_best(rows, ids, scores, k):
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], scores[keep]


def _scores(m, qn, x, metric):
    d = m @ x.T
    if metric == "dot":
        return (1 + d) / 2
    if metric == "mip":
        return np.where(d >= 0, d + 1, 1 / (1 - np.minimum(d, 0)))
    xn = np.einsum("ij,ij->i", x, x)
    if metric == "l2":
        return 1 / (1 + np.maximum(qn[:, None] + xn[None, :] - 2 * d, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (1 + d / np.sqrt(qn[:, None] * xn[None, :])) / 2


def rescore(candidates: DataFrame, table: DataFrame, query, k: int, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Exact scores of the candidate ids alone."""
    return search(table.join(candidates.select(id_col).distinct(), id_col, "left_semi"), query, k, metric=metric, id_col=id_col, vec_col=vec_col)


def refine(table: DataFrame, query, k: int, coarse_score: Column, *, factor: float = 4.0, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Two passes: the best ``max(k, ceil(k factor))`` by a cheap score, then exact."""
    n = max(k, int(np.ceil(k * factor)))
    coarse = table.withColumn("coarse", coarse_score).orderBy(F.desc("coarse"), F.asc(id_col)).limit(n)
    return search(coarse, query, k, metric=metric, id_col=id_col, vec_col=vec_col)


def merge_shards(shards: list[DataFrame] | DataFrame, k: int, *, id_col: str = "id", dedup: bool = True) -> DataFrame:
    """Merge shard results: an id that several shards return keeps its best score, then the k best."""
    if isinstance(shards, list):
        out = shards[0]
        for s in shards[1:]:
            out = out.unionByName(s)
    else:
        out = shards
    if dedup:
        out = out.groupBy(id_col).agg(F.max("score").alias("score"))
    return out.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def sharded(table: DataFrame, query, k: int, shard: Column, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", dedup: bool = True) -> DataFrame:
    """Per-shard top k, then :func:`merge_shards`."""
    scored = table.select(id_col, shard.alias("shard"), V.score(F.col(vec_col), V.literal(query), metric).alias("score"))
    return merge_shards(rank_by(scored, ["shard"], "score", id_col, k).select(id_col, "score"), k, id_col=id_col, dedup=dedup)


def with_staged(committed: DataFrame, staged: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Read-your-writes view: staged rows stand in for committed ones of the same id."""
    return committed.join(staged.select(id_col).distinct(), id_col, "left_anti").unionByName(staged)


def more_like(table: DataFrame, row_id, k: int, *, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", **more) -> DataFrame:
    """Neighbours of a stored row, without itself; an unknown id gives nothing."""
    found = table.where(F.col(id_col) == F.lit(row_id)).select(vec_col).limit(1).collect()
    if not found or found[0][0] is None:
        return table.select(id_col).withColumn("score", F.lit(0.0)).limit(0)
    return search(table, found[0][0], k, metric=metric, id_col=id_col, vec_col=vec_col, exclude_id=row_id, **more)


def recall_at(found: DataFrame, truth: DataFrame, k: int, *, query_id: str = "qid", id_col: str = "id") -> DataFrame:
    """Recall@k of each query against ground truth: matched ids over the number of true ones (at most k)."""
    t = truth.where(F.col("rank") <= k).select(query_id, id_col)
    hit = found.where(F.col("rank") <= k).select(query_id, id_col).distinct().withColumn("hit", F.lit(1))
    return t.join(hit, [query_id, id_col], "left").groupBy(query_id).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))
