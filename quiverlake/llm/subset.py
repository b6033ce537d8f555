"""Choosing a varied subset: greedy determinantal selection over composable core-sets.

The kernel of two hits is the product of their qualities and their cosine; the greedy maximisation
of its determinant keeps, by incremental Cholesky updates, for every hit the part of it that the
chosen ones do not explain. Groups larger than ``part_rows`` are cut into parts; each part yields a
core-set, united core-sets are cut again while they are too large, and the last pass selects from
what is left. An exact last step may follow, which shows each theme once, by its best hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.runtime import latest_version, materialise, sorted_groups
from .arrays import from_binary, to_binary, unit, usable
from .clusters import link_cell

RIDGE = 0.01  # share of the kernel on its diagonal alone, so that more hits than dimensions can be chosen
QUALITY = 1.7  # of the best-scored hit; the worst has 1, so that a hit unlike the chosen ones outweighs a better score


def greedy_map(quality: np.ndarray, u: np.ndarray) -> Iterator[int]:
    """Rows in the order in which they greedily maximise the determinant of the kernel of the chosen ones.

    L = q q' ((1 - ridge) cosine + ridge [same row]). Ties take the first row, so callers order rows
    by preference.
    """
    n = len(quality)
    rest = quality**2
    basis = np.empty((min(16, n), n))
    for t in range(n):
        j = int(rest.argmax())
        yield j
        if t == len(basis):
            basis = np.vstack([basis, np.empty((min(t, n - t), n))])
        row = quality[j] * quality * (1 - RIDGE) * np.clip(u @ u[j], -1, 1)
        row[j] = quality[j] ** 2
        e = (row - basis[:t].T @ basis[:t, j]) / np.sqrt(max(rest[j], 1e-12))
        basis[t] = e
        rest = rest - e**2
        rest[j] = -np.inf


def select(ids: np.ndarray, u: np.ndarray, score: np.ndarray, k: int, theme: np.ndarray | None = None) -> np.ndarray:
    """The first ``k`` rows of the greedy choice; with ``theme`` as many more as it takes to meet ``k`` themes, or all.

    Qualities fall from ``QUALITY`` to 1 by score: missing scores last, ties by the smaller id.
    """
    order = np.lexsort((ids, -np.where(np.isnan(score), -np.inf, score)))
    n = len(order)
    quality = QUALITY - (QUALITY - 1) * np.arange(n) / max(1, n - 1)
    own = None if theme is None else theme[order]
    most = 0 if own is None else len(np.unique(own))
    out, met = [], set()
    for j in greedy_map(quality, u[order]):
        if len(out) >= k and (own is None or len(met) >= min(k, most)):
            break
        out.append(j)
        if own is not None:
            met.add(own[j])
    return order[out]


def leads(ids: np.ndarray, score: np.ndarray, theme: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The exact last step: for the first ``k`` themes met by the choice ``at``, in that order, the best-scored row of each."""
    order = np.lexsort((ids, -np.where(np.isnan(score), -np.inf, score)))
    first: dict = {}
    for i in order:
        first.setdefault(theme[i], i)
    return np.array([first[t] for t in list(dict.fromkeys(theme[at].tolist()))[:k]], np.int64)


def hit_themes(rows: DataFrame, *, dim: int, alike: float) -> DataFrame:
    """``qid, id, theme, best_id`` of the hits of queries in several parts; ``best_id`` is the theme's best-scored hit.

    ``rows``: ``qid, id, score, vec, parts``, read several times. Every pair of parts of a query is a cell in which
    links are exact, and components that share hits are merged: no link is lost, at a cost that
    grows with the square of the query's hits.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    paired = rows.select("qid", "id", "vec", part.alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b")).where("a <> b")
    cells = paired.select(F.concat_ws("\x1f", "qid", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string")).alias("cell"), "qid", "id", "vec")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, "cell"):
            g = g.combine_chunks()
            ids = g.column("id").to_numpy(zero_copy_only=False)
            labels = link_cell(unit(from_binary(g.column("vec"), dim)), alike, np.random.default_rng(1))
            order = np.lexsort((ids, labels))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(labels[order]) != 0]))
            names = np.repeat(ids[order[cuts]], np.diff(np.concatenate([cuts, [len(order)]])))
            yield pa.RecordBatch.from_arrays([g.column("qid").combine_chunks().take(pa.array(order)), pa.array(ids[order], pa.string()), pa.array(names, pa.string())], ["qid", "id", "comp"])

    linked = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "qid string, id string, comp string")
    comp = F.concat_ws("\x1f", "qid", "comp")
    member = materialise(linked.groupBy("qid", "id").agg(F.min(comp).alias("comp"), F.collect_set(comp).alias("comps")), "hits")
    roots = connected_components(member.where(F.size("comps") > 1).select(F.col("comp").alias("a"), F.explode("comps").alias("b")))
    themed = member.join(roots, member.comp == roots.node, "left").select("qid", "id", F.coalesce("root", "comp").alias("theme"))
    s = F.col("score")
    place = F.struct(F.coalesce(-F.when(~F.isnan(s), s), F.lit(float("inf"))).alias("s"), "id")
    first = themed.join(rows.select("qid", "id", "score"), ["qid", "id"]).groupBy("qid", "theme").agg(F.min(place)["id"].alias("best_id"))
    # a theme may be most of a query's hits
    spread = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return themed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(spread, ["qid", "theme", "salt"]).select("qid", "id", "theme", "best_id")


def varied_subset(hits: DataFrame, sizes: DataFrame, *, dim: int = 64, alike: float = 0.84, part_rows: int = 4096, one_per_theme: bool = False) -> DataFrame:
    """``qid, id, place``: at most ``subset_size`` hits of each query, in order of choice.

    ``hits``: ``qid, id, score, vec`` (float32 bytes), one row per (qid, id), read several times (pass a written table);
    ``sizes``: ``qid, subset_size``. The choice is the greedy determinantal one. With ``one_per_theme`` it goes on
    until it has met ``subset_size`` themes (hits alike, with a cosine of at least ``alike``, directly or
    through others of the query), and each theme it met is shown once, by its best-scored hit. A null or
    NaN score comes last. Queries without a positive size give nothing; hits without a vector cannot
    be chosen. A query with more than ``part_rows`` hits is selected from the core-sets of its parts, level by level,
    so no task holds an unbounded group; its themes are those of all its hits.
    """
    wanted = sizes.where("qid is not null and subset_size > 0").groupBy("qid").agg(F.max("subset_size").cast("int").alias("k"))
    counted = hits.groupBy("qid").agg(F.count("*").alias("n")).join(wanted, "qid")
    top = counted.agg(F.max("n").alias("n"), F.max("k").alias("k")).first()
    # a query's hits may be most of the rows, so the join on the query is salted
    salts = max(16, -(-(top.n or 0) // 1_000_000))
    salted = counted.select("qid", "k", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = hits.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["qid", "salt"]).select("qid", "id", F.col("score").cast("double").alias("score"), "vec", "k", "parts")
    columns = ["qid", "id", "score", "vec", "k", "parts", "theme", "best_id"]
    schema = "qid string, id string, score double, vec binary, k int, parts int, theme string, best_id string, place int"

    def run(final: bool):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, size = [], 0
            for g in sorted_groups(batches, "part"):
                g = g.combine_chunks()
                k, ids = g.column("k")[0].as_py(), g.column("id").to_numpy(zero_copy_only=False)
                score, u = g.column("score").to_numpy(zero_copy_only=False).astype(float), unit(from_binary(g.column("vec"), dim))
                known, theme = g.column("theme").null_count == 0, None
                if one_per_theme:
                    theme = g.column("theme").to_numpy(zero_copy_only=False).astype(str) if known else link_cell(u, alike, np.random.default_rng(1)).astype(str)
                at = select(ids, u, score, k, theme)
                if one_per_theme and final:
                    at = at[np.sort(np.unique(theme[at], return_index=True)[1])[:k]] if known else leads(ids, score, theme, at, k)
                t = g.select(columns).take(pa.array(at))
                if one_per_theme and final and known:  # the best hit may lie in no core-set; its id goes with the theme
                    t = t.set_column(columns.index("id"), "id", t.column("best_id"))
                kept.append(t.append_column("place", pa.array(np.arange(1, t.num_rows + 1, dtype=np.int32))))
                size += t.num_rows
                if size > 4096:
                    yield from pa.concat_tables(kept).combine_chunks().to_batches()
                    kept, size = [], 0
            if kept:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()

        return go

    def chosen(df: DataFrame, final: bool) -> DataFrame:
        part = F.concat_ws("\x1f", "qid", F.pmod(F.xxhash64("id"), F.col("parts")).cast("string")).alias("part")
        return df.select(*columns, part).repartition("part").sortWithinPartitions("part").mapInArrow(run(final), schema)

    out = ["qid", "id", "place"]
    bare = [F.lit(None).cast("string").alias("theme"), F.lit(None).cast("string").alias("best_id")]
    small = chosen(rows.where("parts = 1").select("*", *bare), True).select(out)
    if (top.n or 0) <= part_rows:
        return small
    large = materialise(rows.where("parts > 1"), "large")
    core = materialise(large.join(hit_themes(large, dim=dim, alike=alike), ["qid", "id"]) if one_per_theme else large.select("*", *bare), "themed")
    n = top.n
    while n > part_rows:
        core = materialise(chosen(core, False).drop("place"), "core")
        # a core-set may go beyond k where the greedy choice needs more to meet k themes
        sizes_now = core.groupBy("qid").agg(F.count("*").alias("n"))
        now = sizes_now.agg(F.max("n")).first()[0]
        parts = 1 if now <= part_rows or now >= n else -(-now // part_rows)
        core = core.withColumn("parts", F.lit(int(parts)))
        n = now if parts > 1 else 0
    return small.union(chosen(core, True).select(out))


def hits_with_embeddings(hits: DataFrame, docs: DataFrame, *, dim: int = 64, order: tuple[str, ...] = ("received_at", "batch_no")) -> DataFrame:
    """``qid, id, score, vec binary``, one row per (qid, id): a hit's own vector or, where it is null, that of the live record.

    Of repeated hits the best score counts and any usable vector (they repeat it). Hits that have
    no usable vector from either side are left out.
    """
    pair = F.struct("qid", "id")
    s = F.col("score")
    slim = hits.where("qid is not null and id is not null").select("qid", "id", pair.alias("pair"), F.when(~F.isnan(s), s).alias("score"), F.col("vector").cast("array<float>").alias("vec"))
    one = latest_version(slim.withColumn("has", F.col("vec").isNotNull()), "pair", ["has", "score"]).drop("pair")
    bare = one.where("not has").select("id").distinct()
    live = latest_version(docs.select("id", F.col("precomputed_vector").cast("array<float>").alias("doc_vec"), *order).join(bare, "id", "left_semi"), "id", list(order))
    filled = one.where("has").select("qid", "id", "score", "vec").unionByName(one.where("not has").join(live, "id").select("qid", "id", "score", F.col("doc_vec").alias("vec")))

    def pack(batches):
        for b in batches:
            at, x = usable(b.column("vec"), dim)
            if len(at):
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(at), b.column("id").take(at), b.column("score").take(at), to_binary(x)], ["qid", "id", "score", "vec"])

    return filled.mapInArrow(pack, "qid string, id string, score double, vec binary")
