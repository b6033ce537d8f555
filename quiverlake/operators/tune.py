"""Parameter search and small planners: axes, samplers, objective, threshold sweeps, memory estimates, projections."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vecmath as V


# -- axes and samplers ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Choice:
    name: str
    values: tuple

    def grid(self):
        return list(self.values)

    def draw(self, rng):
        return rng.choice(self.values)


@dataclass(frozen=True)
class IntRange:
    name: str
    low: int
    high: int
    step: int = 1
    log: bool = False

    def grid(self):
        if not self.log:
            return list(range(self.low, self.high + 1, self.step))
        n = self.high - self.low + 1
        return [round(math.exp(math.log(self.low) + (math.log(self.high) - math.log(self.low)) * (i / (n - 1) if n > 1 else 0))) for i in range(n)]

    def draw(self, rng):
        return round(math.exp(rng.uniform(math.log(self.low), math.log(self.high)))) if self.log else rng.randrange(self.low, self.high + 1, self.step)


@dataclass(frozen=True)
class FloatRange:
    name: str
    low: float
    high: float
    log: bool = False

    def grid(self):
        raise ValueError(f"{self.name} is continuous and has no grid")

    def draw(self, rng):
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)


def fixed(name: str, value) -> Choice:
    return Choice(name, (value,))


def grid(axes: list) -> list[dict]:
    """All combinations; the first axis varies fastest."""
    out = [{}]
    for a in reversed(axes):
        out = [{a.name: v, **rest} for rest in out for v in a.grid()]
    return out


def grid_frame(spark: SparkSession, axes: list[Choice]) -> DataFrame:
    """The grid as a table, numbered from 0 with the first axis fastest."""
    sizes = [len(a.grid()) for a in axes]
    df = spark.range(math.prod(sizes)).withColumnRenamed("id", "trial")
    stride = 1
    for a, n in zip(axes, sizes):
        df = df.withColumn(a.name, F.element_at(F.array(*[F.lit(v) for v in a.grid()]), ((F.floor(F.col("trial") / stride) % n) + 1).cast("int")))
        stride *= n
    return df


def random_trials(axes: list, n: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{a.name: a.draw(rng) for a in axes} for _ in range(n)]


@dataclass
class TreeParzen:
    """Sequential sampler: after ``startup`` random trials, of ``candidates`` draws the one whose ratio of densities
    among the best ``gamma`` of the trials and the rest is largest."""

    axes: list
    # fixed values: the usual defaults of such samplers, which results must share
    startup: int = 10
    candidates: int = 24
    gamma: float = 0.25
    prior: float = 1.0
    seed: int = 42
    rng: random.Random = field(init=False)

    def __post_init__(self):
        self.rng = random.Random(self.seed)

    def next(self, history: list[tuple[dict, float]]) -> dict:
        if len(history) < self.startup:
            return {a.name: a.draw(self.rng) for a in self.axes}
        ordered = [p for p, _ in sorted(history, key=lambda h: -h[1])]
        cut = min(max(1, math.floor(self.gamma * len(ordered) + 0.5)), len(ordered) - 1)
        return {a.name: self._axis(a, [p[a.name] for p in ordered[:cut]], [p[a.name] for p in ordered[cut:]]) for a in self.axes}

    def _axis(self, a, good, bad):
        def density(v, seen):
            if isinstance(a, Choice):
                return (seen.count(v) + self.prior) / (len(seen) + self.prior * len(a.values))
            low, high, x = (math.log(a.low), math.log(a.high), math.log(v)) if a.log else (a.low, a.high, v)
            width = max((high - low) / max(1, math.sqrt(len(seen) + 1)), 1e-12)
            points = [math.log(s) if a.log else s for s in seen]
            kernel = sum(math.exp(-0.5 * ((x - p) / width) ** 2) for p in points) / width
            return (kernel + self.prior / max(high - low, 1e-12)) / (len(seen) + self.prior)

        def draw():
            if isinstance(a, Choice) or self.rng.random() < self.prior / (len(good) + self.prior):
                return a.draw(self.rng) if not isinstance(a, Choice) else self.rng.choices(a.values, [density(v, good) for v in a.values])[0]
            low, high = (math.log(a.low), math.log(a.high)) if a.log else (a.low, a.high)
            p, width = self.rng.choice(good), max((high - low) / math.sqrt(len(good) + 1), 1e-12)
            for _ in range(64):  # drawn again outside the bounds, so that no mass gathers on them
                x = self.rng.gauss(math.log(p) if a.log else p, width)
                if low <= x <= high:
                    break
            else:
                x = self.rng.uniform(low, high)
            x = math.exp(x) if a.log else x
            return round(x) if isinstance(a, IntRange) else x

        return max((draw() for _ in range(self.candidates)), key=lambda v: density(v, good) / max(density(v, bad), 1e-12))


# -- objective and studies ------------------------------------------------------------------------------

def objective(metrics: dict[str, tuple[Column, float]], costs: dict[str, tuple[Column, float, float]]) -> Column:
    """Sum of weight x metric minus sum of weight x clip01(cost / reference)."""
    out = F.lit(0.0)
    for c, w in metrics.values():
        out = out + c * w
    for c, w, ref in costs.values():
        out = out - F.least(F.greatest(c / ref, F.lit(0.0)), F.lit(1.0)) * w
    return out


def run_study(trials: Callable[[list], dict] | list[dict], measure: Callable[[dict], float], n: int | None = None, listener: Callable[[dict], None] | None = None) -> list[tuple[dict, float]]:
    """Measure trials one after another; each is a distributed job of its own. ``trials`` is a list or a sampler's ``next``.

    ``listener`` is told of each trial: ``{"event": "started"|"finished"|"failed", "trial": i, "params": ..., "value": ...}``.
    """
    tell = listener or (lambda e: None)
    history: list[tuple[dict, float]] = []
    for i in range(n if n is not None else len(trials)):
        p = trials(history) if callable(trials) else trials[i]
        tell({"event": "started", "trial": i, "params": p})
        try:
            value = float(measure(p))
        except Exception as e:
            tell({"event": "failed", "trial": i, "params": p, "error": repr(e)})
            raise
        history.append((p, value))
        tell({"event": "finished", "trial": i, "params": p, "value": value})
    return history


def index_trial(build: Callable[[dict], object], search: Callable[[object, dict], DataFrame], truth: DataFrame, params: dict, *, k: int = 10, warm: int = 1, rounds: int = 3, weights: dict | None = None, bytes_of: float = 0.0, references: dict | None = None) -> dict:
    """Build an index, search it ``warm`` times for nothing and ``rounds`` times on the clock, and score it.

    ``search`` gives ``qid, id, rank`` of all queries in one job, so the latency is that of a batch; the objective is the recall
    times its weight, less the weighted build seconds, 95th percentile of the batch seconds and bytes, each over its reference.
    """
    from .search import recall_at

    began = time.perf_counter()
    index = build(params)
    built = time.perf_counter() - began
    for _ in range(warm):
        search(index, params).count()
    took = []
    for _ in range(rounds):
        began = time.perf_counter()
        rows = search(index, params).collect()
        took.append(time.perf_counter() - began)
    spark = truth.sparkSession
    found = spark.createDataFrame([(r.qid, r.id, r.rank) for r in rows], f"qid {truth.schema['qid'].dataType.simpleString()}, id {truth.schema['id'].dataType.simpleString()}, rank int")
    recall = recall_at(found, truth, k).agg(F.avg("recall")).first()[0] or 0.0
    took.sort()
    at = lambda q: took[min(len(took) - 1, max(0, math.ceil(q * len(took)) - 1))]
    w, ref = {"recall": 1.0, "build": 0.0, "latency": 0.0, "memory": 0.0} | (weights or {}), {"build": 60.0, "latency": 1.0, "memory": 1e9} | (references or {})
    clip = lambda x: min(max(x, 0.0), 1.0)
    value = w["recall"] * recall - w["build"] * clip(built / ref["build"]) - w["latency"] * clip(at(0.95) / ref["latency"]) - w["memory"] * clip(bytes_of / ref["memory"])
    return {"params": params, "recall": recall, "build_s": built, "p50_s": at(0.5), "p95_s": at(0.95), "p99_s": at(0.99), "bytes": bytes_of, "objective": value}


def apply_trial(build: Callable[[dict], object], history: list[tuple[dict, float]]):
    """The index of the best trial so far, built anew with its parameters."""
    if not history:
        raise ValueError("no trial to apply")
    return build(max(history, key=lambda h: h[1])[0])


def save_trials(history: list[tuple[dict, float]], path: str, spark: SparkSession | None = None) -> None:
    """Add trials to a study: to a local file, or with ``spark`` to a folder on any file system."""
    lines = [json.dumps({"params": p, "value": v}) for p, v in history]
    if spark is not None:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)
        return
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in lines)


def load_trials(path: str, spark: SparkSession | None = None) -> list[tuple[dict, float]]:
    if spark is not None:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    return [((d := json.loads(x))["params"], d["value"]) for x in lines if x.strip()]


def threshold_sweep(scored: DataFrame, thresholds: list[float], *, value: str = "distance", expected: str = "expected", predicted: str = "predicted", lower_is_better: bool = True) -> DataFrame:
    """``threshold, accuracy``: below (or above) the threshold the prediction stands, otherwise it is none (null)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    x = scored.select(t, value, expected, predicted)  # a few thresholds per row, aggregated on the map side
    ok = F.col(value) <= F.col("threshold") if lower_is_better else F.col(value) >= F.col("threshold")
    return x.groupBy("threshold").agg(F.avg(F.when(ok, F.col(predicted)).eqNullSafe(F.col(expected)).cast("double")).alias("accuracy"))


METRIC_NAMES = {"l2": "EUCLIDEAN", "dot": "DOT_PRODUCT", "cosine": "COSINE", "mip": "MAXIMUM_INNER_PRODUCT"}  # fixed values: the length of the name is stored


def code_bytes(quantizer: str, n: Column, dim: Column) -> Column:
    """Bytes of all codes and of the quantizer's own state, for its default parameters: rows times bytes a row, plus the state."""
    words = F.ceil(dim / 64)
    padded, m8, m4 = words * 64, F.greatest(F.floor(dim / 8), F.lit(1)), F.greatest(F.floor(dim / 4), F.lit(1))
    row, state = {
        "none": (F.lit(0), F.lit(0)),
        "fp16": (dim * 2, F.lit(0)),
        "sq8": (dim + 4, F.lit(24)),
        "sq4": (F.ceil(dim / 2) + 4, F.lit(24)),
        "pq": (m8, m8 * 8 + dim * 256 * 4 + dim * 4 + 12),  # 256 centroids and the mean
        "bq": (words * 8 + 3 * 4, dim * 4),
        "rabitq": (words * 8 + 5 * 4, dim * 4 + padded * 8),
        "extended_rabitq": (words * 8 + F.ceil(padded * 4 / 8) + 6 * 4, dim * 4 + padded * 4),
        "nvq": (dim + m4 * 4 * 4, dim * 4 + m4 * 4),
        "turboquant": (padded + 4 + words * 8 + 4, dim * 4 + padded * padded * 8),
    }[quantizer]
    return n * row + state


def routing_bytes(kind: str, n: Column, dim: Column, *, m: int | None = None, lists: int = 16, metric: str = "cosine") -> Column:
    """Bytes of links or lists; none of an empty index."""
    if kind == "flat":
        return F.lit(0)
    if kind == "hnsw":
        m = m or 16
        upper = F.greatest(F.ceil(n / max(1, m - 1)), F.lit(1))  # expected nodes above the lowest layer
        out = 32 + n * 4 + n * (4 + 8 * m) + upper * (8 + 4 * m)
    elif kind == "vamana":
        out = 28 + n * (4 + 4 * (m or 64))
    else:
        k = F.least(F.lit(lists), n)
        centroids = 10 + len(METRIC_NAMES[metric]) + k * (dim * 4 + 12)  # with spill target, size and radius of each
        out = 9 + centroids + k * 8 + n * 4
        if kind == "ivf_pq":
            m8 = F.greatest(F.floor(dim / 8), F.lit(1))
            out = out + 21 + m8 * 8 + dim * 256 * 4 + n * m8
    return F.when(n > 0, out).otherwise(0)


def index_bytes(kind: str, n: Column, dim: Column, *, m: int | None = None, quantizer: str = "none", lists: int = 16, metric: str = "cosine") -> Column:
    """Estimated memory of an index of ``kind`` (flat, hnsw, vamana, ivf, ivf_pq): its rows, their codes and its routing. Clustered kinds take no quantizer."""
    codes = F.lit(0) if quantizer == "none" or kind.startswith("ivf") else F.when(n > 0, code_bytes(quantizer, n, dim)).otherwise(0)
    return (n * dim * 4 + codes + routing_bytes(kind, n, dim, m=m, lists=lists, metric=metric)).cast("bigint")


# -- projections ------------------------------------------------------------------------------------

def sphereize(vec: Column) -> Column:
    return V.normalize(vec)


def pca_projection(df: DataFrame, dims: int = 2, *, vec_col: str = "vector") -> DataFrame:
    """Adds ``projected``: the rows on the first principal components (distributed covariance, spark.ml)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("__f", array_to_vector(F.col(vec_col).cast("array<double>")))
    return PCA(k=dims, inputCol="__f", outputCol="__p").fit(x).transform(x).withColumn("projected", vector_to_array("__p")).drop("__f", "__p")


def recommend_projection(n: Column, dim: Column, sparsity: Column) -> Column:
    """Which projection suits a dataset: PCA where dimensions outweigh rows, for sparse or large data; t-SNE under 5,000 rows; UMAP up to 100,000."""
    # fixed values: where one projection gives way to the next
    return F.when((dim > 4 * n) | (sparsity > 0.8), "pca").when(n < 5_000, "tsne").when(n <= 100_000, "umap").otherwise("pca")
