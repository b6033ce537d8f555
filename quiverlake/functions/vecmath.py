"""Vector expressions: Column builders that stay inside the JVM, in double precision.

A null vector gives null. Embeddings of different lengths give null (``zip_with`` pads with null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2", "mip")


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column, offset: int = 0, length: int | None = None) -> Column:
    """Dot product; ``offset``/``length`` take a slice of both."""
    if offset or length is not None:
        n = F.lit(length) if length is not None else F.size(a) - offset
        a, b = F.slice(a, F.lit(offset + 1), n), F.slice(b, F.lit(offset + 1), n)
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def square_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """NaN where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(float("nan"))).otherwise(dot(a, b) / n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of packed longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def add_scaled(a: Column, b: Column, factor: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double") * F.lit(float(factor)))


def scale(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.lit(float(factor)))


def total(a: Column) -> Column:
    return _sum(F.transform(a, lambda x: x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def score(a: Column, b: Column, metric: str) -> Column:
    """Similarity, higher is better: 1/(1+d2), (1+dot)/2, (1+cos)/2, or dot+1 / 1/(1-dot) for inner products."""
    if metric == "l2":
        return F.lit(1.0) / (F.lit(1.0) + square_distance(a, b))
    if metric == "dot":
        return (F.lit(1.0) + dot(a, b)) / 2
    if metric == "cosine":
        return (F.lit(1.0) + cosine(a, b)) / 2
    if metric == "mip":
        d = dot(a, b)
        return F.when(d >= 0, d + 1).otherwise(F.lit(1.0) / (F.lit(1.0) - d))
    raise ValueError(f"unknown metric {metric}")


def raw_score(a: Column, b: Column, metric: str) -> Column:
    """The scale of clustered indexes: -d2, the dot product or the cosine itself."""
    return {"l2": lambda: -square_distance(a, b), "dot": lambda: dot(a, b), "mip": lambda: dot(a, b), "cosine": lambda: cosine(a, b)}[metric]()


def byte_dot_score(a: Column, b: Column) -> Column:
    """Dot similarity of int8 embeddings: 0.5 + dot / (2 n 127^2)."""
    return F.lit(0.5) + dot(a, b) / (F.lit(2.0) * F.size(a) * 127 * 127)


def int8_max_abs(a: Column) -> Column:
    """Quantise to -127..127 by the largest magnitude; a zero vector gives zeros."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.transform(a, lambda x: F.when(top == 0, F.lit(0)).otherwise(F.floor(x.cast("double") * 127 / top + 0.5)).cast("int"))


def sign_bits(a: Column, dim: int) -> Column:
    """Sign bits (v >= 0 is 1) packed into longs, lowest bit first."""
    words = []
    for w in range(0, dim, 64):
        part = F.slice(a, w + 1, min(64, dim - w))
        words.append(F.aggregate(F.transform(part, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v)))
    return F.array(*words)
