"""Vector quantizers: train on a bounded sample, encode and score in Arrow batches.

A codec is a small object of numpy arrays (the codebook), sent to the tasks as it is. Each has
``encode`` (rows -> bytes), ``decode`` and ``scores(query, codes)``, an approximation of the dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 25_000


def sample_embeddings(df: DataFrame, vec_col: str = "vector", rows: int = SAMPLE_ROWS, seed: int = 42) -> np.ndarray:
    """About ``rows`` of the rows (all of a smaller table), uniformly and reproducibly, for training.

    A filter on a hash in the scan leaves a share of ``rows`` over their number; no sort of the table.
    """
    picked = df.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).cast("array<float>").alias("v"))
    total = picked.count()
    if total > rows:
        picked = picked.where(F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    column = picked.limit(2 * rows).toArrow().column("v").combine_chunks()
    if not len(column):
        return np.empty((0, 0), np.float32)
    fit, x = _rows(column)
    return x[np.lexsort(x.T[:4])].astype(np.float32)


# -- rotations ------------------------------------------------------------------------------------

def dense_rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix by QR of a Gaussian one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def givens_rotation(dim: int, seed: int = 42, rounds: int = 4) -> np.ndarray:
    """A product of random plane rotations over shuffled coordinate pairs."""
    rng, m = np.random.default_rng(seed), np.eye(dim)
    for _ in range(rounds):
        p = rng.permutation(dim)
        for i, j in zip(p[::2], p[1::2]):
            a = rng.uniform(0, 2 * np.pi)
            m[[i, j]] = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]) @ m[[i, j]]
    return m


def quaternion_rotation(dim: int, seed: int = 42, rounds: int = 4) -> np.ndarray:
    """Random unit quaternions acting on shuffled blocks of four coordinates; a remainder stays."""
    rng, m = np.random.default_rng(seed), np.eye(dim)
    for _ in range(rounds):
        p = rng.permutation(dim)
        for at in range(0, dim - dim % 4, 4):
            w, x, y, z = (v := rng.normal(size=4)) / np.linalg.norm(v)
            left = np.array([[w, -x, -y, -z], [x, w, -z, y], [y, z, w, -x], [z, -y, x, w]])
            m[p[at : at + 4]] = left @ m[p[at : at + 4]]
    return m


# -- codecs -----------------------------------------------------------------------------------------

class Scalar:
    """Levels 0..2^bits-1 between two-sided quantiles; 7 levels bits fill a byte (127), 4 are packed two to a byte."""

    def __init__(self, low: float, high: float, bits: int = 7):
        self.low, self.high, self.bits = float(low), float(high), bits
        self.top = (1 << bits) - 1
        self.scale = self.top / (self.high - self.low) if self.high > self.low else 0.0

    @classmethod
    def train(cls, x: np.ndarray, bits: int = 7, interval: float = 0.99) -> Scalar:
        cut = (1 - interval) / 2
        return cls(*np.quantile(x, [cut, 1 - cut]), bits)

    def levels(self, x):
        return np.floor((np.clip(x, self.low, self.high) - self.low) * self.scale + 0.5).astype(np.uint8)

    def encode(self, x):
        q = self.levels(x)
        if self.bits > 4:
            return q
        if q.shape[1] % 2:
            q = np.hstack([q, np.zeros((len(q), 1), np.uint8)])
        return q[:, ::2] | q[:, 1::2] << 4

    def decode(self, codes, dim=None):
        if self.bits <= 4:
            codes = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, :dim]
        return self.low + codes / self.scale if self.scale else np.full(codes.shape, self.low)

    def scores(self, q, codes):
        return self.decode(codes, len(q)) @ q


def _lloyd(x, k, rng, steps=12, weight=None):
    """k-means++ seeds, then Lloyd steps until nothing moves."""
    k, x = min(k, len(x)), np.asarray(x, np.float64)
    norm = (x**2).sum(1)
    c = np.empty((k, x.shape[1]))
    c[0] = x[rng.choice(len(x))]
    near = ((x - c[0]) ** 2).sum(1)
    for i in range(1, k):
        total = near.sum()
        c[i] = x[rng.choice(len(x), p=near / total if total > 0 else None)]
        near = np.minimum(near, np.maximum(norm - 2 * x @ c[i] + c[i] @ c[i], 0))
    w, before = np.ones(len(x)) if weight is None else weight, None
    for _ in range(steps):
        a = np.concatenate([((c**2).sum(1) - 2 * x[i : i + 16384] @ c.T).argmin(1) for i in range(0, len(x), 16384)])
        if before is not None and (a == before).all():
            break
        before = a
        order = np.argsort(a, kind="stable")
        some, start = np.unique(a[order], return_index=True)
        mass = np.add.reduceat(w[order], start)
        sums = np.add.reduceat(x[order] * w[order, None], start, axis=0)
        good = mass > 0
        c[some[good]] = sums[good] / mass[good, None]
    return c


class Product:
    """Product quantizer: subspaces (the first ``dim % m`` get one dimension more), at most 256 centroids each, optional
    centring, rotation (OPQ) and anisotropic training weights."""

    def __init__(self, books, cuts, center, rotation):
        self.books, self.cuts, self.center, self.rotation = books, cuts, center, rotation

    @classmethod
    def train(cls, x, m: int | None = None, k: int = 256, center: bool = False, rotate: int = 0, anisotropic: bool = False, seed: int = 42) -> Product:
        x = x.astype(np.float64)
        dim = x.shape[1]
        m = m or max(1, dim // 8)
        sizes = [dim // m + (i < dim % m) for i in range(m)]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        mean = x.mean(0) if center else np.zeros(dim)
        weight = np.linalg.norm(x, axis=1) if anisotropic else None
        rng, r = np.random.default_rng(seed), np.eye(dim)
        for turn in range(rotate + 1):
            y = (x - mean) @ r
            books = [_lloyd(y[:, a:b], k, rng, 12 if turn == rotate else 4, weight) for a, b in zip(cuts, cuts[1:])]
            pq = cls(books, cuts, mean, r)
            if turn < rotate:  # orthogonal Procrustes: the rotation that best maps the data to its reconstruction
                u, _, vt = np.linalg.svd((x - mean).T @ pq._rebuilt(pq.encode(x)))
                r = u @ vt
        return pq

    def _rebuilt(self, codes):
        return np.hstack([b[codes[:, i]] for i, b in enumerate(self.books)])

    def encode(self, x):
        y = (x.astype(np.float64) - self.center) @ self.rotation
        return np.stack([((y[:, a:b] ** 2).sum(1)[:, None] - 2 * y[:, a:b] @ c.T + (c**2).sum(1)).argmin(1) for c, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1).astype(np.uint8)

    def decode(self, codes, dim=None):
        return self._rebuilt(codes) @ self.rotation.T + self.center

    def tables(self, q):
        """Per subspace the dot products of the query with its centroids (ADC lookup tables)."""
        y = q @ self.rotation
        return [c @ y[a:b] for c, a, b in zip(self.books, self.cuts, self.cuts[1:])]

    def scores(self, q, codes):
        return sum(t[codes[:, i]] for i, t in enumerate(self.tables(q))) + q @ self.center


class SignBits:
    """Sign bits (v >= 0 is 1). ``scores`` is the similarity by Hamming distance, 1 - h/d."""

    def __init__(self, dim: int, center=None):
        self.dim, self.center = dim, center

    @classmethod
    def train(cls, x, centred: bool = False) -> SignBits:
        return cls(x.shape[1], x.mean(0) if centred else None)

    def encode(self, x):
        return np.packbits((x if self.center is None else x - self.center) >= 0, axis=1, bitorder="little")

    def decode(self, codes, dim=None):
        s = np.unpackbits(codes, axis=1, bitorder="little")[:, : self.dim] * 2.0 - 1
        return s if self.center is None else s / np.sqrt(self.dim) + self.center

    def hamming(self, q, codes):
        return np.unpackbits(codes ^ self.encode(q[None])[0], axis=1).sum(1)

    def scores(self, q, codes):
        if self.center is None:
            return 1 - self.hamming(q, codes) / self.dim
        y = q - self.center  # the query keeps 4 bits
        top = np.abs(y).max() or 1.0
        y = np.round(y / top * 7) / 7 * top
        return (np.unpackbits(codes, axis=1, bitorder="little")[:, : self.dim] * 2.0 - 1) @ y


class RaBit:
    """Centred, normalised and rotated sign codes with ``bits`` - 1 magnitude bits, and per row the norm and the cosine
    between the row and its code, which correct the estimate of the dot product."""

    def __init__(self, center, rotation, bits: int = 1):
        self.center, self.rotation, self.bits = center, rotation, bits

    @classmethod
    def train(cls, x, bits: int = 1, rotation: str = "givens", seed: int = 42) -> RaBit:
        make = {"givens": givens_rotation, "dense": dense_rotation, "quaternion": quaternion_rotation}[rotation]
        return cls(x.mean(0).astype(np.float64), make(x.shape[1], seed), bits)

    def _codes(self, u):
        """Odd levels: sign times (2 magnitude + 1), the scale chosen per row for the best cosine."""
        levels = (1 << (self.bits - 1)) - 1
        if not levels:
            return np.where(u >= 0, 1.0, -1.0)
        best, best_cos = None, None
        for step in np.linspace(0.6, 2.4, 13) / np.sqrt(u.shape[1]) / levels * 2:
            c = np.where(u >= 0, 1, -1) * (2 * np.minimum(np.floor(np.abs(u) / step), levels) + 1)
            cos = (c * u).sum(1) / np.linalg.norm(c, axis=1)
            if best is None:
                best, best_cos = c, cos
            else:
                m = cos > best_cos
                best[m], best_cos[m] = c[m], cos[m]
        return best

    def encode(self, x):
        r = x.astype(np.float64) - self.center
        norm = np.linalg.norm(r, axis=1)
        u = r / np.where(norm == 0, 1, norm)[:, None] @ self.rotation
        c = self._codes(u)
        cos = (c * u).sum(1) / np.linalg.norm(c, axis=1)
        extra = np.stack([norm, np.where(cos == 0, 1, cos)], 1).astype(np.float32)
        return np.hstack([self._pack(c), extra.view(np.uint8).reshape(len(x), -1)])

    def _pack(self, c):
        """``bits`` bits a dimension, one after another: odd levels -top..top as 0..top."""
        v = ((c + (1 << self.bits) - 1) / 2).astype(np.uint8)
        return np.packbits((v[:, :, None] >> np.arange(self.bits, dtype=np.uint8) & 1).reshape(len(c), -1), axis=1)

    def _unpack(self, body, dim):
        b = np.unpackbits(body, axis=1)[:, : dim * self.bits].reshape(len(body), dim, self.bits)
        return (b @ (1 << np.arange(self.bits))) * 2.0 - ((1 << self.bits) - 1)

    def _split(self, codes, dim):
        extra = np.ascontiguousarray(codes[:, -8:]).view(np.float32)
        body = codes[:, :-8]
        c = self._unpack(body, dim)
        return c / np.linalg.norm(c, axis=1, keepdims=True), extra[:, 0].astype(float), extra[:, 1].astype(float)

    def decode(self, codes, dim=None):
        c, norm, cos = self._split(codes, len(self.center))
        return (c * (norm * cos)[:, None]) @ self.rotation.T + self.center

    def scores(self, q, codes):
        c, norm, cos = self._split(codes, len(q))
        return norm * (c @ (q @ self.rotation)) / cos + q @ self.center


class NonUniform:
    """Global centring, then per subvector a logistic curve mapped to uint8, with four floats a subvector (min, span, middle, slope)."""

    def __init__(self, center, cuts):
        self.center, self.cuts = center, cuts

    @classmethod
    def train(cls, x, sub_parts: int | None = None) -> NonUniform:
        dim = x.shape[1]
        m = sub_parts or max(1, dim // 4)
        return cls(x.mean(0).astype(np.float64), np.concatenate([[0], np.cumsum([dim // m + (i < dim % m) for i in range(m)])]))

    @staticmethod
    def _curve(t, mid, slope):
        f = lambda v: 1 / (1 + np.exp(-slope * (v - mid)))
        lo, hi = f(0.0), f(1.0)
        return (f(t) - lo) / (hi - lo)

    @staticmethod
    def _inverse(y, mid, slope):
        f = lambda v: 1 / (1 + np.exp(-slope * (v - mid)))
        lo, hi = f(0.0), f(1.0)
        p = np.clip(lo + y * (hi - lo), 1e-9, 1 - 1e-9)
        return mid + np.log(p / (1 - p)) / slope

    def encode(self, x):
        r, out = x.astype(np.float64) - self.center, []
        for a, b in zip(self.cuts, self.cuts[1:]):
            s = r[:, a:b]
            lo = s.min(1, keepdims=True)
            span = np.maximum(s.max(1, keepdims=True) - lo, 1e-12)
            t = (s - lo) / span
            mid = np.clip(t.mean(1, keepdims=True), 0.05, 0.95)
            best = None
            for slope in (0.5, 2.0, 4.0, 8.0):
                q = np.floor(self._curve(t, mid, slope) * 255 + 0.5)
                err = ((self._inverse(q / 255, mid, slope) - t) ** 2).sum(1)
                if best is None:
                    best = [q, err, np.full(len(x), slope)]
                else:
                    m = err < best[1]
                    best[0][m], best[1][m], best[2][m] = q[m], err[m], slope
            extra = np.hstack([lo, span, mid, best[2][:, None]]).astype(np.float32)
            out += [best[0].astype(np.uint8), extra.view(np.uint8).reshape(len(x), -1)]
        return np.hstack(out)

    def decode(self, codes, dim=None):
        at, out = 0, []
        for a, b in zip(self.cuts, self.cuts[1:]):
            q = codes[:, at : at + b - a] / 255.0
            e = np.ascontiguousarray(codes[:, at + b - a : at + b - a + 16]).view(np.float32).astype(np.float64)
            out.append(self._inverse(q, e[:, 2:3], e[:, 3:4]) * e[:, 1:2] + e[:, 0:1])
            at += b - a + 16
        return np.hstack(out) + self.center

    def scores(self, q, codes):
        return self.decode(codes) @ q


class Turbo:
    """Centred, normalised, rotated; every coordinate by a Lloyd-Max codebook of the Gaussian it then follows; with
    ``residual`` a sign sketch of the remaining error makes the dot product estimate unbiased."""

    def __init__(self, center, rotation, levels, residual):
        self.center, self.rotation, self.levels, self.residual = center, rotation, levels, residual

    @classmethod
    def train(cls, x, bits: int = 8, residual: bool = False, seed: int = 42) -> Turbo:
        dim = x.shape[1]
        g = np.quantile(np.random.default_rng(0).normal(size=200_000), (np.arange(4096) + 0.5) / 4096)
        c = np.quantile(g, (np.arange(1 << bits) + 0.5) / (1 << bits))
        for _ in range(60):
            edges = (c[1:] + c[:-1]) / 2
            where = np.searchsorted(edges, g)
            n = np.bincount(where, minlength=len(c))
            c = np.where(n > 0, np.bincount(where, g, len(c)) / np.maximum(n, 1), c)
        return cls(x.mean(0).astype(np.float64), dense_rotation(dim, seed), c / np.sqrt(dim), dense_rotation(dim, seed + 1) if residual else None)

    def encode(self, x):
        r = x.astype(np.float64) - self.center
        norm = np.linalg.norm(r, axis=1)
        u = r / np.where(norm == 0, 1, norm)[:, None] @ self.rotation
        q = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, u).astype(np.uint8)
        parts = [q, norm.astype(np.float32)[:, None].view(np.uint8)]
        if self.residual is not None:
            e = u - self.levels[q]
            parts += [np.packbits(e @ self.residual > 0, axis=1), np.linalg.norm(e, axis=1).astype(np.float32)[:, None].view(np.uint8)]
        return np.hstack(parts)

    def _units(self, codes):
        dim = len(self.center)
        u = self.levels[codes[:, :dim]]
        if self.residual is not None:
            bits = -(-dim // 8)
            s = np.unpackbits(codes[:, dim + 4 : dim + 4 + bits], axis=1)[:, :dim] * 2.0 - 1
            size = np.ascontiguousarray(codes[:, dim + 4 + bits : dim + 8 + bits]).view(np.float32).astype(float)
            u = u + size * np.sqrt(np.pi / 2) / dim * (s @ self.residual.T)
        return u, np.ascontiguousarray(codes[:, dim : dim + 4]).view(np.float32).astype(float)

    def decode(self, codes, dim=None):
        u, norm = self._units(codes)
        return u * norm @ self.rotation.T + self.center

    def scores(self, q, codes):
        u, norm = self._units(codes)
        return norm[:, 0] * (u @ (q @ self.rotation)) + q @ self.center


class Half:
    """IEEE half precision, two bytes little-endian."""

    @classmethod
    def train(cls, x) -> Half:
        return cls()

    def encode(self, x):
        return x.astype("<f2").view(np.uint8).reshape(len(x), -1)

    def decode(self, codes, dim=None):
        return np.ascontiguousarray(codes).view("<f2").astype(np.float64)

    def scores(self, q, codes):
        return self.decode(codes) @ q


KINDS = {
    "sq8": lambda x: Scalar.train(x, 7), "sq4": lambda x: Scalar.train(x, 4), "pq": lambda x: Product.train(x), "opq": lambda x: Product.train(x, rotate=3),
    "bq": lambda x: SignBits.train(x, centred=True), "sign": lambda x: SignBits.train(x), "rabitq": lambda x: RaBit.train(x), "extended_rabitq": lambda x: RaBit.train(x, bits=4),
    "nvq": lambda x: NonUniform.train(x), "turboquant": lambda x: Turbo.train(x), "fp16": lambda x: Half.train(x),
}


def train(kind: str, df: DataFrame, vec_col: str = "vector"):
    """A codec of ``kind``, trained on at most SAMPLE_ROWS embeddings."""
    return KINDS[kind](sample_embeddings(df, vec_col))


def _rows(column, dim=None):
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(n == (dim or n.max(initial=-1))) if len(n) else n
    fit = fit[n[fit] > 0] if len(fit) else fit
    return fit, column.take(pa.array(fit, pa.int64())).flatten().to_numpy(zero_copy_only=False).reshape(len(fit), -1)


def encode(df: DataFrame, codec, *, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``id, code binary``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fit, x = _rows(b.column("v"))
            if len(fit):
                codes = np.ascontiguousarray(codec.encode(x))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(fit)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("v")).mapInArrow(run, f"id {id_type}, code binary")


def approximate_scores(encoded: DataFrame, codec, query) -> DataFrame:
    """``id, coarse``: the codec's score of every code."""
    id_type, q = encoded.schema["id"].dataType.simpleString(), np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.asarray(codec.scores(q, codes), np.float64))], ["id", "coarse"])

    return encoded.mapInArrow(run, f"id {id_type}, coarse double")


def two_pass_search(table: DataFrame, encoded: DataFrame, codec, query, k: int, *, over: float = 4.0, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The best ``max(k, ceil(k over))`` by code, then exact scores of those."""
    from .search import rescore

    n = max(k, int(np.ceil(k * over)))
    coarse = approximate_scores(encoded, codec, query).orderBy(F.desc("coarse"), "id").limit(n)
    return rescore(coarse.withColumnRenamed("id", id_col), table, query, k, metric=metric, id_col=id_col, vec_col=vec_col)


def coarse_places(encoded: DataFrame, codec, queries: DataFrame, truth: DataFrame) -> np.ndarray:
    """Place, from 1, of every true neighbour when all codes are ordered by the codec's score for its query, then by id.

    ``queries``: ``qid, qvec``; ``truth``: ``qid, id``; both bounded, they go to every task. The share of places up to n
    is the recall of a candidate cut of n.
    """
    from .runtime import bounded_rows

    embeddings = {r.qid: np.array(r.qvec, np.float64) for r in bounded_rows(queries.select("qid", "qvec"), 4096, "the queries")}
    wanted = {}
    for r in bounded_rows(truth.select("qid", "id"), 100_000, "the truth"):
        wanted.setdefault(r.qid, []).append(r.id)
    if not wanted:
        return np.empty(0, np.int64)
    names = sorted(wanted)
    ids = pa.array(sorted({i for n in names for i in wanted[n]}))
    near = encoded.where(F.col("id").isin(ids.to_pylist())).select("id", "code").collect()
    codes = {r.id: np.frombuffer(r.code, np.uint8) for r in near}
    marks = {n: (np.asarray(codec.scores(embeddings[n], np.stack([codes[i] for i in wanted[n]])), np.float64), np.array(wanted[n])) for n in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = [np.zeros(len(wanted[n]), np.int64) for n in names]
        for b in batches:
            if b.num_rows:
                rows = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                own = b.column("id").to_numpy(zero_copy_only=False)
                for at, n in zip(before, names):
                    s, (mark, who) = np.asarray(codec.scores(embeddings[n], rows), np.float64)[:, None], marks[n]
                    tied = np.abs(s - mark) <= 1e-9 * np.maximum(1, np.abs(mark))  # rounding differs with the batch
                    at += ((s > mark) & ~tied | tied & (own[:, None] <= who)).sum(axis=0)
        flat = np.concatenate(before)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

    got = encoded.select("id", "code").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    return got.column("n").to_numpy()


def enough_over(encoded: DataFrame, codec, queries: DataFrame, truth: DataFrame, k: int, target: float, least: float = 4.0) -> float:
    """The oversampling factor, at least ``least``, with which two passes find ``target`` of the true neighbours of ``queries``."""
    places = np.sort(coarse_places(encoded, codec, queries, truth))
    return max(least, float(places[int(np.ceil(target * len(places))) - 1]) / k) if len(places) else least


# -- expressions for given bounds, inside the JVM --------------------------------------------------

def scalar_levels(vec: Column, low: float, high: float, bits: int = 7) -> Column:
    top = (1 << bits) - 1
    return F.transform(vec, lambda x: F.floor((F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) * (top / (high - low)) + 0.5).cast("int"))


def scalar_decoded(levels: Column, low: float, high: float, bits: int = 7) -> Column:
    return F.transform(levels, lambda q: F.lit(low) + q * ((high - low) / ((1 << bits) - 1)))
