"""Evaluation texts leaking into training text.

Size-partitioned MinHash containment: every run of ``run`` words of a test item is a small set
of word shingles that must lie wholly inside a document. A document's set holds, of all its
shingles, those that any item has: the others cannot decide a containment. Sets are partitioned by
size, and each class uses as many hash functions as make a missed containment less likely
than ``miss``; a set above the largest class is cut into overlapping runs. Candidates are
verified on the words themselves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import materialise
from .words import words

SHINGLE = 5
CLASSES = (8, 12, 16, 24, 32)  # most shingles of a set, by class
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hasher:
    """64-bit hashes of words, remembered for the common ones."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(ws).difference(known):
            b = w.encode("utf-8", "replace")
            known[w] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the consecutive ``size``-word runs."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _P + _mix(h[j : j + n])
    return _mix(out)


class ContainmentIndex:
    """MinHash signatures of all ``run``-word passages of the items, by hash function."""

    def __init__(self, items: list[tuple[str, str]], run: int = 10, miss: float = 1e-6, seed: int = 5):
        self.run, self.per = run, run - SHINGLE + 1
        self.classes = [max(c, self.per) for c in CLASSES]
        self.functions = [max(1, math.ceil(math.log(miss) / math.log(1 - self.per / c))) if c > self.per else 1 for c in self.classes]
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, max(self.functions), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, max(self.functions), np.uint64)
        hasher, sets, owner = _Hasher(), [], []
        self.names, self.passages = [], []
        for name, text in items:
            ws = words(text)
            if len(ws) < run:
                continue
            s = shingles(hasher(ws))
            sets.append(np.lib.stride_tricks.sliding_window_view(s, self.per))
            owner.append(np.full(len(ws) - run + 1, len(self.names)))
            self.names.append(name)
            self.passages.append(frozenset(" ".join(ws[i : i + run]) for i in range(len(ws) - run + 1)))
        self.empty = not sets
        if self.empty:
            return
        m, owner = np.concatenate(sets), np.concatenate(owner).astype(np.int32)
        self.known = np.unique(m)
        self.values, self.owners = [], []
        for a, b in zip(self.a, self.b):
            v = (m * a + b).min(axis=1)
            order = np.lexsort((owner, v))
            v, o = v[order], owner[order]
            keep = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
            self.values.append(v[keep])
            self.owners.append(o[keep])

    def sets(self, texts: list[list[str]], hasher: _Hasher) -> Iterator[tuple[int, np.ndarray]]:
        """(text number, shingles that items have), in order of the text and cut where a set is above the largest class."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        h = hasher([w for ws in texts for w in ws])
        s = shingles(h)  # over the seams between texts too; those are left out
        if not len(s):
            return
        text = np.repeat(np.arange(len(texts)), lengths)
        inside = text[: len(s)] == text[SHINGLE - 1 :]
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        held = np.flatnonzero((self.known[at] == s) & inside)
        if not len(held):
            return
        top, step = self.classes[-1], self.classes[-1] - self.per + 1
        who = text[held]
        edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        for i, j in zip(edges, edges[1:]):
            if j - i < self.per:
                continue  # fewer places than a passage has
            for k in range(i, j - self.per + 1, step):
                yield int(who[i]), s[held[k : min(k + top, j)]]

    def candidates(self, texts: list[list[str]], hasher: _Hasher) -> set[tuple[int, int]]:
        """(text number, item number) of the pairs whose signatures meet."""
        by_class: list[list] = [[] for _ in self.classes]
        for t, part in self.sets(texts, hasher):
            by_class[int(np.searchsorted(self.classes, len(part)))].append((t, part))
        found: set[tuple[int, int]] = set()
        for size, count, members in zip(self.classes, self.functions, by_class):
            for start in range(0, len(members), 1024):
                some = members[start : start + 1024]
                m = np.empty((len(some), size), np.uint64)
                for r, (_, part) in enumerate(some):
                    m[r, : len(part)] = part
                    m[r, len(part) :] = part[0]
                who = np.array([t for t, _ in some])
                low = (m[None, :, :] * self.a[:count, None, None] + self.b[:count, None, None]).min(axis=2)
                for v, values, owners in zip(low, self.values, self.owners):
                    lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                    n = hi - lo
                    if n.any():
                        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                        found.update(zip(np.repeat(who, n).tolist(), owners[first + np.arange(n.sum())].tolist()))
        return found

    def verified(self, ws: list[str], items: list[int]) -> list[int]:
        """Those of ``items`` of which the words hold a passage."""
        runs = {" ".join(ws[i : i + self.run]) for i in range(len(ws) - self.run + 1)}
        return [i for i in items if not self.passages[i].isdisjoint(runs)]


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", run: int = 10, items_per_pass: int = 5_000) -> DataFrame:
    """``doc_id, item_id`` of every document that holds ``run`` consecutive words of an item.

    Words are compared in the form of :mod:`.words`. Items sharing a passage all count; items
    shorter than ``run`` words, and null or empty texts on either side, give no rows. Repeated rows
    give one row. The items are a test set: its index is broadcast in passes of
    ``items_per_pass`` items. More than one pass are written one after another, each over all
    documents, and each index is destroyed before the next is built, so the driver and the tasks
    hold one at a time. Documents never leave their task; there is no shuffle before the final
    distinct.
    """
    if run <= SHINGLE:
        raise ValueError(f"run must be above {SHINGLE} words")
    spark, out_type = docs.sparkSession, dict(docs.dtypes)[doc_id]
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))

    def one(batch):
        index = spark.sparkContext.broadcast(ContainmentIndex(batch, run))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, hasher = index.value, _Hasher()
            if at.empty:
                return
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    b = whole.slice(start, 256)
                    ws = [words(t) for t in b.column("text").to_pylist()]
                    met: dict[int, list[int]] = {}
                    for t, i in at.candidates(ws, hasher):
                        met.setdefault(t, []).append(i)
                    good = [(t, i) for t in sorted(met) for i in at.verified(ws[t], sorted(met[t]))]
                    if good:
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array([t for t, _ in good])), pa.array([at.names[i] for _, i in good])], ["doc_id", "item_id"])

        return chosen.mapInArrow(search, f"doc_id {out_type}, item_id string"), index

    done, batch = [], []
    for r in rows.toLocalIterator():
        if len(batch) == items_per_pass:
            found, index = one(batch)
            done.append(materialise(found, "leaks"))
            index.destroy()
            batch = []
        batch.append((r.i, r.t))
    out = one(batch)[0]
    for p in done:
        out = out.unionByName(p)
    return out.distinct()
