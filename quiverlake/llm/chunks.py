"""Splitting oversized texts at natural boundaries, content-defined.

A rolling hash over the text marks landmarks. A piece ends at the first landmark between its
smallest and largest size, moved to the nearest natural boundary. Landmarks depend only on
the characters around them, so an edit moves the cuts near it and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import latest_version

# fixed values: the characters next to which a cut is natural
BOUNDARY = np.array([ord(c) for c in " \t\r\n。！？"], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?:;…"], np.uint32)
WINDOW = 24  # characters the rolling hash covers


def _landmarks(cp: np.ndarray, spacing: int) -> np.ndarray:
    """Positions whose rolling hash over the WINDOW characters before them meets a mask; about one in ``spacing``."""
    if len(cp) < WINDOW:
        return np.empty(0, np.int64)
    v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    n = len(cp) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0xD6E8FEB86659FD93) + v[j : j + n]
    h ^= h >> np.uint64(29)
    return np.flatnonzero(h % np.uint64(max(1, spacing)) == 0) + WINDOW


def _levels(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural cut positions (ascending) and how good each is: 3 blank line, 2 line or sentence end, 1 space."""
    is_b = np.isin(cp, BOUNDARY)
    at = np.flatnonzero(is_b[:-1] | is_b[1:]) + 1 if len(cp) > 1 else np.empty(0, np.int64)
    line = (cp == 10) | (cp == 13)
    before, after = cp[at - 1], is_b[at]
    level = np.ones(len(at), np.int8)
    full = np.isin(before, np.array([0x3002, 0xFF01, 0xFF1F], np.uint32))
    stop = np.zeros(len(at), bool)
    two = at >= 2
    stop[two] = is_b[at[two] - 1] & np.isin(cp[at[two] - 2], _STOPS)
    level[full | stop | line[at - 1]] = 2
    blank = np.zeros(len(at), bool)
    blank[two] = line[at[two] - 1] & line[at[two] - 2]
    level[blank] = 3
    level[after & ~is_b[at - 1]] = 0  # before the boundary character; used only where nothing else fits
    return at, level


def cut_points(text: str, most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Pieces ``(start, end, forced)`` of a text longer than ``most``; ``forced``: its end is no natural boundary.

    Every piece has at most ``most`` code points and starts ``overlap`` before the end of the one
    before. Only where a stretch without boundaries fits into ``most`` but not beside the
    overlap is that overlap shortened, as a natural cut comes first. A cut is forced only in
    a stretch longer than ``most``.
    """
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    overlap = max(0, min(overlap, most - 1))
    natural, level = _levels(cp)
    core = max(1, most - overlap)
    marks = _landmarks(cp, max(1, core // 3))
    radius = core // 4
    out, s, start = [], 0, 0
    while n - start > most:
        lo, hi = max(s + max(1, core // 3), min(start + overlap + 1, start + most)), start + most
        a, b = np.searchsorted(natural, [lo, hi + 1])
        b = max(a, b)
        inner = natural[a:b]
        forced = False
        good = inner[level[a:b] >= 1]
        if len(good):
            i, j = np.searchsorted(marks, [lo, hi + 1])
            mark = int(marks[i]) if i < j else None
            if mark is None:
                best = level[a:b].max()
                end = int(inner[level[a:b] == best][-1])
            else:
                lv = level[a:b]
                end = None
                for want in (3, 2):
                    c = inner[lv >= want]
                    if len(c) and np.abs(c - mark).min() <= radius:
                        end = int(c[np.abs(c - mark).argmin()])
                        break
                if end is None:
                    end = int(good[np.abs(good - mark).argmin()])
        else:
            i, j = np.searchsorted(natural, [s + 1, hi + 1])
            if i < j:
                end = int(natural[j - 1])
            else:
                j = int(np.searchsorted(natural, s + most, "right"))
                if n - s <= most:
                    start = n - most  # the rest fits with a shorter overlap
                    break
                if i < j:
                    end = int(natural[j - 1])
                    start = max(start, end - most)
                else:
                    end, forced = hi, True
        out.append((start, end, forced))
        s, start = end, max(end - overlap, start + 1)
    out.append((start, n, False))
    return out


def mime_key(mime):
    """A mime type without case and without what follows ``;``; null stays null."""
    return F.trim(F.lower(F.substring_index(mime, ";", 1)))


def oversized_pieces(docs: DataFrame, limits: DataFrame, *, with_text: bool = True) -> DataFrame:
    """Pieces of the live texts that exceed the limit of their type.

    ``docs``: ``source, id, mime, text, version, tie``; the live row of (source, id) has the greatest
    ``version``. ``limits``: ``mime, max_chars, overlap_chars``; a null or unlisted mime takes ``*/*``.
    Gives ``source, item_id, piece_no, start_at, end_at, forced, piece``; positions in code points.
    Null, empty and short texts give nothing; repeated rows count once; null ids are left out.
    The limits are a handful of rows by definition (at most 10,000 are accepted). Only long texts
    leave the scan: the live row is chosen over ids and versions with short texts blanked.
    """
    rows = limits.select(mime_key(F.col("mime")).alias("limit_key"), "max_chars", "overlap_chars").where("limit_key is not null and max_chars > 0").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 limits")
    table = {r.limit_key: (int(r.max_chars), int(r.overlap_chars or 0)) for r in rows}
    if "*/*" not in table:
        table["*/*"] = (2**31 - 1, 0)
    pairs = [x for k, (m, o) in table.items() for x in (F.lit(k), F.struct(F.lit(m).alias("m"), F.lit(o).alias("o")))]
    rule = F.create_map(*pairs)
    sized = docs.withColumn("rule", F.coalesce(F.element_at(rule, mime_key(F.col("mime"))), F.element_at(rule, F.lit("*/*"))))
    long = F.length("text") > F.col("rule.m")
    slim = sized.select("source", "id", F.struct("source", "id").alias("key"), "version", "tie", F.when(long, F.col("rule.m")).alias("most"), F.when(long, F.col("rule.o")).alias("overlap"), F.when(long, F.col("text")).alias("text")).where("id is not null")
    live = latest_version(slim, "key", ["version", "tie"]).where("text is not null")
    # the shuffle that chose the live rows has spread the long texts over the tasks that cut
    live = live.select("source", "id", "most", "overlap", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(7)]
            size = 0
            for source, item, most, overlap, text in zip(*(b.column(c).to_pylist() for c in ("source", "id", "most", "overlap", "text"))):
                for no, (a, z, forced) in enumerate(cut_points(text, most, overlap)):
                    for col, v in zip(cols, (source, item, no, a, z, forced, text[a:z] if with_text else None)):
                        col.append(v)
                    size += z - a
                if size > 4_000_000:
                    yield _pieces(cols)
                    cols, size = [[] for _ in range(7)], 0
            if cols[0]:
                yield _pieces(cols)

    return live.mapInArrow(cut, "source string, item_id string, piece_no int, start_at int, end_at int, forced boolean, piece string")


def _pieces(cols):
    types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["source", "item_id", "piece_no", "start_at", "end_at", "forced", "piece"])


def cut_kinds(pieces: DataFrame) -> DataFrame:
    """``item_id, cut``: ``forced`` if any cut of the item is no natural boundary, else ``natural``."""
    return pieces.groupBy("source", "item_id").agg(F.max("forced").alias("f")).select("item_id", F.when(F.col("f"), "forced").otherwise("natural").alias("cut")).distinct()
