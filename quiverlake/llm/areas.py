"""Subject areas of documents: curated weighted terms, found by a multi-pattern automaton.

One pass over the texts finds the terms of every sentence and list line; what it finds is written
once. Over it the rarity of the terms is counted, and the sentences are scored for each area by
the terms they hold, weighted by kind and rarity and normalised by the sentence's length. An area
is assigned when enough of them exceed the threshold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import materialise
from .area_terms import TERMS
from .words import _UNSEEN

UNITS = 3  # sentences or list lines that must be about an area
THRESHOLD = 0.25  # calibrated on labelled documents, see calibrate()
RARE = 1000.0  # a term in one of so many units, or fewer, has full weight

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_LIST = re.compile(r"^\s*(?:[-*+•–]|\(?\d{1,3}[.)])\s+")
_END = re.compile(r"(?<=[.!?。！？])[\"'”’»)]*(?:\s+)|(?<=[。！？])")
_BREAK = re.compile(r"\r\n?|\n")


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", text.replace("’", "'")).translate(_UNSEEN).casefold()


def units(text: str) -> Iterator[str]:
    """Sentences and list lines; code, tables and headings are left out, wrapped lines are joined."""
    held = ""
    for line in _BREAK.split(_FENCE.sub("\n\n", text)):
        line = line.strip().lstrip(">").strip()
        if not line or line.startswith(("#", "|")):
            if held:
                yield from (s for s in _END.split(held) if s and s.strip())
            held = ""
        elif _LIST.match(line):
            if held:
                yield from (s for s in _END.split(held) if s and s.strip())
            held = line
        else:
            held = f"{held} {line}" if held else line
    if held:
        yield from (s for s in _END.split(held) if s and s.strip())


def lexicon(terms: dict[str, dict[str, str]] = TERMS) -> list[tuple[str, str, float]]:
    """``(folded term, area, weight)``: phrases weigh 1.5, words 1 and hints 0.4. A term of several areas is split."""
    found: dict[str, dict[str, float]] = {}
    for area, groups in terms.items():
        for name, group in groups.items():
            for term in group.split(" | "):
                if term.strip():
                    key = fold(term.strip())
                    weight = 0.4 if name == "hints" else 1.5 if " " in key or "-" in key else 1.0
                    own = found.setdefault(key, {})
                    own[area] = max(weight, own.get(area, 0.0))
    return [(t, a, w / len(areas)) for t, areas in sorted(found.items()) for a, w in sorted(areas.items())]


class Matcher:
    """Finds terms, as their numbers in the sorted list of terms."""

    def __init__(self, entries: list[tuple[str, str, float]]):
        self.terms_list = sorted({t for t, _, _ in entries})
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(self.terms_list):
            self.auto.add_word(t, (i, len(t)))
        self.empty = not self.terms_list
        if not self.empty:
            self.auto.make_automaton()

    def terms(self, folded: str) -> set[int]:
        """Terms that stand as whole words (a plural ending is allowed), the longest where they overlap."""
        if self.empty:
            return set()
        hits = []
        for end, (i, n) in self.auto.iter(folded):
            a, z = end - n + 1, end + 1
            if a and folded[a - 1].isalnum():
                continue
            if folded[z : z + 1].isalnum() and not _PLURAL.match(folded, z):
                continue
            hits.append((a, -z, i))
        if len(hits) < 2:
            return {h[2] for h in hits}
        hits.sort()
        out, reach = set(), -1
        for a, z, i in hits:
            if -z > reach:
                out.add(i)
                reach = -z
        return out


_PLURAL = re.compile(r"(?:s|es|n|en|e|er)(?![^\W_])")


def term_hits(docs: DataFrame, entries, *, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, same, n_units, n_terms array<int>, n_spaces array<int>, terms array<int>``, a row per document.

    Of every unit that holds a term: the number of its terms and of its spaces, and the terms one after
    another. ``same`` is a hash of the text, equal for copies.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0).cast("bigint")).alias("same"), F.col(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def lists(rows: list[list[int]]) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter((v for r in rows for v in r), np.int32, int(offsets[-1]))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(entries)
        for b in batches:
            total, counts, spaces, found = [], [], [], []
            for text in b.column("text").to_pylist():
                n, c, l, f = 0, [], [], []  # noqa: E741
                for u in units(text or ""):
                    n += 1
                    folded = fold(u)
                    got = m.terms(folded)
                    if got:
                        c.append(len(got))
                        l.append(folded.count(" "))
                        f.extend(sorted(got))
                total.append(n)
                counts.append(c)
                spaces.append(l)
                found.append(f)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("same"), pa.array(total, pa.int32()), lists(counts), lists(spaces), lists(found)], ["doc_id", "same", "n_units", "n_terms", "n_spaces", "terms"])

    return chosen.mapInArrow(find, f"doc_id {kind}, same bigint, n_units int, n_terms array<int>, n_spaces array<int>, terms array<int>")


def rarities(hits: DataFrame, entries) -> np.ndarray:
    """By term, between 0.5 (in every unit) and 1 (in one of ``RARE`` or fewer), over all different texts.

    Copies of a text count once, and only shares count, so neither the size of the corpus nor a much
    copied text changes a document's areas. One row per term reaches the driver.
    """
    n_terms = len({t for t, _, _ in entries})
    once = hits.dropDuplicates(["same"])
    rows = once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    total = once.agg(F.sum("n_units")).first()[0] or 0
    df = np.zeros(n_terms)
    for r in rows:
        df[r.term] = r.n
    return 0.5 + 0.5 * np.clip(np.log((total + 2) / (df + 1)) / math.log(RARE), 0.0, 1.0)


def score_units(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, unit x area scores)`` of the units with terms; areas under half of a unit's best count as none."""
    counts, spaces, terms = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n_terms", "n_spaces", "terms"))
    per_doc = batch.column("n_terms").value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(batch.num_rows), per_doc)
    if not len(counts):
        return doc, np.zeros((0, weights.shape[1]))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    score = np.add.reduceat(weights[terms], starts, axis=0)
    score[score < 0.5 * score.max(axis=1, keepdims=True)] = 0
    return doc, score / (1 + np.log1p(spaces / 12))[:, None]


def subject_areas(docs: DataFrame, *, doc_id: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = UNITS, terms: dict | None = None) -> DataFrame:
    """``doc_id, area, n_units, score``: every area that at least ``least`` sentences or list lines are about.

    ``score`` is the mean score of those units. Null, empty and termless texts have no area. Whole
    texts are read once. Rows that repeat a document repeat its result.
    """
    entries = lexicon(TERMS if terms is None else terms)
    hits = materialise(term_hits(docs, entries, doc_id=doc_id, text_col=text_col), "terms")
    return _assigned(hits, entries, rarities(hits, entries), threshold, least)


def _assigned(hits: DataFrame, entries, rarity: np.ndarray, threshold: float, least: int) -> DataFrame:
    names, numbers = sorted({a for _, a, _ in entries}), {t: i for i, t in enumerate(sorted({t for t, _, _ in entries}))}
    weights = np.zeros((max(1, len(numbers)), max(1, len(names))))
    for t, a, w in entries:
        weights[numbers[t], names.index(a)] = w * rarity[numbers[t]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, score = score_units(b, weights)
            good = score >= threshold
            n, total = np.zeros((b.num_rows, weights.shape[1]), np.int32), np.zeros((b.num_rows, weights.shape[1]))
            np.add.at(n, doc, good)
            np.add.at(total, doc, np.where(good, score, 0))
            rows, area = np.nonzero(n >= least)
            if len(rows):
                mean = np.round(total[rows, area] / n[rows, area], 6)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array([names[a] for a in area], pa.string()), pa.array(n[rows, area]), pa.array(mean)], ["doc_id", "area", "n_units", "score"])

    kind = hits.schema["doc_id"].dataType.simpleString()
    return hits.select("doc_id", "n_terms", "n_spaces", "terms").mapInArrow(assign, f"doc_id {kind}, area string, n_units int, score double")


def area_shares(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``area, n_docs, share`` of all documents; a document with several areas counts in each."""
    total = max(1, docs.count())
    return found.groupBy("area").agg(F.countDistinct("doc_id").alias("n_docs")).select("area", "n_docs", F.round(F.col("n_docs") / F.lit(total), 6).alias("share"))


def calibrate(docs: DataFrame, labels: DataFrame, *, most_docs: int = 5000, grid: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.6), terms: dict | None = None) -> dict[float, tuple[int, int, int]]:
    """``{threshold: (true cases, found, both)}`` over at most ``most_docs`` labelled documents.

    Rarity is that of all ``docs``; they are searched once.
    """
    ids = labels.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(most_docs)
    truth = {tuple(r) for r in labels.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "area").distinct().collect()}
    entries = lexicon(TERMS if terms is None else terms)
    hits = materialise(term_hits(docs, entries), "terms")
    rarity = rarities(hits, entries)
    some = materialise(hits.join(F.broadcast(ids), "doc_id"), "labelled")
    out = {}
    for t in grid:
        got = {tuple(r) for r in _assigned(some, entries, rarity, t, UNITS).select("doc_id", "area").distinct().collect()}
        out[t] = (len(truth), len(got), len(got & truth))
    return out


def f1(true: int, found: int, both: int) -> float:
    return 2 * both / max(1, true + found)
