"""Encoding a corpus with a public byte-level BPE vocabulary.

The words of a batch that are new to the worker are merged together: all their symbols lie in
one flat array, every round looks up the adjacent pairs of all words by binary search over
the sorted pair keys and applies each word's lowest-ranked merge.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the word pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_MERGE = np.int32(2**31 - 1)
CACHED_WORDS = 300_000  # words a worker remembers; the cache starts anew beyond that


class PairTable:
    """Sorted keys of all pairs that merge, the merged ids (which are the ranks), and the ids of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    @classmethod
    def read(cls, path: str) -> PairTable:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NO_MERGE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[list[int]] = [[] for _ in words]
        while len(symbols):
            rank = np.full(len(symbols), NO_MERGE, np.int32)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner] = self.look_up(symbols[inner], symbols[inner + 1])
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate([starts, [len(symbols)]]))
            low = np.repeat(lowest, size)
            ready = low == NO_MERGE
            if ready.any():
                out, at = symbols[ready].tolist(), 0
                for s, n in zip(starts[lowest == NO_MERGE], size[lowest == NO_MERGE]):
                    done[word[s]] = out[at : at + n]
                    at += n
                if ready.all():
                    break
                symbols, word, rank, low = symbols[~ready], word[~ready], rank[~ready], low[~ready]
            hit = rank == low
            # of overlapping merges in a run the first, third, ... apply
            run = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
            at = np.flatnonzero(hit)
            at = at[(at - run[np.searchsorted(run, at, side="right") - 1]) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = rank[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return done


class WordIds:
    """Ids of the words met so far, one after another in one array; texts are put together from places in it."""

    def __init__(self, pairs: PairTable):
        self.pairs, self.number = pairs, {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def of_texts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the texts, given as words."""
        if len(self.number) > CACHED_WORDS:
            self.__init__(self.pairs)
        new = sorted({w for t in texts for w in t}.difference(self.number))
        if new:
            found = self.pairs.encode_words([w.encode("utf-8", "replace") for w in new])
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            length = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32, int(length.sum()))])
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter((self.number[w] for t in texts for w in t), np.int64, int(counts.sum()))
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], length) + np.arange(ends[-1])]
        return ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32), ids


def encode(df: DataFrame, *, text_col: str = "text", out_col: str = "ids", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """All columns of ``df`` without ``text_col``, plus ``out_col``: array<int>, the ids of the whole text.

    Null and empty texts give an empty list. Strings that look like special tokens are plain
    text. A column of ``df`` already named ``out_col`` is replaced. The vocabulary is read on the
    driver and its pair table (a few MB, fixed by the vocabulary) is broadcast.
    """
    table = df.sparkSession.sparkContext.broadcast(PairTable.read(vocabulary))
    rest = [c for c in df.columns if c not in (text_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = regex.compile(pattern).findall, WordIds(table.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                offsets, flat = known.of_texts([find(t) if t else [] for t in b.column("__text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*rest, out_col])

    schema = df.select(*rest).schema.add(out_col, T.ArrayType(T.IntegerType()))
    return df.select(*rest, F.col(text_col).alias("__text")).mapInArrow(run, schema)
