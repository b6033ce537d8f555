"""Vector columns as raw float32 bytes: validity, Arrow <-> numpy, exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runtime import latest_version


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list<float> column that are usable, and their values as float32.

    Usable: exactly ``dim`` entries, all finite and not null, not all zero.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(rows), dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)  # a null entry arrives as NaN
    return rows[ok], np.ascontiguousarray(x[ok])


def to_binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * 4
    offsets = np.arange(0, (len(x) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


def from_binary(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.float32, len(column) * dim, int(offsets[0])).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Directions in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that tiny and huge values neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def live_embeddings(df: DataFrame, *, id_col: str = "id", vec_col: str = "precomputed_vector", order: list[str], dim: int) -> DataFrame:
    """``(id string, vec binary)`` of the live rows whose vector is usable.

    The live row of an id is the greatest by ``order``; when its vector is unusable the id is
    left out, an older vector does not stand in.
    """
    live = latest_version(df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"), *order), "id", order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = usable(b.column("vec"), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), to_binary(x)], ["id", "vec"])

    return live.select("id", "vec").where(F.size("vec") == dim).mapInArrow(pack, "id string, vec binary")
