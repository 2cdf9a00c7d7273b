"""Vectors of integers: floor(scale * x) of each component, packed in as few bytes as they need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Components beyond this are taken as this; doubles of that size have no fraction anyway.
MOST = 1 << 53
LONGEST = (1 << 63) - 1


def packed(rows: np.ndarray) -> list[bytes]:
    """The rows of an int64 matrix as little-endian integers of 2, 4 or 8 bytes, whichever all of a row fit in."""
    if not len(rows):
        return []
    top = np.maximum(rows.max(axis=1), -1 - rows.min(axis=1))
    width = np.where(top < 1 << 15, 2, np.where(top < 1 << 31, 4, 8))
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        for at, row in zip(np.flatnonzero(width == w).tolist(), rows[width == w].astype(f"<i{w}")):
            out[at] = row.tobytes()
    return out


def unpacked(raw: list[bytes], dims: int) -> np.ndarray:
    """What packed() made, as an int64 matrix."""
    width = np.array([len(r) // dims for r in raw], np.int64)
    out = np.empty((len(raw), dims), np.int64)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at.tolist()), f"<i{w}").reshape(-1, dims)
    return out


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, as int64: in doubles where every sum is below 2**53, else in
    integers of any size; what is beyond a long becomes the largest or the smallest long."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return np.clip(x.astype(object) @ y.astype(object).T, -LONGEST - 1, LONGEST).astype(np.int64)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, flag=None) -> DataFrame:
    """(id, flag, dims, vec) of the vectors that take part: those with an id that aren't null or
    empty and hold no null or non-finite component. flag: a boolean column over vectors, null as false."""

    def run(batches):
        for batch in slices(batches, 4096):
            column = batch.column(2).cast(pa.large_list(pa.float64()))
            flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
            ends = column.offsets.to_numpy()
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), 0)
            kept, vec = [], []
            for dims in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dims)
                x = flat[ends[rows][:, None] + np.arange(dims)]
                good = np.isfinite(x).all(axis=1)
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x[good] * scale), -MOST, MOST).astype(np.int64)
                kept += rows[good].tolist()
                vec += packed(x)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lengths[kept], pa.int32()), pa.array(vec, pa.binary())], ["id", "flag", "dims", "vec"])

    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), flag.alias("flag"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.where("id is not null and v is not null").mapInArrow(run, "id long, flag boolean, dims int, vec binary")
