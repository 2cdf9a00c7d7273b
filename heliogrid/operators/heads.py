"""Linear heads for many groups (horizons, folds) at once: least squares and quantiles, fitted in one pass a step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.columns import QUANTILES

#: Groups whose coefficients the driver holds and broadcasts; more are an error.
MOST_GROUPS = 10_000


def _partials(width: int, betas: np.ndarray, eps: float, first: bool):
    """Sums of the normal equations of every head over a task's rows, one row of them for each group."""
    heads = betas.shape[1]
    length = heads * width * (width + 1) + width

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, y, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "y", "c"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for g in np.unique(group):
                own = group == g
                xs, ys, cs = x[own], y[own], c[own]
                out = total.setdefault(int(g), np.zeros(length))
                for h in range(heads):
                    w = cs if first else cs / (eps + np.abs(ys - xs @ betas[g, h]))
                    at = h * width * (width + 1)
                    out[at : at + width * width] += ((xs.T * w) @ xs).ravel()
                    out[at + width * width : at + width * (width + 1)] += xs.T @ (w * ys)
                out[-width:] += xs.T @ cs
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(total), pa.int64()), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    return run


def fit_heads(rows: DataFrame, by: list[str], features: list[str], target: str, quantiles: tuple = QUANTILES, steps: int = 20, weight: str | None = None) -> DataFrame:
    """(by, point, heads): for each group the coefficients [intercept, features...] of a least-squares point
    head, and of a linear head for each quantile (majorise-minimise).

    A step is one job for all groups and heads. Tasks reduce their rows to sums, Spark adds those up, and
    the driver solves systems of a few columns. Rows with a NULL in any column don't count; no rows are an
    error, and so are more than MOST_GROUPS groups.
    """
    spark, width, count = rows.sparkSession, len(features) + 1, len(quantiles)
    known = rows.dropna(subset=[*by, *features, target, *([weight] if weight else [])])
    keys = known.select(*by).distinct().limit(MOST_GROUPS + 1).collect()
    if not keys or len(keys) > MOST_GROUPS:
        raise ValueError("no row to fit" if not keys else "too many groups")
    ids = spark.createDataFrame([(*k, g) for g, k in enumerate(keys)], rows.select(*by).schema.add("__g", "long"))
    y, c = F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c")
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x")
    data = known.join(F.broadcast(ids), by).select(F.col("__g").alias("g"), x, y, c).persist()
    betas, eps = np.zeros((len(keys), 1, width)), 1e-2
    point = None
    try:
        for step in range(max(steps, 1) if count else 1):
            part = data.mapInArrow(_partials(width, betas, eps, step == 0), "g long, v array<double>")
            sums = part.select("g", F.posexplode("v").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v")).toArrow()
            g, k, v = (sums.column(n).to_numpy() for n in ("g", "k", "v"))
            heads = betas.shape[1]
            total = np.zeros((len(keys), heads * width * (width + 1) + width))
            total[g, k] = v
            each = total[:, :-width].reshape(len(keys), heads, width * (width + 1))
            a = each[:, :, : width * width].reshape(len(keys), heads, width, width)
            b = each[:, :, width * width :]
            ridge = 1e-9 * (np.trace(a, axis1=2, axis2=3)[:, :, None, None] / width + 1e-12) * np.eye(width)
            if step == 0:
                point = np.linalg.solve(a + ridge, b[..., None])[..., 0][:, 0]
                betas = np.repeat(point[:, None, :], max(count, 1), axis=1)
                continue
            slope = (2 * np.array(quantiles) - 1)[None, :, None] * total[:, None, -width:]
            betas = np.linalg.solve(a + ridge, (b + slope)[..., None])[..., 0]
            eps = max(1e-4, eps * 0.8)
    finally:
        data.unpersist()
    table = [(*key, point[i].tolist(), [h.tolist() for h in betas[i][:count]]) for i, key in enumerate(keys)]
    numbers = ArrayType(DoubleType())
    return spark.createDataFrame(table, rows.select(*by).schema.add("point", numbers).add("heads", ArrayType(numbers)))


def dot(coefficients: Column, features: list[str]) -> Column:
    """The value of a head whose coefficients are an array column."""
    return sum((F.get(coefficients, i + 1) * F.col(f) for i, f in enumerate(features)), F.get(coefficients, 0))
