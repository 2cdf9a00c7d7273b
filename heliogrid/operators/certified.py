"""Linear quantile regression for many groups at once, with a proof of how near to the least loss it is.

The dual of the least pinball loss gives each row a slope between q - 1 and q such
that all slopes balance. A logarithmic barrier keeps slopes off their bounds; its
weight shrinks, and Newton steps along the path of its centres lead to the least
loss. Slopes at a step, moved a little so that they balance exactly, are a feasible
point of the dual, whose value no coefficients can get below. The difference to the
loss itself is the gap that is returned: a certificate, not a hope.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .heads import MOST_GROUPS

#: Shares of a Newton step that are tried in one job.
TRIED = np.array([1.0, 0.5, 0.2, 0.05, 0.01])
#: What the barrier's weight is multiplied by once a step is short.
CUT = 0.1


def _parts(width: int, points: np.ndarray, mu: np.ndarray, q: float):
    """A task's sums for each group at each point: the loss with its barrier, the loss, the sum of d*y, sums of x*d, of
    w*x*y and of w*x*x', where d is a row's slope and w how fast it changes with the row's residual (times the weight mu)."""
    length = 3 + 2 * width + width * width

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, y, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "y", "c"))
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for g in np.unique(group).tolist():
                own = group == g
                xs, ys, cs = x[own], y[own], c[own]
                out = total.setdefault(g, np.zeros((len(points[g]), length)))
                for k, beta in enumerate(points[g]):
                    r = ys - xs @ beta
                    rho = r / mu[g]
                    root = np.sqrt(rho * rho + 4)
                    below, above = 2 / (2 + rho + root), 2 / (2 - rho + root)  # their sum is 1; a term that cancels is far below the other
                    below, above = np.where(rho >= 0, below, 1 - above), np.where(rho >= 0, 1 - below, above)
                    d, w = cs * (q - below), cs / (1 / below**2 + 1 / above**2)
                    wx = xs * w[:, None]
                    out[k, 0] += (d * r + mu[g] * cs * (np.log(below) + np.log(above))).sum()
                    out[k, 1] += (cs * r * (q - (r < 0))).sum()
                    out[k, 2] += d @ ys
                    out[k, 3 : 3 + width] += xs.T @ d
                    out[k, 3 + width : 3 + 2 * width] += wx.T @ ys
                    out[k, 3 + 2 * width :] += (wx.T @ xs).ravel()
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(total), pa.int64()), "v": pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))})

    return run


def _grams(width: int):
    """A task's sums of c*x*x' for each group."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                group, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "c"))
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for g in np.unique(group).tolist():
                    xs = x[group == g]
                    total[g] = total.get(g, 0) + (xs.T * c[group == g]) @ xs
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(total), pa.int64()), "v": pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))})

    return run


def _rotated(width: int, turns: np.ndarray):
    """Rows with x in columns that are uncorrelated and of one size, of which nearly dependent ones are 0, and its norm."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            group = batch.column("g").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = np.einsum("ij,ijk->ik", x, turns[group]) if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(out.tolist(), pa.list_(pa.float64())), batch.column("y"), batch.column("c"), pa.array(np.sqrt((out**2).sum(axis=1)))], ["g", "x", "y", "c", "norm"])

    return run


def _added(parts: DataFrame, groups: int, length: int) -> np.ndarray:
    """Sums of the arrays of rows (g, v), a row for each group."""
    sums = parts.select("g", F.posexplode("v").alias("k", "v")).groupBy("g", "k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((groups, length))
    total[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    return total


def fit_certified(rows: DataFrame, by: list[str], features: list[str], target: str, q: float, gap: float = 1e-6, steps: int = 80, weight: str | None = None) -> DataFrame:
    """(by, coefficients, loss, gap): for each group the coefficients [intercept, features...] of the q quantile, its
    pinball loss, and how far at most that is above the least one.

    Ends when every group's gap is within `gap` of its loss (or of 1e-12 a row), or after `steps` jobs, with the gap that
    was reached. The best coefficients seen are kept. Rows with a NULL in any column, or no weight, don't count; no rows are an error, and so
    are more than MOST_GROUPS groups. A job sends a few hundred sums a group and task, whatever the rows.
    """
    spark, width = rows.sparkSession, len(features) + 1
    known = rows.dropna(subset=[*by, *features, target, *([weight] if weight else [])])
    keys = known.select(*by).distinct().limit(MOST_GROUPS + 1).collect()
    if not keys or len(keys) > MOST_GROUPS:
        raise ValueError("no row to fit" if not keys else "too many groups")
    ids = spark.createDataFrame([(*k, g) for g, k in enumerate(keys)], rows.select(*by).schema.add("__g", "long"))
    y, c = F.col(target).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c")
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features]).alias("x")
    raw = known.join(F.broadcast(ids), by).select(F.col("__g").alias("g"), x, y, c).where("c > 0").persist()
    turns = np.zeros((len(keys), width, width))
    data = raw.mapInArrow(_rotated(width, turns), "g long, x array<double>, y double, c double, norm double")
    try:
        for g, gram in enumerate(_added(raw.mapInArrow(_grams(width), "g long, v array<double>"), len(keys), width * width)):
            size, axes = np.linalg.eigh(gram.reshape(width, width) / max(gram[0], 1e-300))
            turns[g] = axes * np.where(size > 1e-12 * size.max(), 1 / np.sqrt(np.maximum(size, 1e-300)), 0.0)
        data = raw.mapInArrow(_rotated(width, turns), "g long, x array<double>, y double, c double, norm double").persist()
        each = data.groupBy("g").agg(F.sum("c").alias("n"), F.max("norm").alias("norm"), F.max("y").alias("hi"), F.min("y").alias("lo"), *[F.sum(F.col("c") * F.col("y") * F.get("x", k)).alias(f"s{k}") for k in range(width)]).collect()
        n, norms, spans, start = np.ones(len(keys)), np.ones(len(keys)), np.ones(len(keys)), np.zeros((len(keys), width))
        for r in each:
            n[r.g], norms[r.g], spans[r.g], start[r.g] = r.n, r.norm, max(r.hi - r.lo, 1e-12), [r[f"s{k}"] / r.n for k in range(width)]  # least squares
        mu, points = 0.1 * spans, start[:, None, :]
        best_loss, best_dual, best = np.full(len(keys), np.inf), np.full(len(keys), -np.inf), start.copy()
        for _ in range(steps):
            part = data.mapInArrow(_parts(width, points, mu, q), "g long, v array<double>")
            total = _added(part, len(keys), points.shape[1] * (3 + 2 * width + width * width))
            total = total.reshape(len(keys), points.shape[1], -1)
            nxt = np.empty((len(keys), len(TRIED), width))
            for g in range(len(keys)):
                lowest = int(total[g, :, 1].argmin())
                if total[g, lowest, 1] < best_loss[g]:
                    best_loss[g], best[g] = total[g, lowest, 1], points[g, lowest]
                k = int(total[g, :, 0].argmin())
                dy, xd, wxy, wxx = total[g, k, 2], total[g, k, 3 : 3 + width], total[g, k, 3 + width : 3 + 2 * width], total[g, k, 3 + 2 * width :].reshape(width, width)
                ridge = 1e-13 * np.trace(wxx) / width * np.eye(width)
                v = np.linalg.lstsq(wxx + ridge, xd, rcond=None)[0]
                # d - w * (x @ v) balances, and stays within its bounds as w is below the distance to either
                if np.linalg.norm(v) * norms[g] <= 1 and np.abs(xd - wxx @ v).max() <= 1e-9 * n[g] * norms[g]:
                    slack = np.abs(xd - wxx @ v) @ np.abs(best[g])
                    best_dual[g] = max(best_dual[g], dy - v @ wxy - slack)
                step = mu[g] * v
                if np.linalg.norm(v) * norms[g] <= 0.5:  # near the centre: go on along the path of centres
                    path = np.linalg.lstsq(wxx + ridge, wxy - wxx @ points[g, k], rcond=None)[0]
                    step = step + (1 - CUT) * path
                    mu[g] = max(CUT * mu[g], 1e-14 * spans[g])
                nxt[g] = points[g, k] + TRIED[:, None] * step
            if (best_loss - best_dual <= np.maximum(gap * best_loss, 1e-12 * n * spans)).all():
                break
            points = nxt
    finally:
        data.unpersist()
        raw.unpersist()
    table = [(*key, (turns[g] @ best[g]).tolist(), float(best_loss[g]), float(max(best_loss[g] - best_dual[g], 0.0))) for g, key in enumerate(keys)]
    return spark.createDataFrame(table, rows.select(*by).schema.add("coefficients", ArrayType(DoubleType())).add("loss", "double").add("gap", "double"))
