"""Boosted regression trees for many groups (horizons, folds) at once, from histograms summed in tasks.

Features are cut into bins at their quantiles. A level of a tree is one job for
all groups and heads: tasks add up, for each node, feature and bin, the gradients
of their rows, Spark adds those up, and the driver picks the best cut of each
node. The point head fits squared errors; leaves of a quantile head are that
quantile of their residuals, so its loss is the pinball loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, monotone_quantiles, quantile_name
from .heads import MOST_GROUPS

#: Bins of the residuals, from which a leaf's quantile is read.
RESIDUAL_BINS = 512


@dataclass
class Forest:
    """Trees of all groups and heads: cuts[group, head, tree, node] = (feature, bin), leaves[group, head, tree, leaf]."""

    base: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    trees: int = 0
    by: list = field(default_factory=list)

    def place(self, codes: np.ndarray, g: int, h: int, tree: int, levels: int) -> np.ndarray:
        """The node of each row on a level, from 0."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for level in range(levels):
            feature, cut = self.cuts[g, h, tree, (1 << level) - 1 + node].T
            node = 2 * node + (codes[rows, feature] > cut)
        return node

    def value(self, codes: np.ndarray, g: int, h: int) -> np.ndarray:
        """The head's forecast."""
        depth = self.leaves.shape[3].bit_length() - 1
        out = np.full(len(codes), self.base[g, h])
        for tree in range(self.trees):
            out += self.leaves[g, h, tree, self.place(codes, g, h, tree, depth)]
        return out


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _added(parts: DataFrame, tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """{(group, head): sum of the arrays} of rows (g, h, v) that tasks made, added up in two steps where they are many."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.float64) for v in pdf["v"])
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "h": pdf["h"].iloc[:1], "v": [total.tobytes()]})

    if tasks > 64:
        salted = parts.withColumn("s", F.spark_partition_id() % int(tasks**0.5))
        parts = salted.groupBy("g", "h", "s").applyInPandas(add, "g int, h int, v binary")
    return {(r.g, r.h): np.frombuffer(r.v, np.float64) for r in parts.groupBy("g", "h").applyInPandas(add, "g int, h int, v binary").collect()}


def _best_cuts(sums: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, means of the two sides) of each node, of sums[node, feature, bin, (gradient, weight)]; a node
    that no cut improves keeps its rows on the left."""
    left = sums.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: np.where(s[..., 1] > 0, s[..., 0] ** 2 / np.maximum(s[..., 1], 1e-300), 0.0)
    gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), -1.0)
    flat = gain.reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    feature, cut = np.divmod(best, sums.shape[2])
    none = flat[np.arange(len(sums)), best] <= 1e-12
    feature, cut = np.where(none, 0, feature), np.where(none, sums.shape[2] - 1, cut)
    mean = lambda s: s[..., 0] / np.maximum(s[..., 1], 1e-300)
    at = (np.arange(len(sums)), feature, cut)
    return feature, cut, np.stack([mean(left[at]), mean(right[at])], axis=1)


def _leaf_quantile(counts: np.ndarray, lo: float, hi: float, q: float) -> float:
    """The q quantile of binned residuals, linear within its bin."""
    upto = counts.cumsum()
    if upto[-1] <= 0:
        return 0.0
    k = int(np.searchsorted(upto, q * upto[-1], "left"))
    before = upto[k] - counts[k]
    return lo + (k + (q * upto[-1] - before) / counts[k]) * (hi - lo) / len(counts)


def fit_trees(rows: DataFrame, by: list[str], features: list[str], target: str, quantiles: tuple = (), trees: int = 16, depth: int = 3, bins: int = 32, rate: float = 0.25, weight: str | None = None, least: float = 20.0) -> dict:
    """A model for `predict_trees`: for each group of `by` a point head and one for each quantile.

    A cut leaves rows of a weight of `least` or more on either side. Rows with a NULL in any column don't count;
    no rows are an error, and so are more than MOST_GROUPS groups. A tree takes depth jobs, and one more for
    quantiles; what a task sends is its sums, whatever its rows.
    """
    spark, n_features, heads = rows.sparkSession, len(features), [None, *quantiles]
    known = rows.dropna(subset=[*by, *features, target, *([weight] if weight else [])])
    keys = sorted(known.select(*by).distinct().limit(MOST_GROUPS + 1).collect())
    if not keys or len(keys) > MOST_GROUPS:
        raise ValueError("no row to fit" if not keys else "too many groups")
    ids = spark.createDataFrame([(*k, g) for g, k in enumerate(keys)], rows.select(*by).schema.add("__g", "integer"))
    shares = [k / bins for k in range(1, bins)]
    cut_at = known.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    edges = [np.unique(np.array(e, float)) for e in cut_at]
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    c = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("c")

    def code(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in _codes(raw, edges)], pa.binary()), b.column(2), b.column(3)], ["g", "x", "y", "c"])

    picked = known.join(F.broadcast(ids), by).select(F.col("__g").alias("g"), x, F.col(target).cast("double").alias("y"), c)
    data = picked.mapInArrow(code, "g int, x binary, y double, c double").persist()
    try:
        ends = data.agg(F.min("y"), F.max("y")).first()
        span = float(ends[1] - ends[0]) or 1.0
        forest = Forest(np.zeros((len(keys), len(heads))), np.zeros((len(keys), len(heads), trees, (1 << depth) - 1, 2), np.int64), np.zeros((len(keys), len(heads), trees, 1 << depth)), by=by)
        tasks = data.rdd.getNumPartitions()

        def sums(state: Forest, tree: int, level: int, residuals: bool):
            """A task's sums for each group and head: gradients by node, feature and bin, or residuals by leaf and bin."""
            nodes = 1 << level
            shape = (nodes, RESIDUAL_BINS) if residuals else (nodes, n_features, bins, 2)

            def run(batches: Iterator[pa.RecordBatch]):
                total: dict[tuple[int, int], np.ndarray] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    g, y, c = (b.column(n).to_numpy(zero_copy_only=False) for n in ("g", "y", "c"))
                    codes = np.frombuffer(b"".join(b.column("x").to_pylist()), np.uint8).reshape(-1, n_features)
                    for k in np.unique(g).tolist():
                        own = np.flatnonzero(g == k)
                        cs, ys, ws = codes[own], y[own], c[own]
                        for h, q in enumerate(heads):
                            if residuals and q is None:
                                continue
                            r = ys - state.value(cs, k, h)
                            node = state.place(cs, k, h, tree, level) if level else np.zeros(len(own), np.int64)
                            out = total.setdefault((k, h), np.zeros(shape))
                            if residuals:
                                at = np.clip((r + span) / (2 * span) * RESIDUAL_BINS, 0, RESIDUAL_BINS - 1).astype(np.int64)
                                out += np.bincount(node * RESIDUAL_BINS + at, ws, out.size).reshape(shape)
                                continue
                            slope = ws * (r if q is None else q - (r < 0))
                            for f in range(n_features):
                                at = node * bins + cs[:, f]
                                out[:, f, :, 0] += np.bincount(at, slope, nodes * bins).reshape(nodes, bins)
                                out[:, f, :, 1] += np.bincount(at, ws, nodes * bins).reshape(nodes, bins)
                at = list(total)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([h for _, h in at], pa.int32()), pa.array([total[k].tobytes() for k in at], pa.binary())], ["g", "h", "v"])

            return {k: v.reshape(shape) for k, v in _added(data.mapInArrow(run, "g int, h int, v binary"), tasks).items()}

        first = {(r.g): r.m for r in data.groupBy("g").agg((F.sum(F.col("y") * F.col("c")) / F.sum("c")).alias("m")).collect()}
        for g in range(len(keys)):
            forest.base[g, :] = first.get(g) or 0.0
        if quantiles:
            for (g, h), counts in sums(forest, 0, 0, True).items():
                forest.base[g, h] += _leaf_quantile(counts[0], -span, span, heads[h])
        for tree in range(trees):
            for level in range(depth):
                for (g, h), total in sums(forest, tree, level, False).items():
                    feature, cut, means = _best_cuts(total, least)
                    at = slice((1 << level) - 1, (2 << level) - 1)
                    forest.cuts[g, h, tree, at] = np.stack([feature, cut], axis=1)
                    if level == depth - 1 and heads[h] is None:
                        forest.leaves[g, h, tree] = rate * means.ravel()
            if quantiles:
                for (g, h), counts in sums(forest, tree, depth, True).items():
                    forest.leaves[g, h, tree] = [rate * _leaf_quantile(n, -span, span, heads[h]) for n in counts]
            forest.trees = tree + 1
    finally:
        data.unpersist()
    return {"by": by, "features": features, "quantiles": quantiles, "keys": ids, "edges": edges, "forest": forest}


def predict_trees(model: dict, rows: DataFrame) -> DataFrame:
    """rows of known groups with point and the quantiles in [0, 1], the latter in order; NULL where a feature is NULL."""
    shared = rows.sparkSession.sparkContext.broadcast((model["forest"], model["edges"]))
    heads = 1 + len(model["quantiles"])

    @F.pandas_udf("array<double>")
    def run(g: pd.Series, x: pd.Series) -> pd.Series:
        forest, edges = shared.value
        out = np.zeros((len(g), heads))
        if len(g):
            codes, group = _codes(np.stack(x.to_numpy()).astype(float), edges), g.to_numpy()
            for k in np.unique(group).tolist():
                own = np.flatnonzero(group == k)
                for h in range(heads):
                    out[own, h] = forest.value(codes[own], k, h)
        return pd.Series(list(out))

    whole = F.greatest(*[F.col(f).isNull() for f in model["features"]], F.lit(False))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in model["features"]])
    out = rows.join(F.broadcast(model["keys"]), model["by"]).withColumn("__v", F.when(~whole, run("__g", x))).drop("__g")
    out = out.withColumn("point", clip(F.get("__v", 0), 0, 1))
    if model["quantiles"]:
        ordered = monotone_quantiles(F.slice("__v", 2, heads - 1))
        out = out.withColumn("__q", F.when(F.col("__v").isNotNull(), ordered)).withColumns({quantile_name(q): F.get("__q", i) for i, q in enumerate(model["quantiles"])}).drop("__q")
    return out.drop("__v")
