"""Boosted trees against a plain loop, and what they are for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import trees


def plain_boost(x, y, w, edges, n_trees, depth, bins, rate, least):
    """Squared-error boosting, one node at a time."""
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    pred = np.full(len(y), (w * y).sum() / w.sum())

    def grow(rows, r, level):
        if level == depth:
            return {"leaf": (w[rows] * r[rows]).sum() / w[rows].sum() if w[rows].sum() else 0.0}
        best = (1e-12, 0, bins - 1)
        score = lambda k: (w[k] * r[k]).sum() ** 2 / w[k].sum()
        for f in range(x.shape[1]):
            for cut in range(bins):
                a, b = rows[codes[rows, f] <= cut], rows[codes[rows, f] > cut]
                if w[a].sum() >= least and w[b].sum() >= least:
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] * (1 + 1e-9) + 1e-15:
                        best = (gain, f, cut)
        _, f, cut = best
        return {"f": f, "cut": cut, "sides": [grow(rows[codes[rows, f] <= cut], r, level + 1), grow(rows[codes[rows, f] > cut], r, level + 1)]}

    def value(t, c):
        while "leaf" not in t:
            t = t["sides"][int(c[t["f"]] > t["cut"])]
        return t["leaf"]

    for _ in range(n_trees):
        t = grow(np.arange(len(y)), y - pred, 0)
        pred = pred + rate * np.array([value(t, c) for c in codes])
    return pred


def frame(spark, groups):
    return spark.createDataFrame([(g, float(a), float(b), float(t), float(c)) for g, (x, y, w) in groups.items() for (a, b), t, c in zip(x, y, w)], "h long, a double, b double, y double, w double")


def test_trees_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for g in (1, 4):
        x = rng.uniform(0, 1, (250, 2))
        y = np.clip(0.3 * (x[:, 0] > 0.4) + 0.2 * g / 4 * (x[:, 1] > 0.7) * (x[:, 0] > 0.4) + rng.normal(0, 0.05, 250) + 0.2, 0, 1)
        groups[g] = x, y, rng.choice([0.5, 1.0], 250)
    rows = frame(spark, groups)
    model = trees.fit_trees(rows, ["h"], ["a", "b"], "y", trees=4, depth=2, bins=8, rate=0.5, weight="w", least=10)
    got = {(r.h, r.a, r.b): r.point for r in trees.predict_trees(model, rows).collect()}
    for g, (x, y, w) in groups.items():
        want = np.clip(plain_boost(x, y, w, model["edges"], 4, 2, 8, 0.5, 10), 0, 1)
        assert [got[g, float(a), float(b)] for a, b in x] == pytest.approx(want.tolist(), abs=1e-9)


def test_quantile_leaves_cover_their_share_where_lines_can_not(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (3000, 2))
    y = np.where(np.abs(x[:, 0] - 0.5) < 0.2, 0.6, 0.2) + rng.uniform(-0.1, 0.1, 3000)
    rows = frame(spark, {1: (x, y, np.ones(3000))})
    model = trees.fit_trees(rows, ["h"], ["a", "b"], "y", (0.1, 0.5, 0.9), trees=16, depth=3, bins=32, rate=0.3)
    got = trees.predict_trees(model, rows).collect()
    for q, name in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90")):
        assert np.mean([r.y <= r[name] for r in got]) == pytest.approx(q, abs=0.04)
    assert all(r.q10 <= r.q50 <= r.q90 for r in got)
    assert np.mean([(r.point - r.y) ** 2 for r in got]) < 1.3 * 0.2**2 / 12
    width = np.mean([r.q90 - r.q10 for r in got])
    assert width < 0.25  # lines would need 0.4 and more


def test_trees_of_odd_rows(spark):
    one = frame(spark, {1: (np.array([[0.5, 0.5]]), np.array([0.3]), np.ones(1))})
    model = trees.fit_trees(one, ["h"], ["a", "b"], "y", (0.5,), trees=2)
    extra = one.unionByName(one.withColumns({"a": F.lit(None).cast("double"), "y": F.lit(9.0)})).unionByName(one.withColumn("h", F.lit(2).cast("long")))
    got = sorted((r.y, r.point, r.q50) for r in trees.predict_trees(model, extra).collect())
    assert got[0][1] == pytest.approx(0.3) and got[0][2] == pytest.approx(0.3, abs=0.01) and got[1] == (9.0, None, None) and len(got) == 2  # an unknown group has no row
    with pytest.raises(ValueError):
        trees.fit_trees(one.where("a > 9"), ["h"], ["a", "b"], "y")
