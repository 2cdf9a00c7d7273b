"""The certified quantile fit against all vertices of small problems."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import certified


def least_loss(x, y, w, q):
    """The pinball loss is least on a line through as many rows as there are coefficients."""
    design, best = np.column_stack([np.ones(len(x)), x]), np.inf
    for rows in combinations(range(len(y)), design.shape[1]):
        a = design[list(rows)]
        if abs(np.linalg.det(a)) > 1e-9:
            r = y - design @ np.linalg.solve(a, y[list(rows)])
            best = min(best, (w * r * (q - (r < -1e-12))).sum())
    return best


@pytest.mark.parametrize("q", [0.5, 0.99])
def test_the_loss_is_the_least_and_the_gap_says_so(spark, q):
    rng = np.random.default_rng(int(100 * q))
    groups = {g: (rng.uniform(-1, 1, (25, 2)), rng.normal(0, 1, 25) * 10.0**g, rng.choice([0.5, 1.0, 2.0], 25)) for g in (-3, 0, 2)}
    rows = spark.createDataFrame([(g, float(a), float(b), float(t), float(c)) for g, (x, y, w) in groups.items() for (a, b), t, c in zip(x, y, w)], "g long, a double, b double, y double, w double")
    got = {r.g: r for r in certified.fit_certified(rows, ["g"], ["a", "b"], "y", q, weight="w").collect()}
    for g, (x, y, w) in groups.items():
        best, r = least_loss(x, y, w, q), got[g]
        assert r.gap <= 1e-6 * r.loss and best - 1e-9 * best <= r.loss <= best * (1 + 1e-6)
        e = y - np.column_stack([np.ones(len(x)), x]) @ np.array(r.coefficients)
        assert (w * e * (q - (e < 0))).sum() == pytest.approx(r.loss)


def test_a_gap_that_was_not_reached_is_told(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(1, float(a), float(a + rng.normal())) for a in rng.uniform(0, 1, 200)], "g long, a double, y double")
    few, many = (certified.fit_certified(rows, ["g"], ["a"], "y", 0.9, steps=s).first() for s in (3, 80))
    assert few.gap > 1e-6 * few.loss and many.gap <= 1e-6 * many.loss
    assert few.loss - few.gap <= many.loss <= few.loss  # the certificate holds whenever it is made


def test_rows_on_a_line_and_no_rows(spark):
    rows = spark.createDataFrame([(1, k / 10, 2 + 3 * k / 10) for k in range(11)] + [(1, None, 9.0)], "g long, a double, y double")
    r = certified.fit_certified(rows, ["g"], ["a"], "y", 0.9).first()
    assert r.loss == pytest.approx(0, abs=1e-7) and r.coefficients == pytest.approx([2, 3], abs=1e-5)
    with pytest.raises(ValueError):
        certified.fit_certified(rows.where(F.col("a") > 99), ["g"], ["a"], "y", 0.9)
