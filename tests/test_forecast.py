"""The pooled forecaster, its transfer and the baselines of folds against dense solvers and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import baselines, certified, forecast, heads


def test_heads_and_transfer_against_least_squares(spark):
    rng = np.random.default_rng(4)
    data = {}
    for g in (1, 2):
        x = rng.uniform(0, 1, (400, 2))
        data[g] = x, 0.1 * g + x @ [0.3, 0.2] + rng.normal(0, 0.02, 400)
    rows = spark.createDataFrame([(g, float(a), float(b), float(t), float(t) + 0.05 + 0.1 * float(a)) for g, (x, y) in data.items() for (a, b), t in zip(x, y)], "horizon long, a double, b double, y double, z double")
    model = forecast.fit_forecaster(rows, ["horizon"], ["a", "b"], "y", (0.1, 0.5, 0.9), 30, None)
    fitted = {r.horizon: r for r in model["heads"].collect()}
    got = forecast.predict(model, rows).collect()
    assert len(got) == 800 and all(0 <= r.q10 <= r.q50 <= r.q90 <= 1 for r in got)
    transfer = forecast.fit_transfer(model, rows, ["horizon"], ["a", "b"], "z", (), weight=None)
    residuals = {r.horizon: r.point for r in transfer["residual"]["heads"].collect()}
    for g, (x, y) in data.items():
        design = np.column_stack([np.ones(400), x])
        assert np.allclose(fitted[g].point, np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-5)
        for q, b in zip((0.1, 0.5, 0.9), fitted[g].heads):
            r = y - design @ b
            # the pinball loss is flat at its least: no direction of the design moves it by more than the few rows on the line
            assert np.all(np.abs(design.T @ (q - (r < 0))) <= 5)
        residual = 0.05 + 0.1 * x[:, 0] + y - design @ np.array(fitted[g].point)
        assert np.allclose(residuals[g], np.linalg.lstsq(design, residual, rcond=None)[0], atol=1e-5)
    scored = forecast.predict_transfer(transfer, rows).collect()
    assert np.mean([(r.point - r.z) ** 2 for r in scored]) < 0.001


def test_heads_without_rows(spark):
    rows = spark.createDataFrame([(1, None, 1.0)], "g long, a double, y double")
    with pytest.raises(ValueError):
        heads.fit_heads(rows, ["g"], ["a"], "y")


def test_horizon_rows_against_a_loop(spark):
    """Stretches change nothing, across many of their borders."""
    xs = {("s", t): math.sin(t) for t in range(400)} | {("t", t): math.cos(t) for t in range(20)}
    dense = spark.createDataFrame([(s, t, v, float(t % 7), 1.0) for (s, t), v in xs.items()], "site_id string, time_idx long, x double, k double, w double")
    rows, features = forecast.horizon_rows(dense, "site_id", "time_idx", "x", ["k"], [], "w", 3, 4)
    assert features == ["x", "x_lag_1", "x_lag_2", "k"]
    got = {(r.site_id, r.issue_idx, r.horizon): (r.target_idx, r.x, r.x_lag_1, r.x_lag_2, r.target, r.k) for r in rows.collect()}
    want = {(s, t, h): (t + h, v, xs[s, t - 1], xs[s, t - 2], xs[s, t + h], float((t + h) % 7)) for (s, t), v in xs.items() for h in range(1, 5) if (s, t - 2) in xs and (s, t + h) in xs}
    assert got == want


def test_last_days(spark):
    rows = spark.range(10).withColumnRenamed("id", "t")
    assert [r.t for r in forecast.last_days(rows, "t", 1, 3).where("valid").orderBy("t").collect()] == [7, 8, 9]


def test_validation_days(spark):
    rows = lambda days: spark.range(days * 4).withColumnRenamed("id", "t")
    assert [forecast.validation_days(rows(n), "t", per_day=4) for n in (0, 10, 30, 150, 400)] == [0, 2, 6, 30, 30]


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_fold_baselines(spark, version):
    rng = np.random.default_rng(1)
    history = [("s", t, float(rng.uniform(0.2, 0.8)), 0.5 + 0.01 * (t % 5), float(t % 3)) for t in range(60)]
    h = spark.createDataFrame(history, "site_id string, time_idx long, cf double, cs double, a double")
    train = h.where("time_idx < 20").withColumn("fold", F.lit(0).cast("long")).unionByName(h.where("time_idx < 40").withColumn("fold", F.lit(1).cast("long")))
    pairs = spark.createDataFrame([(f, "s", i, i + k, k) for f in (0, 1) for i in (41, 45, 58) for k in (1, 2)], "fold long, site_id string, issue_idx long, target_idx long, horizon long")
    out = baselines.fold_baselines(pairs, train, h, ["a"], version, q=0.5, steps=40).collect()
    legacy = "smart_persistence" if version == "v1" else "legacy_harmonic_smart_persistence"
    curves = {r.fold: r.coefficients for r in certified.fit_certified(train, ["fold"], ["a"], "cf", 0.5, steps=40).collect()}
    assert curves[0] != curves[1] and len(out) == 12
    hold = lambda v, top: min(max(v, 0.0), top)
    for r in out:
        if r.target_idx >= 60:
            assert r[legacy] is None
            continue
        (_, _, cf, cs, a), (_, _, _, later, b) = history[r.issue_idx], history[r.target_idx]
        curve = [hold(curves[r.fold][0] + curves[r.fold][1] * v, 1.0) for v in (a, b)]
        assert math.isclose(r[legacy], hold(hold(cf / curve[0], 2.0) * curve[1], 1.0), rel_tol=1e-9)
        if version == "v2":
            assert math.isclose(r.smart_persistence, hold(hold(cf / cs, 2.0) * later, 1.0), rel_tol=1e-9)
    with pytest.raises(ValueError):
        baselines.fold_baselines(pairs, train, h, ["a"], "v3")
