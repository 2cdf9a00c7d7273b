"""Operators that cut series in stretches against plain loops over whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from heliogrid.operators import catalog, joins, satellite


@pytest.mark.parametrize("tolerance", [0, 3])
def test_asof_over_many_stretches(spark, tolerance):
    rng = random.Random(tolerance)
    left = [(s, t, t - rng.choice([0, 0, 2])) for s in "ab" for t in range(0, 200)]
    right = [(s, rng.randrange(-5, 210), float(rng.randrange(9))) for s in "ab" for _ in range(60)] + [("a", None, 1.0)]
    l, r = spark.createDataFrame(left, "site string, t long, cut long"), spark.createDataFrame(right, "site string, t long, v double")
    got = {(x.site, x.t): (x.matched_ts, x.v, x.missing) for x in joins.asof_backward(l, r, "site", "t", ["v"], tolerance, "cut").collect()}
    for s, t, cut in left:
        best = max(((u, v) for q, u, v in right if q == s and u is not None and u <= min(t, cut)), default=None)
        near = best is not None and t - best[0] <= tolerance
        assert got[s, t] == ((*best, 0) if near else (None, None, 1))
    assert len(got) == len(left)


def test_inventory_digest_depends_on_lines_alone(spark):
    rows = [("g", i, f"n{i}") for i in range(50)]
    digest = lambda data: catalog.inventory_hash(spark.createDataFrame(data, "g string, size long, name string"), ["g"], ["name", "size"]).first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[1:]) and digest(rows) != digest([*rows, rows[0]])


def test_site_features_keeps_failures(spark):
    pixels = [float(k) for k in range(8)]  # 2 channels of 2 x 2
    grid = [0.0, 0.0, 1.0, 1.0], [0.0, 1.0, 0.0, 1.0]
    rows = [(1, "2024-01-01T00:00:00Z", pixels, *grid, 0.9, 0.2), (2, "2024-01-01T00:00:00+02:00", pixels, *grid, 0.9, 0.2), (3, "2024-01-01T00:00:00+00:00", pixels[:7], *grid, 0.9, 0.2), (4, None, pixels, *grid, 0.9, 0.2), (5, "2024-01-01T00:00:00Z", pixels, *grid, None, None), (6, "2024-01-01T00:00:00Z", None, *grid, 0.9, 0.2)]
    p = spark.createDataFrame(rows, "product_id long, ts string, pixels array<double>, lats array<double>, lons array<double>, lat double, lon double")
    got = {r.product_id: r for r in satellite.site_features(p, 2, 2, 2, 1, (0, 1), (1, 2)).collect()}
    assert [got[k].status for k in range(1, 7)] == ["ok", "failed", "failed", "failed", "ok", "failed"]
    assert [got[k].reason for k in range(1, 7)] == [None, "time is not UTC", "wrong shape", "time is not UTC", None, "wrong shape"]
    assert (got[1].pixel, got[1].mean_0, got[1].mean_1) == (2, 2.0, 6.0) and (got[5].pixel, got[5].mean_0) == (3, 3.0)
    assert got[2].mean_0 is None and got[1].provenance.variant == "physical"
    with pytest.raises(ValueError):
        satellite.site_features(p, 2, 2, 2, 1, (0, 1), (1, 2), "other")


def test_exact_runs(spark):
    v = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 0, 12, 3.0), ("a", 6, 8, 4.0), ("a", 12, 13, 5.0)], "site_id string, issue long, target long, value double")
    got = joins.exact_run(v, ["site_id"], 12).orderBy("target").select("target", "issue", F.col("value")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 2.0), (12, 0, 3.0), (13, 12, 5.0)]


@pytest.mark.parametrize("dates", [False, True])
def test_many_folds_meet_rows_on_buckets(spark, dates):
    rng = random.Random(5)
    folds = [(f, p, a, a + rng.choice([0, 3, 40])) for f in range(30) for p in ("train", "test") for a in [rng.randrange(-50, 300)]]
    rows = [(k, rng.randrange(-60, 400)) for k in range(300)] + [(999, None)]
    r, f = spark.createDataFrame(rows, "k long, t long"), spark.createDataFrame(folds, "fold long, part string, start long, end long")
    if dates:
        day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), F.col(c).cast("int"))
        r, f = r.withColumn("t", F.timestamp_seconds(F.unix_seconds(day("t").cast("timestamp")) + 3600)), f.withColumns({"start": day("start"), "end": day("end")})
    want = {(k, f, p) for k, t in rows if t is not None for f, p, a, b in folds if a <= t < b}
    for most in (1000, 5):
        got = [(x.k, x.fold, x.part) for x in joins.assign_folds(r, f, "t", most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
