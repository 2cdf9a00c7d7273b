"""Golden values of small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heliogrid.functions import columns as fx
from heliogrid.operators import baselines, catalog, checks, forecast, grid, joins, metrics, satellite, weather, windows
from heliogrid.sources import io


def one(df):
    return [tuple(r) for r in df.collect()]


def ts(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias("ts"))


def test_canonical_grid(spark):
    o = spark.createDataFrame([("s", 100, 0.0, "a"), ("s", 102, 0.25, "b"), ("n", 7, -1.0, "c")], "site_id string, time_idx long, energy_mwh double, quality_status string")
    s = spark.createDataFrame([("s", 1.0), ("n", 2.0)], "site_id string, capacity_mw double")
    g = grid.canonical_grid(o, s)
    rows = {(r.site_id, r.time_idx): r for r in g.collect()}
    assert [rows["s", k].observation_available for k in (100, 101, 102)] == [True, False, True]
    assert rows["s", 101].capacity_factor is None and rows["s", 102].capacity_factor == 1.0
    assert rows["n", 7].energy_mwh is None and rows["n", 7].quality_status == "missing"
    m = {r.site_id: r for r in grid.manifest(g).collect()}
    assert m["s"].gaps == 1 and m[None].rows == 4
    assert grid.canonical_grid(o.limit(0), s).count() == 0


def test_capacity_factor(spark):
    df = spark.createDataFrame([(0.0, 2.0), (0.5, 2.0)], "e double, c double")
    assert [r[0] for r in df.select(fx.capacity_factor("e", "c")).collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="capacity must be positive"):
        df.select(fx.capacity_factor("e", F.col("c") - 2)).collect()


def test_local_to_utc(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:00", 0), ("2025-10-26 03:00:00", 0), ("2025-10-26 03:00:00", 1), ("2025-03-30 04:00:00", 0), ("2025-03-30 02:45:00", 0)], "t string, n int")
    out = df.select(F.date_format(fx.local_to_utc(F.col("t").cast("timestamp"), F.lit("Europe/Helsinki"), "n"), "MM-dd HH:mm")).collect()
    assert [r[0] for r in out] == ["12-31 22:00", "10-26 00:00", "10-26 01:00", "03-30 01:00", "03-30 00:45"]


def test_sheets(spark):
    rows = [("Q4_25", 4, "2025-10-26 03:00:00", *[None] * 4, "0", "0"), ("Q4_25", 5, "2025-10-26 03:00:00", *[None] * 4, "0", "0"), ("Q4_25", 6, "03:00", *[None] * 4, "1", "1"), ("Q4_25", 1, "2025-10-26 03:00:00", *[None] * 4, "9", "9"), ("Q1_25", 3, "45658", "00.15.00-00.30.00", "1", None, None, None, None), ("Q1_25", 4, "45658", "00.30.00", None, None, None, None, None), ("Q2_25", 4, "45748.5", *[None] * 4, None, "2"), ("x", 4, "2025-10-26 03:00:00", *[None] * 4, "0", "0")]
    records, excluded = grid.parse_sheets(spark.createDataFrame(rows, "source_sheet string, source_row long, a string, b string, c string, d string, e string, f string, g string"), "Europe/Helsinki")
    got = {(r.source_sheet, r.source_row): str(r.timestamp_utc.isoformat()) for r in records.select("source_sheet", "source_row", F.col("timestamp_utc").cast("timestamp_ntz")).collect()}
    assert got == {("Q4_25", 4): "2025-10-26T00:00:00", ("Q4_25", 5): "2025-10-26T01:00:00", ("Q1_25", 3): "2024-12-31T22:15:00", ("Q2_25", 4): "2025-04-01T09:00:00"}
    assert one(excluded) == [("Q4_25", 6, "malformed_timestamp")]


def test_wide_and_metadata(spark):
    wide = spark.createDataFrame([(0, 0.0, 0.0), (1, 500.0, 250.0)], ["timestamp", "11", "12"])
    meta = grid.normalise_metadata(spark.createDataFrame([("11", 46.0, 14.0, 500.0), ("12", 46.5, 14.5, 250.0)], "alt_id string, lat double, lon double, Pinst_kW double"))
    long = grid.wide_to_long(wide, "timestamp").join(meta, "site_id").withColumn("cf", fx.capacity_factor("energy_mwh", "capacity_mw"))
    assert {r.site_id: r.top for r in long.groupBy("site_id").agg(F.max("cf").alias("top")).collect()} == {"11": 1.0, "12": 1.0}
    with pytest.raises(ValueError, match="kind"):
        grid.wide_to_long(wide, "timestamp", "furlongs")
    with pytest.raises(ValueError, match="metadata"):
        grid.normalise_metadata(meta.drop("lat"))


def test_sun(spark):
    df = ts(spark, "2025-06-21 10:00:00", "2025-06-21 23:00:00").withColumns({"lat": F.lit(61.64), "lon": F.lit(26.78)})
    azimuth, elevation = fx.solar_position("ts", "lat", "lon")
    noon, night = df.select(azimuth, elevation.alias("e"), fx.clear_sky_ghi(elevation).alias("g")).collect()
    assert 50 < noon.e < 52.5 and noon.g > 600 and night.g == 0 or night.e > 0
    assert len(fx.harmonics("ts")) == 8


@pytest.mark.parametrize("t, d, expected", [(20.0, 20.0, 100.0), (20.0, 30.0, 100.0)])
def test_humidity(spark, t, d, expected):
    assert spark.range(1).select(fx.relative_humidity(F.lit(t), F.lit(d))).first()[0] == pytest.approx(expected)


def test_wind(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 0.0)], "u double, v double")
    assert one(df.select(fx.wind_speed("u", "v"), F.round(fx.wind_direction("u", "v"), 6))) == [(1.0, 0.0), (1.0, 270.0)]


def test_payload(spark):
    text = '{"hourly": {"time": ["2025-01-01T00:00","2025-01-01T01:00","x"], "temperature_2m": [1,2], "cloud_cover": [10,null]}, "model": "m"}'
    rows = weather.parse_payload(spark.createDataFrame([(text,)], "p string"), "p").collect()
    assert len(rows) == 3 and rows[0].temperature_2m == 1.0 and rows[0].issue_micros is None and rows[0].cloud_cover is None
    assert rows[2].temperature_2m is None and rows[2].valid_micros is None and rows[0].temperature_2m_available == 1.0


def test_interpolation(spark):
    s = spark.createDataFrame([("a", 0, 1.0, 5), ("a", 4, 2.0, None), ("a", 4, 9.0, None)], "k string, t long, v double, m long")
    g = spark.createDataFrame([("a", t) for t in range(-1, 6)], "k string, t long")
    rows = {r.t: (r.v, r.m) for r in windows.interpolate_time(g, s, ["k"], "t", ["v"], ["m"]).collect()}
    assert rows == {-1: (None, None), 0: (1.0, 5), 1: (1.25, 5), 2: (1.5, 5), 3: (1.75, 5), 4: (2.0, 5), 5: (None, 5)}


def test_deaccumulation(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0.0, 2.0, None, 5.0])] + [("b", 0, 0.0), ("b", 1, 3.0)], "g string, t long, v double")
    assert [r.s for r in windows.deaccumulated(df, "v", ["g"], "t", "s").orderBy("g", "t").collect()] == [0.0, 2.0, None, 3.0, 0.0, 3.0]


def test_issue_selection(spark):
    c = spark.createDataFrame([(0, 1), (6, 2)], "issue long, v long")
    t = spark.createDataFrame([(6,), (7,), (0,), (30,)], "target long")
    assert sorted(one(joins.latest_in_range(c, t, 12, ["v"]))) == [(6, 0, 1), (7, 6, 2)]


def test_nearest_point(spark):
    points = spark.createDataFrame([(10 * i + j, lat, lon) for i, lat in enumerate((45.0, 46.0, 47.0)) for j, lon in enumerate((13.0, 14.0))], "point_id long, lat double, lon double")
    sites = spark.createDataFrame([("s", 46.1, 13.9), ("far", -60.0, -170.0)], "site_id string, lat double, lon double")
    assert {r.site_id: r.point_id for r in joins.nearest_point(sites, points).collect()} == {"s": 11, "far": 0}


@pytest.mark.parametrize("stretch", [1, 4, 4096])
def test_canonical_grid_in_stretches(spark, monkeypatch, stretch):
    """Every slot from the first to the last observation, by plain loops; sites and times that are NULL are none."""
    monkeypatch.setattr(grid, "STRETCH", stretch)
    rng = random.Random(5)
    seen = {(s, t): (rng.choice([None, -1.0, rng.random()]), str(t)) for s in (1, 2, 3) for t in rng.sample(range(-20, 40), 3**s)}
    rows = [(*k, *v) for k, v in seen.items()] + [(None, 5, 1.0, "x"), (1, None, 1.0, "x"), (4, None, 1.0, "x")]
    o = spark.createDataFrame(rows, "site_id long, time_idx long, energy_mwh double, note string")
    got = grid.canonical_grid(o, spark.createDataFrame([(s, 1.0) for s in (1, 2, 3, 4, 5)], "site_id long, capacity_mw double"), ["note"])
    times = {s: [t for x, t in seen if x == s] for s in (1, 2, 3)}
    want = []
    for s in times:
        for t in range(min(times[s]), max(times[s]) + 1):
            e, note = seen.get((s, t), (None, None))
            e = e if e is not None and e >= 0 else None
            want.append((s, t, e, note, e is not None, "missing" if e is None else "ok"))
    assert sorted(map(tuple, got.select("site_id", "time_idx", "energy_mwh", "note", "observation_available", "quality_status").collect()), key=lambda r: r[:2]) == want


def test_canonical_files_do_not_grow_with_sites(spark, tmp_path):
    """3,000 sites were 3,000 folders; now there is a file for each partition, and a site is read from few row groups."""
    o = spark.range(6000).select((F.col("id") % 3000).alias("site_id"), (F.col("id") % 4 * 7).alias("time_idx"), F.lit(1.0).alias("energy_mwh"))
    c = grid.canonical_grid(o.dropDuplicates(["site_id", "time_idx"]), o.select("site_id").distinct().withColumn("capacity_mw", F.lit(1.0)))
    io.write_canonical(c, grid.manifest(c), str(tmp_path))
    assert len(list((tmp_path / "data").rglob("*.parquet"))) <= 64 and not [p for p in (tmp_path / "data").iterdir() if p.is_dir()]
    data, listed = io.read_canonical(spark, str(tmp_path))
    assert sorted(data.collect()) == sorted(c.collect()) and listed.count() == 3001 and dict(data.dtypes) == dict(c.dtypes)


def test_asof(spark):
    left = spark.createDataFrame([("s", 0), ("s", 900)], "site string, t long")
    right = spark.createDataFrame([("s", -60, 0.1), ("s", 840, 0.2), ("x", 0, 9.0)], "site string, t long, v double")
    assert [(r.t, r.v) for r in joins.asof_backward(left, right, "site", "t", ["v"], 450).orderBy("t").collect()] == [(0, 0.1), (900, 0.2)]
    late = spark.createDataFrame([("s", 10, 0.3)], "site string, t long, v double")
    assert [(r.t, r.v, r.missing) for r in joins.asof_backward(left, late, "site", "t", ["v"], 900).orderBy("t").collect()] == [(0, None, 1), (900, 0.3, 0)]


def test_future_values_never_change_the_past(spark):
    left = spark.createDataFrame([("s", k) for k in range(0, 50, 5)], "site string, t long")
    right = [("s", k, float(k)) for k in range(0, 50, 3)]
    cut = 20
    a, b = (joins.asof_backward(left, spark.createDataFrame([(s, t, v if t <= cut else v + bump) for s, t, v in right], "site string, t long, v double"), "site", "t", ["v"], 10).where(F.col("t") <= cut) for bump in (0.0, 99.0))
    assert sorted(one(a)) == sorted(one(b)) and a.count() == 5


def test_patches(spark):
    flat = [float(1 + c) for c in range(12) for _ in range(64)]
    p = spark.createDataFrame([(1, flat)], "product_id long, pixels array<double>")
    centre = p.select(satellite.centre("pixels", 12, 8, 8, F.lit(4), F.lit(4), 4).alias("w")).first().w
    assert len(centre) == 12 * 16 and centre[:16] == [1.0] * 16 and centre[-1] == 12.0
    f = satellite.patch_features(p, 12, 64, (0, 3), (3, 11)).first()
    assert f.mean_3 == 4.0 and f.std_3 == 0 and f.missing_fraction == 0 and f.irradiance_proxy == 2.0
    hole = spark.createDataFrame([(1, [float("nan")] * 64 + flat[64:])], p.schema)
    g = satellite.patch_features(hole, 12, 64, (0, 3), (3, 11)).first()
    assert g.mean_0 is None and math.isfinite(g.cloud_index)
    two = spark.createDataFrame([(1, [0.0] * 4), (2, [2.0] * 4)], p.schema)
    assert one(satellite.channel_stats(two, 1, 4)) == [(0, 1.0, 1.0, 2)]
    empty = spark.createDataFrame([(1, [None] * 4)], p.schema)
    with pytest.raises(Exception, match="no pixel"):
        satellite.as_vectors(satellite.channel_stats(empty, 1, 4)).collect()
    assert empty.withColumns(satellite.patch_status("pixels", 4)).first().status == "missing"


def test_intervals(spark):
    i = spark.createDataFrame([("a", 8, 12), ("a", 0, 4), ("a", 4, 8), ("a", 16, 20), ("a", 5, 5)], "k string, lo long, hi long")
    assert sorted(one(windows.merge_intervals(i, ["k"]))) == [("a", 0, 12), ("a", 16, 20)]
    assert one(windows.coverage_end(i, ["k"], 2)) == [("a", 12)] and one(windows.coverage_end(i, ["k"], 13)) == [("a", 13)]
    assert one(windows.max_concurrency(i, ["k"])) == [("a", 1)]
    r = spark.createDataFrame([("a", 0, 10)], "k string, lo long, hi long")
    assert sorted(one(catalog.chunks(r, ["k"], 4))) == [("a", 0, 4), ("a", 4, 8), ("a", 8, 10)]


def test_lifecycle(spark):
    log = [("new", 1, "empty"), ("new", 2, "empty"), ("new", 3, "ok"), ("old", 1, "error"), ("old", 2, "empty"), ("bad", 1, "error"), ("bad", 2, "error"), ("fine", 1, "ok")]
    got = {r.p: (r.status, r.attempts) for r in catalog.lifecycle(spark.createDataFrame(log, "p string, n long, r string"), "p", "n", "r").collect()}
    assert got == {"new": ("unavailable_source", 2), "old": ("unavailable_source", 2), "bad": ("failed", 2), "fine": ("processed", 1)}


def test_lags_and_last_value(spark):
    s = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 2.5, 3.0])], "k string, t long, v double")
    assert [r.v_lag_1 for r in windows.lagged(s, ["v"], 1, ["k"], "t").orderBy("t").collect()] == [None, 1.0, 2.5]
    assert sorted(one(baselines.last_value(s, 2, "k", "t", "v"))) == [("a", 1, 3.0), ("a", 2, 3.0)]


@pytest.mark.parametrize(
    "cf, cs, slot, h, expected",
    [
        ([0.25, 0.99, 0.01, 0.75], [0.5, 0.6, 0.8, 1.0], 0, 3, [0.3, 0.4, 0.5]),
        ([0.9, None, 0.0, 0.2, 0.9], [0.2, 0.0, 0.5, 0.6, 0.8], 0, 2, [0.0, 1.0]),
        ([0.9, None, 0.0, 0.2, 0.9], [0.2, 0.0, 0.5, 0.6, 0.8], 1, 2, [0.5, 0.6]),
        ([0.9, None, None, 0.2, 0.9], [0.2, 0.0, 0.5, 0.6, 0.8], 2, 2, [0.6, 0.8]),
        ([0.18, 0.3, 0.4], [0.4, 0.6, 0.8], 0, 2, [0.27, 0.36]),
    ],
)
def test_smart_persistence(spark, cf, cs, slot, h, expected):
    hist = spark.createDataFrame([("s", k, a, b) for k, (a, b) in enumerate(zip(cf, cs))], "site_id string, time_idx long, cf double, cs double")
    rows = baselines.smart_persistence(hist, h, check=True).where(F.col("time_idx") == slot).orderBy("horizon").collect()
    assert [r.forecast for r in rows] == pytest.approx(expected)
    with pytest.raises(ValueError, match="repeated"):
        baselines.smart_persistence(hist.union(hist), h, check=True)


def test_quantile_fit(spark):
    rows = [(float(x), 2.0 + 3.0 * x + e) for x in range(20) for e in [k / 10 for k in range(11)]]
    b = baselines.fit_quantile(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", 0.9, 80)
    below = sum(y <= b[0] + b[1] * x + 1e-3 for x, y in rows) / len(rows)
    assert b[1] == pytest.approx(3.0, abs=0.02) and 0.85 <= below <= 0.95


def test_monotone_quantiles(spark):
    out = spark.createDataFrame([([0.8, -0.1, 0.3, 1.2, 0.5, 0.2, 0.9],)], "q array<double>").select(fx.monotone_quantiles("q").alias("q")).first().q
    assert out == sorted(out) and out[0] == 0 and out[-1] == 1


def test_model_frame(spark):
    df = spark.createDataFrame([(0.2, True), (None, False), (1.4, True), (0.5, True)], "cf double, seen boolean").withColumn("cs", F.lit(0.5))
    rows = forecast.model_frame(df, "cf", "seen", "cs", F.lit(True)).collect()
    assert [r.csi for r in rows[:3]] == pytest.approx([0.4, 0.0, 1.0]) and [r.csi_flag for r in rows] == [1, 0, 1, 1] and [r.loss_weight for r in rows] == [1, 0, 1, 1]


LONG = "target int, horizon int, fold int, elev double, actual double, point double, q50 double, scratch double, smart double"


def long_rows(spark, second=0.5):
    return spark.createDataFrame([(0, 1, 0, 10.0, 0.2, 0.3, 0.25, 0.2, 0.4), (1, 2, 0, 20.0, 0.4, second, 0.45, 0.6, 0.6), (2, 3, 0, -1.0, 0.0, 0.1, 0.1, 0.1, 0.0)], LONG)


def test_report_and_mask(spark):
    day = metrics.daylight(long_rows(spark), "elev", "actual", ["point", "smart"])
    r = {(x.model, x.grouping, x.value): x for x in metrics.report(day.withColumn("ref", F.col("smart")), ["point", "q50", "scratch", "smart"], "actual", "ref", ["horizon", "fold"]).collect()}
    assert r["q50", "overall", None]["count"] == 2 and r["q50", "overall", None].mae == pytest.approx(0.05) and ("point", "horizon", "2") in r and ("scratch", "fold", "0") in r
    with pytest.raises(Exception, match="lacks a prediction"):
        metrics.daylight(long_rows(spark, None), "elev", "actual", ["point"]).collect()
    a, b = metrics.acceptance(F.lit(0.09), F.lit(0.01), 0.1)
    assert one(spark.range(1).select(a, b)) == [(False, False)]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0), (2.0, 3.0, 2.0, 3.0), (3.0, 5.0, 4.0, 5.0)], "a double, f double, g double, r double")
    m = df.agg(metrics.mae("a", "f"), metrics.rmse("a", "f"), metrics.mbe("a", "f"), metrics.mse("a", "g"), metrics.skill_score("a", "g", "r"), metrics.skill_score("a", "f", "a")).first()
    assert tuple(m) == pytest.approx((1, 1.290994, 1, 1 / 3, 0.8, float("-inf")), rel=1e-6)
    same = df.select("a", *[F.col("a").alias(fx.quantile_name(q)) for q in fx.QUANTILES])
    assert same.agg(metrics.mean_pinball("a")).first()[0] == 0
    with pytest.raises(ValueError):
        metrics.nrmse("a", "f", 0)


def test_diagnostics(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.1, 0.0), ("s", 1, 1.0, 1.2, 100.0)], "k string, t int, a double, f double, c double")
    r = metrics.diagnostics(df, ["k"], "t", "a", "f", "c").first()
    assert r["count"] == 2 and r.night_positive_share == 1.0 and r.bias_mean == pytest.approx(0.15)


@pytest.mark.parametrize("name, expected", [("mse", 4.0), ("mse_heavy", 3.375), ("balanced", 2.75), ("mae_heavy", 2.5), ("mae", 2.0)])
def test_losses(spark, name, expected):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0)], "p double, y double")
    assert [r[0] for r in df.select(fx.point_loss(name, "p", "y")).collect()] == [0.0, expected]


def test_splits_and_folds(spark):
    s = spark.range(10).select(F.lit("s").alias("k"), F.col("id").alias("t"))
    got = [r[0] for r in s.select(windows.split_by_rank(["k"], "t", 0.6, 0.2)).collect()]
    assert (got.count("train"), got.count("validation"), got.count("test")) == (6, 2, 2)
    f = [(r.fold, r.part, str(r.start)) for r in forecast.rolling_folds(spark, "2025-01-01", "2025-06-30", 3).collect()]
    assert len({x[0] for x in f}) == 2 and (0, "validation", "2025-04-01") in f and (0, "test", "2025-05-01") in f
    e = forecast.expanding_folds(spark, 2025).where("part = 'test'").select(F.date_format("start", "MM")).collect()
    assert [r[0] for r in e] == ["05", "06", "07", "08", "09", "10", "11", "12"]


def test_even_sample(spark):
    df = spark.range(10).select(F.lit("s").alias("k"), F.col("id").alias("t"))
    assert sorted(r.t for r in windows.even_sample(df, ["k"], "t", 4).collect()) == [0, 3, 6, 9]


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeated"):
        checks.checked_join(a, a.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(ValueError, match="missing columns: z"):
        checks.require_columns(a, ["z"])
    assert checks.checked_join(a, a.limit(1).withColumnRenamed("v", "w"), ["k"]).count() == 2


def test_rules(spark):
    w = ts(spark, "2024-12-31 22:00:00", "2025-01-01 00:15:00").withColumn("issue", F.lit("2024-12-31 23:00:00").cast("timestamp"))
    assert {r.rule: r.n for r in checks.violation_counts(w, checks.window_rules("issue", "ts")).collect()} == {"after_issue": 1, "lead": 1, "on_grid": 0}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, n int")
    for _ in range(2):  # a chunk that is written again replaces itself
        io.append_part(rows, f"{tmp_path}/p", "0", "k", "n")
    assert sorted((r.k, r.v) for r in io.read_parts(spark, f"{tmp_path}/p").collect()) == [("a", 2), ("b", 3)]
    stats = spark.createDataFrame([(0, 1.0, 2.0)], "channel long, mean double, scale double")
    io.write_stats(stats, f"{tmp_path}/s", "v1")
    with pytest.raises(ValueError, match="channels"):
        io.read_stats(spark, f"{tmp_path}/s", "v1", 12)
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/c")
    assert io.read_tabular(spark, f"{tmp_path}/c", "k string, v int, n int").count() == 3
    files = io.read_files(spark, f"{tmp_path}/c", "*.csv")
    assert len(catalog.content_hash(files).first().sha256) == 64
