"""Runs over folds, draws of the bootstrap, exact percentiles, nearest axis places, parts and lifecycles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import joins, satellite, selection, windows
from heliogrid.sources import files, io
from heliogrid.sources.runs import FoldRun
from heliogrid.streaming import streams


def folds(spark, values):
    return spark.createDataFrame([(f, k, float(v)) for f, vs in values.items() for k, v in enumerate(vs)], "fold long, k long, v double")


def stored(run):
    return sorted((r.fold, r.k, r.v) for r in run.predictions().collect())


def test_a_run_killed_before_its_marker_gives_the_same_rows(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path), folds(spark, {0: [1, 2], 1: [3], 2: [4, 5]})
    first = FoldRun(spark, path, "a")
    assert first.evaluate(rows.where("fold = 0")) == [0]
    with monkeypatch.context() as m:
        m.setattr(files.State, "switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            FoldRun(spark, path, "a").evaluate(folds(spark, {1: [9, 9, 9], 2: [7]}))
    assert stored(FoldRun(spark, path, "a")) == [(0, 0, 1.0), (0, 1, 2.0)]  # written, but not finished
    again = FoldRun(spark, path, "a")
    assert again.evaluate(rows) == [1, 2] and again.finished() == [0, 1, 2]
    assert stored(again) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 0, 4.0), (2, 1, 5.0)]
    assert again.evaluate(rows) == []  # nothing twice


def test_the_state_of_another_run_is_refused(spark, tmp_path):
    FoldRun(spark, str(tmp_path), "a").commit([1])
    with pytest.raises(ValueError, match="another run"):
        FoldRun(spark, str(tmp_path), "b")


def test_a_destination_in_use_is_refused(spark, tmp_path):
    rows = spark.range(3)
    with pytest.raises(ValueError, match="source"):
        io.write_new(rows, f"{tmp_path}/x/", f"{tmp_path}/x")
    io.write_new(rows, f"{tmp_path}/y", f"{tmp_path}/x")
    with pytest.raises(Exception, match="exist"):
        io.write_new(rows, f"{tmp_path}/y", f"{tmp_path}/x")


def test_draws_are_few_though_a_block_is_tiny(spark):
    sizes = [1] + [100] * 199
    blocks = spark.createDataFrame([(b, n) for b, n in enumerate(sizes)], "block long, n long")
    total = 50_000
    choose = F.pmod(F.xxhash64(F.lit(1), "replicate", "place"), F.col("k"))
    drawn = windows.draws(blocks, total, 20, choose)
    by = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.replicate, r.place)):
        by.setdefault(r.replicate, []).append((r.place, r.n))
    assert len(by) == 20
    used = 0
    for places in by.values():
        assert [p for p, _ in places] == list(range(len(places)))
        upto = np.cumsum([n for _, n in places])
        assert upto[-1] >= total
        used += int(np.searchsorted(upto, total)) + 1
    assert sum(map(len, by.values())) <= 1.1 * used
    assert windows.draws(blocks.limit(0), 0, 5, choose).collect() == []


@pytest.mark.parametrize("accuracy", [10, 200, 10_000])
def test_percentiles_are_exact_whatever_the_sketch(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(g, rng.choice([0.0, 0.0, 1.0, rng.gauss(0, 1), None])) for g in "abc" for _ in range(700)]
    rows += [("one", 2.5), ("null", None), (None, 1.0), ("two", 1.0), ("two", 2.0)]
    shares = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p1": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").where("g is not null")
    got = {r.g: [r[n] for n in shares] for r in selection.percentiles(df, ["g"], F.col("v"), shares, accuracy).collect()}
    assert set(got) == {"a", "b", "c", "one", "two"}
    for g, values in got.items():
        assert values == pytest.approx(np.percentile([v for q, v in rows if q == g and v is not None], [100 * s for s in shares.values()]).tolist())
    whole = selection.percentiles(df, [], F.col("v"), {"m": 0.5}, accuracy).collect()
    assert whole[0].m == pytest.approx(np.median([v for q, v in rows if q is not None and v is not None]))


def test_a_sketch_that_misses_is_opened(spark, monkeypatch):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    monkeypatch.setattr(selection.F, "percentile_approx", lambda c, ends, accuracy: F.array(*[F.lit(-5.0)] * len(ends)))
    assert selection.percentiles(df, ["g"], F.col("v"), {"m": 0.5, "q": 0.25}).first()[1:] == (499.5, 249.75)


@pytest.mark.parametrize("width", [0.5, 4096.0])
def test_nearest_axis_against_pairs_without_a_cross_join(spark, width):
    rng = random.Random(1)
    source = [(s, rng.choice([rng.uniform(-5, 5), 1.0, -2.0, None])) for s in range(60)]
    target = [(t, rng.choice([rng.uniform(-9, 9), 1.5, -2.0])) for t in range(50)] + [(99, None)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, x double")
    out = satellite.nearest_axis(frame(target), frame(source), "x", width)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    got = {r.t: r.s for r in out.collect()}
    for t, x in target:
        assert got[t] == (None if x is None else min((abs(x - y), s) for s, y in source if y is not None)[1])


@pytest.mark.parametrize("most", [1, 3, 256])
def test_nearest_point_against_pairs(spark, most):
    """Sites in and far from clusters of every density, ties, places that repeat and such that are none."""
    rng = random.Random(3)
    near = lambda lat, lon, by: (lat + rng.uniform(-by, by), lon + rng.uniform(-by, by))
    points = [near(*c) for c in ((10, 20, 1e-6), (10, 21, 0.1), (-50, -170, 30)) for _ in range(60)] + [(float(rng.randrange(5)), float(rng.randrange(5))) for _ in range(60)]
    points = list(enumerate(points)) + [(-1, (None, 1.0)), (-2, (float("nan"), 1.0)), (-3, (float("inf"), 1.0))]
    sites = [near(*c) for c in ((10, 20, 2e-6), (10, 21, 1), (0, 0, 90)) for _ in range(40)] + [(rng.randrange(9) / 2, rng.randrange(9) / 2) for _ in range(40)]
    frame = lambda rows, key: spark.createDataFrame([(k, *place) for k, place in rows], f"{key} long, lat double, lon double")
    got = joins.nearest_point(frame([*enumerate(sites), (999, (1.0, None))], "site_id"), frame(points, "point_id"), most).collect()
    d2 = lambda a, b: (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])
    want = [(k, *min((d2(s, p), i) for i, p in points if i >= 0)[::-1]) for k, s in enumerate(sites)]
    assert sorted(map(tuple, got)) == want
    assert joins.nearest_point(frame(enumerate(sites), "site_id"), frame([], "point_id"), most).count() == 0


def test_nearest_point_of_dense_points_is_no_cross_join(spark):
    """100,000 sites and 100,000 points within a degree, at as many places and at few: 10^10 pairs share a cell of a degree."""
    x = lambda c, n: F.pmod(F.xxhash64(F.lit(c), F.col("id") % n), F.lit(1 << 20)) / (1 << 20)
    for n in (10, 100_000):
        points = spark.range(100_000).select(F.col("id").alias("point_id"), x("lat", n).alias("lat"), x("lon", n).alias("lon"))
        sites = points.select(F.col("point_id").alias("site_id"), "lat", "lon")
        got = joins.nearest_point(sites, points).agg(F.count("*"), F.max("d2"), F.max("point_id")).first()
        assert got[:2] == (100_000, 0.0) and (got[2] == 9 if n == 10 else got[2] > 99_000)


def test_unreadable_parts_are_reported(spark, tmp_path):
    path = str(tmp_path)
    io.append_part(spark.createDataFrame([(1, 1), (2, 1)], "k long, n long"), path, "a", "k", "n")
    (tmp_path / "chunk_id=b").mkdir()
    (tmp_path / "chunk_id=b" / "x.parquet").write_bytes(b"PAR1 cut short")
    report = [(r.path.rsplit("/", 2)[1], r.rows, r.state) for r in io.part_report(spark, path).where("state <> 'empty'").collect()]
    assert sum(n for c, n, s in report if (c, s) == ("chunk_id=a", "read")) == 2
    assert [r for r in report if r[2] == "unreadable"] == [("chunk_id=b", 0, "unreadable")] and io.read_parts(spark, path).count() == 2


def test_lifecycle_states_expire_and_late_outcomes_do_not_reopen(spark, tmp_path):
    """An empty product has one retry, then an end that later outcomes leave alone until it is forgotten."""
    inbox, seen = tmp_path / "in", []
    schema = "p long, n long, r string, day int"

    def run(*rows):
        """(product, outcome, day), in order"""
        spark.createDataFrame([(p, n, r, day) for n, (p, r, day) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(str(inbox))
        seen.clear()
        s = spark.readStream.schema(schema).parquet(str(inbox)).withColumn("at", F.timestamp_seconds(F.col("day") * 86_400))
        s = streams.lifecycle(s, "p", "n", "r", "at", "1 day", "5 days", "50 days")
        q = s.writeStream.foreachBatch(lambda b, n: seen.extend((r.p, r.status, r.attempts) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/state").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        return sorted(seen), q.lastProgress.stateOperators[0].numRowsTotal

    assert run((1, "empty", 100), (2, "ok", 100)) == ([(1, "failed", 1), (2, "processed", 1)], 2)
    assert run((1, "empty", 101), (2, "error", 101), (3, "error", 101))[0] == [(1, "unavailable_source", 2), (3, "failed", 1)]
    assert run((1, "ok", 102), (3, "empty", 102))[0] == [(3, "unavailable_source", 2)]
    assert run((4, "ok", 120)) == ([(4, "processed", 1)], 1)  # the others ended more than 5 days ago: forgotten
    assert run((5, "error", 121), (4, "error", 121))[0] == [(5, "failed", 1)]
