"""Scans in stretches against plain loops over whole series, across many borders."""

import random
import re

import pytest
from pyspark.sql import functions as F

from heliogrid.operators import joins, scans, windows


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_known_around_and_running_sums(spark, width):
    rng = random.Random(width)
    rows = [(s, t, rng.choice([None, None, float(t)])) for s in ("a", "b", None) for t in rng.sample(range(-40, 60), 50)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    out = scans.known_around(df, ["s"], "t", {"last": F.col("v")}, {"next": F.col("v")}, width)
    out = scans.known_around(out, ["s"], "t", {"before": F.col("v")}, width=width, strict=True)
    out = scans.running_sums(out, ["s"], "t", {"total": F.col("v"), "n": F.lit(1)}, width)
    got = {(r.s, r.t): (r.last, r.next, r.before, r.total, r.n) for r in scans.placed(out, ["s"], "t", "k", width).where("k = n - 1").collect()}
    for s, t, _ in rows:
        own = sorted((u, v) for q, u, v in rows if q == s)
        known = [(u, v) for u, v in own if v is not None]
        pick = lambda xs, at: xs[at][1] if xs else None
        assert got[s, t] == (
            pick([x for x in known if x[0] <= t], -1), pick([x for x in known if x[0] >= t], 0), pick([x for x in known if x[0] < t], -1),
            sum(v for u, v in known if u <= t), sum(u <= t for u, _ in own),
        )
    assert len(got) == len(rows)


def test_rows_at_one_time_see_each_other_unless_ties_order_them(spark):
    df = spark.createDataFrame([("a", 5, 0, None), ("a", 5, 1, 7), ("a", 5, 2, None)], "s string, t long, k long, v long")
    see = lambda **o: [r.last for r in scans.known_around(df, ["s"], "t", {"last": F.col("v")}, **o).orderBy("k").collect()]
    assert see() == [7, 7, 7] and see(ties=["k"]) == [None, 7, 7] and see(ties=["k"], strict=True) == [None, None, 7]


def test_series_operators_across_borders(spark):
    rng = random.Random(4)
    a = [("s", t, rng.choice([None, t * 1.5, t - 3.0])) for t in sorted(rng.sample(range(0, 90), 60))]
    df = spark.createDataFrame(a, "s string, t long, v double")
    got = {r.t: (r.d, r.w) for r in windows.interval_means(windows.deaccumulated(df, "v", ["s"], "t", "d", 7), "v", ["s"], "t", 2.0, "w", 7).collect()}
    last = before = None
    for _, t, v in a:
        step = None if v is None else max(v - (last or 0.0), 0.0)
        hours = 1.0 if before is None else (t - before) / 2.0
        assert got[t] == (step, None if step is None else pytest.approx(step / (hours * 3600.0)))
        last, before = (v if v is not None else last), t
    grid = spark.createDataFrame([("s", t) for t in range(-3, 95)], "s string, t long")
    whole, cut = (sorted(map(tuple, windows.interpolate_time(grid, df, ["s"], "t", ["v"], (), w).collect())) for w in (10**6, 5))
    assert whole == cut and any(r[2] is not None for r in cut)


def test_lags_by_rows_of_a_sparse_series(spark):
    rng = random.Random(8)
    ts = sorted(rng.sample(range(10**6), 300))
    df = spark.createDataFrame([("s", t, float(k)) for k, t in enumerate(ts)], "s string, t long, v double")
    out = windows.by_places(df, ["s"], "t", lambda w: {"l": F.lag("v", 3).over(w), "n": F.lead("v", 2).over(w), "m": F.avg("v").over(w.rowsBetween(-4, 0))}, back=4, ahead=2, length=10)
    rows = sorted(map(tuple, out.select("v", "l", "n", "m").collect()))
    assert rows == [(k, k - 3 if k >= 3 else None, k + 2 if k < 298 else None, sum(range(max(0, k - 4), k + 1)) / (k - max(0, k - 4) + 1)) for k in map(float, range(300)) for k in [int(k)]]


def brute(chunks, merged):
    return {c for c in chunks if None not in c and any(m[0] == c[0] and m[1] <= c[1] and c[2] <= m[2] for m in merged)}


@pytest.mark.parametrize("width", [1, 6, 4096])
def test_covered_against_pairs(spark, width):
    rng = random.Random(width)
    raw = [(g, lo, lo + rng.randrange(0, 9)) for g in "xyz" for lo in rng.sample(range(-50, 150), 40)]
    intervals = windows.merge_intervals(spark.createDataFrame(raw, "g string, lo long, hi long"), ["g"])
    merged = [tuple(r) for r in intervals.select("g", "lo", "hi").collect()]
    chunks = [(g, lo, lo + rng.choice([0, 1, 3, 7])) for g in ("x", "y", "q", None) for lo in range(-60, 160, 3)] + [("x", None, 4), ("x", 3, None)]
    c = spark.createDataFrame(chunks, "g string, lo long, hi long")
    want = brute(chunks, merged)
    assert {tuple(r) for r in joins.covered(c, intervals, "g", "left_semi", width).collect()} == want
    assert {tuple(r) for r in joins.covered(c, intervals, "g", "left_anti", width).collect()} == set(chunks) - want


def test_covered_of_one_large_group_takes_no_pairs(spark):
    """100,000 chunks and intervals of one group: a scan, not a join on the group."""
    n = 100_000
    chunks = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 7).alias("hi"))
    intervals = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 6 + F.col("id") % 3).alias("hi"))
    out = joins.covered(chunks, intervals, "g")
    assert out.count() == sum(6 + k % 3 >= 7 for k in range(n))
    plan = out._jdf.queryExecution().executedPlan().toString()
    joined = [line for line in plan.splitlines() if "Join" in line]
    assert joined and all("__stretch" in line for line in joined) and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_intervals_in_stretches_against_loops(spark, width):
    rng = random.Random(width)
    raw = [(g, lo, lo + rng.randrange(-1, 6)) for g in ("x", "y", None) for lo in (rng.randrange(-40, 90) for _ in range(45))]
    raw += [("y", -60, 200), ("z", 5, 5), ("x", None, 3), ("x", 3, None)]
    df = spark.createDataFrame(raw, "g string, lo long, hi long")
    merged, most = set(), {}
    for g in {r[0] for r in raw}:
        own = [r for r in raw if r[0] == g and None not in r[1:] and r[1] < r[2]]
        held = sorted({t for _, lo, hi in own for t in range(lo, hi)})
        runs = [(t, next(u for u in range(t, 400) if u not in held)) for t in held if t - 1 not in held]
        merged |= {(g, *r) for r in runs}
        if own:
            most[g] = max(sum(lo <= t < hi for _, lo, hi in own) for t in held)
    got = [tuple(r) for r in windows.merge_intervals(df, ["g"], width).collect()]
    assert len(got) == len(merged) and set(got) == merged
    assert {r.g: r.most for r in windows.max_concurrency(df, ["g"], width).collect()} == most


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_splits_and_samples_in_stretches_against_loops(spark, width):
    rng = random.Random(width)
    rows = [(g, t) for g, n in (("a", 53), (None, 10), ("c", 1), ("d", 2)) for t in rng.sample(range(-300, 300), n)]
    df = spark.createDataFrame(rows, "g string, t long")
    got = {(r.g, r.t): r.split for r in windows.chronological_split(df, ["g"], "t", 0.6, 0.2, width=width).collect()}
    taken = {tuple(r) for r in windows.even_sample(df, ["g"], "t", 4, width).collect()}
    want, sample = {}, set()
    for g in {r[0] for r in rows}:
        own = sorted(t for q, t in rows if q == g)
        n, take = len(own), min(len(own), 4)
        a, b = int(n * 0.6), int(n * 0.6) + int(n * 0.2)
        want |= {(g, t): "train" if k < a else "validation" if k < b else "test" for k, t in enumerate(own)}
        sample |= {(g, own[i * (n - 1) // max(take - 1, 1)]) for i in range(take)}
    assert got == want and taken == sample


def test_one_group_of_many_intervals_is_many_tasks(spark):
    """No window orders the intervals of a whole group: those by group alone see one row of each stretch."""
    n = 100_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 7 + 3 * ((F.col("id") + 1) % 2)).alias("hi"))
    out = windows.merge_intervals(df, ["g"])
    assert out.count() == n // 2 and windows.max_concurrency(df, ["g"]).first().most == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    seen = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window ")]
    assert seen and all("__c_" in line or re.search(r"windowspecdefinition\((g\S*, )?__stretch#\w+, ", line) for line in seen)
