"""Queries on joins in time and space, weather runs, and satellite patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import baselines, checks, grid, joins, satellite, weather, windows
from ..session import few
from . import adapters as A
from .production import r6, rounded
from .registry import query

START = 1893408  # the slot of 2024-01-01


@query("SELECT p.site_id, p.time_idx, p.energy, w.value FROM production p LEFT JOIN (SELECT variable AS site_id, (issue + step) * 4 AS time_idx, arg_max(value, issue) AS value FROM nwp GROUP BY ALL) w USING (site_id, time_idx)", ("production", "nwp"))
def J01_attach_weather(spark, d):
    """The newest run's value for each target."""
    w = A.nwp(spark, d).groupBy(F.col("variable").alias("site_id"), ((F.col("issue") + F.col("step")) * 4).alias("time_idx")).agg(F.max_by("value", "issue").alias("value"))
    return weather.attach(A.production(spark, d).drop("cf"), w, ["site_id", "time_idx"])


ASOF = """
WITH l AS (SELECT site_id, time_idx, {at} AS at FROM pv_user WHERE time_idx % 2 = 0), r AS (SELECT site_id, time_idx AS matched_ts, energy AS cloud FROM pv_user WHERE energy > 30)
SELECT l.site_id, l.time_idx, CASE WHEN l.time_idx - matched_ts <= {tol} THEN matched_ts END AS matched_ts, CASE WHEN l.time_idx - matched_ts <= {tol} THEN cloud END AS cloud, (matched_ts IS NULL OR l.time_idx - matched_ts > {tol})::BIGINT AS missing
FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.at >= r.matched_ts
"""


def _asof_sides(spark, d):
    p = A.pv_user(spark, d)
    return p.where("time_idx % 2 = 0").select("site_id", "time_idx", (F.col("time_idx") - 8).alias("cut")), p.where("energy > 30").select("site_id", "time_idx", F.col("energy").alias("cloud"))


@query(ASOF.format(at="time_idx", tol=40), ("pv_user",))
def J02_asof_backward(spark, d):
    left, right = _asof_sides(spark, d)
    return joins.asof_backward(left.drop("cut"), right, "site_id", "time_idx", ["cloud"], 40)


@query(ASOF.format(at="time_idx - 8", tol=60), ("pv_user",))
def J02_asof_with_cutoff(spark, d):
    left, right = _asof_sides(spark, d)
    return joins.asof_backward(left, right, "site_id", "time_idx", ["cloud"], 60, "cut").drop("cut")


@query("""
WITH c AS (SELECT issue, round(sum(value), 6) AS v FROM nwp WHERE step = 0 GROUP BY issue), t AS (SELECT DISTINCT hour AS target FROM hourly)
SELECT target, max(issue) AS issue, arg_max(v, issue) AS v FROM t JOIN c ON issue < target AND target <= issue + 12 GROUP BY target
""", ("nwp",))
def J03_latest_in_range(spark, d):
    n = A.nwp(spark, d)
    c = n.where("step = 0").groupBy("issue").agg(r6(F.sum("value")).alias("v"))
    return joins.latest_in_range(c, n.select((F.col("issue") + F.col("step")).alias("target")), 12, ["v"])


@query("SELECT variable, issue + step AS target, max(issue) AS issue, arg_max(value, issue) AS value FROM nwp WHERE step BETWEEN 6 AND 12 GROUP BY ALL", ("nwp",))
def J04_newest_run(spark, d):
    n = A.nwp(spark, d).select("variable", "issue", (F.col("issue") + F.col("step")).alias("target"), "value")
    return joins.newest_run(n, ["variable"], delay=6, horizon=12)


@query("""
WITH b AS (SELECT variable, issue + step AS target, max(issue) AS issue, arg_max(value, issue) AS value FROM nwp WHERE step >= 2 AND step <= 8 GROUP BY ALL),
g AS (SELECT DISTINCT variable, issue + step AS target FROM nwp)
SELECT g.variable, g.target, b.issue, b.value FROM g LEFT JOIN b USING (variable, target)
""", ("nwp",))
def J05_single_run_all_targets(spark, d):
    n = A.nwp(spark, d).select("variable", "issue", (F.col("issue") + F.col("step")).alias("target"), "value")
    every = n.select("variable", "target").distinct()  # the targets that are given
    return weather.attach(every, joins.newest_run(n, ["variable"], delay=2, horizon=8), ["variable", "target"])


@query("""
WITH s AS (SELECT s_suppkey AS site_id, (s_suppkey * 7) % 50 + 0.5e0 AS lat, (s_suppkey * 13) % 60 + 0.25e0 AS lon FROM supplier),
p AS (SELECT c_custkey AS point_id, (c_custkey * 11) % 50 + 0e0 AS plat, (c_custkey * 17) % 60 + 0e0 AS plon FROM customer),
j AS (SELECT site_id, point_id, (lat - plat) * (lat - plat) + (lon - plon) * (lon - plon) AS d2 FROM s, p)
SELECT site_id, point_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY d2, point_id) AS k FROM j) WHERE k = 1
""")
def J06_nearest_point(spark, d):
    k = F.col("s_suppkey")
    s = A.table(spark, d, "supplier").select(k.alias("site_id"), ((k * 7) % 50 + 0.5).alias("lat"), ((k * 13) % 60 + 0.25).alias("lon"))
    c = F.col("c_custkey")
    p = A.table(spark, d, "customer").select(c.alias("point_id"), ((c * 11) % 50 + 0.0).alias("lat"), ((c * 17) % 60 + 0.0).alias("lon"))
    return joins.nearest_point(s, p)


@query("""
WITH j AS (SELECT n_nationkey::BIGINT AS t, s_suppkey AS s, abs(n_nationkey * 1.3e0 - s_suppkey * 0.9e0) AS dist FROM nation, supplier)
SELECT t, s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY dist, s) AS k FROM j) WHERE k = 1
""")
def J07_nearest_axis(spark, d):
    t = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") * 1.3).alias("x"))
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 0.9).alias("x"))
    return satellite.nearest_axis(t, s, "x")


@query("SELECT p.product_id, s.site_id FROM patch p, (SELECT DISTINCT site_id FROM pv) s", ("patch", "pv"))
def J08_fan_out(spark, d):
    sites = A.pv(spark, d).select("site_id").distinct()
    return A.patch(spark, d).select("product_id").crossJoin(few(sites, 10_000))


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def J09_checked_join(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return checks.checked_join(A.table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], validate="many_to_one")


KEYS = ["site_id", "issue_idx", "time_idx", "horizon", "fold"]


@query("SELECT a.site_id, a.issue_idx, a.time_idx, a.horizon, a.fold, a.point, b.scratch FROM forecasts a JOIN forecasts b USING (site_id, issue_idx, time_idx, horizon, fold) WHERE b.elev > 0", ("forecasts",))
def J10_ablation_join(spark, d):
    f = A.forecasts(spark, d)
    return f.select(*KEYS, "point").join(f.where("elev > 0").select(*KEYS, "scratch"), KEYS)


@query("SELECT f.site_id, f.time_idx, f.horizon, round(p.energy / (s.capacity_mw * 0.25e0), 6) AS plan FROM forecasts f JOIN site s ON s.site_id = f.site_id LEFT JOIN production p ON p.site_id = f.site_id AND p.time_idx = f.time_idx - 96", ("forecasts", "site"))
def J11_P15_plan_at_target(spark, d):
    plan = A.production(spark, d).select("site_id", (F.col("time_idx") + 96).alias("time_idx"), F.col("energy").alias("planned"))
    f = A.forecasts(spark, d).select("site_id", "time_idx", "horizon").join(few(A.site(spark, d).select("site_id", "capacity_mw")), "site_id")
    return f.join(plan, ["site_id", "time_idx"], "left").select("site_id", "time_idx", "horizon", r6(fx.capacity_factor("planned", "capacity_mw")).alias("plan"))


@query("SELECT s.site_id, s.time_idx AS issue_idx, h.h AS horizon, t.cs AS target_sky FROM sky s, (SELECT unnest([1, 2, 3])::BIGINT AS h) h, sky t WHERE t.site_id = s.site_id AND t.time_idx = s.time_idx + h.h", ("sky",))
def J12_horizon_expansion(spark, d):
    s = A.sky(spark, d)
    e = baselines.horizons(s.select("site_id", F.col("time_idx").alias("issue_idx")), 3, "issue_idx")
    return e.join(s.select("site_id", F.col("time_idx").alias("target_idx"), F.col("cs").alias("target_sky")), ["site_id", "target_idx"]).drop("target_idx")


FOLDS = [(f, p, START + a * 96, START + b * 96) for f in range(3) for p, a, b in (("train", 0, 10 + 5 * f), ("validation", 10 + 5 * f, 12 + 5 * f), ("test", 12 + 5 * f, 15 + 5 * f))]


@query("SELECT p.site_id, p.time_idx, f.fold, f.part FROM pv p JOIN (VALUES " + ", ".join(f"({f}::BIGINT, '{p}', {a}, {b})" for f, p, a, b in FOLDS) + ") f (fold, part, lo, hi) ON p.time_idx >= f.lo AND p.time_idx < f.hi", ("pv",))
def J13_assign_folds(spark, d):
    folds = spark.createDataFrame(FOLDS, "fold long, part string, start long, end long")
    return joins.assign_folds(A.pv(spark, d).select("site_id", "time_idx"), folds, "time_idx")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05e0)")
def J15_anti_join(spark, d):
    late = A.table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.table(spark, d, "orders").select("o_orderkey").join(late, "o_orderkey", "left_anti")


@query("SELECT DISTINCT site_id::VARCHAR AS site_id FROM pv_user WHERE site_id NOT IN (SELECT s_suppkey FROM supplier)", ("pv_user",))
def J16_missing_metadata(spark, d):
    meta = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("site_id"))
    return grid.without_metadata(A.pv_user(spark, d).select(F.col("site_id").cast("string").alias("site_id")), meta)


@query("""
WITH k AS (SELECT c_custkey AS id, c_mktsegment AS status, c_acctbal AS size FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, 'NEW' AS status, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS size FROM customer WHERE c_custkey % 4 <> 0)
SELECT id, CASE WHEN k.status = 'BUILDING' THEN k.status ELSE coalesce(n.status, k.status) END AS status, CASE WHEN k.status = 'BUILDING' THEN k.size ELSE coalesce(n.size, k.size) END AS size FROM k FULL JOIN n USING (id)
""")
def J17_merge_records(spark, d):
    c = A.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    k = c.where("id % 3 <> 0").select("id", F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("size"))
    n = c.where("id % 4 <> 0").select("id", F.lit("NEW").alias("status"), F.when(F.col("id") % 5 != 0, F.col("c_acctbal") + 1).alias("size"))
    return joins.merge_records(k, n, "id", ["status", "size"], F.col("k.status") == "BUILDING")


# --- weather -------------------------------------------------------------------


@query("""
WITH w AS (SELECT issue, step, max(CASE WHEN variable = 'click' THEN value END) AS t, max(CASE WHEN variable = 'view' THEN value END) AS p FROM nwp GROUP BY ALL)
SELECT issue * 3600000000 AS issue_micros, (issue + step) * 3600000000 AS valid_micros, t AS temperature_2m, p AS precipitation, (t IS NOT NULL)::INT::DOUBLE AS temperature_2m_available, step::DOUBLE AS lead_hours FROM w
""", ("nwp",))
def S07_weather_payload(spark, d):
    n = weather.pivot_variables(A.nwp(spark, d), ["issue", "step"], ["click", "view"])
    time = F.date_format(F.timestamp_seconds((F.col("issue") + F.col("step")) * 3600), "yyyy-MM-dd'T'HH:mm")
    rows = n.groupBy("issue").agg(F.array_sort(F.collect_list(F.struct("step", time.alias("t"), F.col("click").alias("a"), F.col("view").alias("b")))).alias("r"))
    pick = lambda c: F.transform("r", lambda x: x[c])
    hourly = F.struct(pick("t").alias("time"), pick("a").alias("temperature_2m"), pick("b").alias("precipitation"))
    ref = F.date_format(F.timestamp_seconds(F.col("issue") * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    payload = rows.select(F.to_json(F.struct(hourly.alias("hourly"), ref.alias("forecast_reference_utc")), {"ignoreNullFields": "false"}).alias("payload"))
    out = weather.parse_payload(payload, "payload")
    return out.select("issue_micros", "valid_micros", "temperature_2m", "precipitation", "temperature_2m_available", "lead_hours")


@query("""
SELECT variable, coalesce(CASE WHEN step % 2 = 0 THEN issue END, issue + 1) * 3600000000 AS issue, step + 0.5e0 AS step_hours,
  CASE WHEN step % 5 = 0 THEN 0 ELSE coalesce(CASE WHEN step % 2 = 0 THEN issue END, issue + 1) * 3600000000 + ((step + 0.5e0) * 3.6e9)::BIGINT END AS valid, CASE WHEN step <> 3 THEN value END AS value FROM nwp
""", ("nwp",))
def S08_normalise_records(spark, d):
    hour = 3_600_000_000
    n = A.nwp(spark, d).select("variable", F.when(F.col("step") % 2 == 0, F.col("issue") * hour).alias("issue_attr"), ((F.col("issue") + 1) * hour).alias("time"), (F.col("step") + 0.5).alias("step_hours"), F.when(F.col("step") % 5 == 0, F.lit(0).cast("long")).alias("valid"), F.when(F.col("step") == 3, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    return weather.normalise_records(n)


@query("SELECT '/a/' || strftime(o_orderdate, '%Y-%m') || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'oper' ELSE 'scda' END || '/' || o_orderkey || '.grib' AS path, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 2 = 0 THEN 'oper' ELSE 'scda' END AS stream FROM orders WHERE strftime(o_orderdate, '%Y-%m') BETWEEN '1993-01' AND '1996-06'")
def S09_archive_inventory(spark, d):
    path = F.concat(F.lit("/a/"), F.date_format("o_orderdate", "yyyy-MM"), F.when(F.col("o_orderkey") % 2 == 0, "/oper/").otherwise("/scda/"), F.col("o_orderkey").cast("string"), F.lit(".grib"))
    return weather.inventory(A.table(spark, d, "orders").select(path.alias("path")), "1993-01", "1996-06")


@query("""
WITH w AS (SELECT issue, step, """ + ", ".join(f"max(CASE WHEN variable = '{v}' THEN value END) AS {n}" for v, n in (("click", "t"), ("view", "dp"), ("error", "u"), ("signup", "v"), ("purchase", "tp"))) + """ FROM nwp GROUP BY ALL)
SELECT issue, step, round(t / 10e0 + 250e0 - 273.15e0, 6) AS temperature, round(sqrt(u * u + v * v), 6) AS wind_speed, round(tp * 1000e0, 6) AS precipitation, (t IS NOT NULL)::INT::DOUBLE AS temperature_available, 0e0 AS total_cloud_available,
  greatest((t IS NOT NULL)::INT, (dp IS NOT NULL)::INT, (u IS NOT NULL AND v IS NOT NULL)::INT, (tp IS NOT NULL)::INT)::DOUBLE AS available FROM w
""", ("nwp",))
def P05_canonical_nwp(spark, d):
    w = weather.pivot_variables(A.nwp(spark, d), ["issue", "step"], ["click", "view", "error", "signup", "purchase"])
    w = w.select("issue", "step", (F.col("click") / 10 + 250).alias("t2m"), (F.col("view") / 10 + 250).alias("d2m"), F.col("error").alias("u10"), F.col("signup").alias("v10"), F.col("purchase").alias("tp"), F.lit(None).cast("double").alias("lcc"))
    return rounded(weather.canonical_nwp(w).select("issue", "step", "temperature", "wind_speed", "precipitation", "temperature_available", "total_cloud_available", "available"))


@query("SELECT variable, issue, step, CASE WHEN step % 4 = 0 OR step <= 1 THEN 0e0 ELSE value END AS value FROM nwp", ("nwp",))
def P07_leakage_guard(spark, d):
    n = A.nwp(spark, d).withColumns({"flag": F.when(F.col("step") % 4 == 0, 0.0).otherwise(1.0), "target": F.col("issue") + F.col("step") - 1})
    return weather.guard(n, ["value"], "issue", "flag", "target").select("variable", "issue", "step", "value")


@query("SELECT issue, step, max(CASE WHEN variable = 'click' THEN value END) AS shortwave_radiation, count(CASE WHEN variable = 'click' THEN value END)::DOUBLE AS shortwave_radiation_available FROM nwp GROUP BY ALL", ("nwp",))
def P09_weather_preset(spark, d):
    w = weather.pivot_variables(A.nwp(spark, d), ["issue", "step"], ["click", "view"]).withColumnsRenamed({"click": "shortwave_radiation", "view": "precipitation"})
    w = w.withColumn("shortwave_radiation_available", F.col("shortwave_radiation").isNotNull().cast("double"))
    return weather.select_preset(w, "radiation", ["issue", "step"])


@query("SELECT site_id, time_idx, 0e0 AS temperature, 0e0 AS temperature_available, NULL::BIGINT AS issue FROM pv", ("pv",))
def P11_masked_weather(spark, d):
    return weather.masked_rows(A.pv(spark, d).select("site_id", "time_idx"), ["temperature"])


ACC = "acc AS (SELECT variable, issue, step, sum(CASE WHEN step % 5 <> 3 THEN round(value, 2)::DECIMAL(18, 2) END) OVER (PARTITION BY variable, issue ORDER BY step) AS run, value, step % 5 <> 3 AS seen FROM nwp)"


def _accumulated(spark, d):
    """Sums of whole cents, exact in any order; every fifth step is missing."""
    w = windows.over(["variable", "issue"], "step")
    n = A.nwp(spark, d).withColumn("cents", F.when(F.col("step") % 5 != 3, F.round(F.col("value") * 100).cast("long")))
    return n.select("variable", "issue", "step", F.when(F.col("cents").isNotNull(), F.sum("cents").over(w).cast("double")).alias("v"))


@query("""
WITH c AS (SELECT variable, issue, step, CASE WHEN step % 5 <> 3 THEN round(value * 100)::BIGINT END AS cents FROM nwp),
a AS (SELECT *, CASE WHEN cents IS NOT NULL THEN sum(cents) OVER w END::DOUBLE AS v FROM c WINDOW w AS (PARTITION BY variable, issue ORDER BY step)),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY variable, issue ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, lag(step) OVER (PARTITION BY variable, issue ORDER BY step) AS ls FROM a)
SELECT variable, issue, step, CASE WHEN v IS NOT NULL THEN greatest(v - coalesce(before, 0e0), 0e0) END AS deaccumulated,
  round(CASE WHEN v IS NOT NULL THEN greatest(v - coalesce(before, 0e0), 0e0) END / (greatest(coalesce((step - ls) / 1e0, 1e0), 1e-9) * 3600e0), 9) AS watts FROM p
""", ("nwp",))
def W01_W02_deaccumulate(spark, d):
    a = _accumulated(spark, d)
    steps = windows.deaccumulated(a, "v", ["variable", "issue"], "step", "deaccumulated")
    return windows.interval_means(steps, "v", ["variable", "issue"], "step", 1.0, "watts").select("variable", "issue", "step", "deaccumulated", F.round("watts", 9).alias("watts"))


@query("""
WITH s AS (SELECT variable, (issue + step) * 4 AS t, max(CASE WHEN step <> 2 THEN value END) AS v, max(issue) AS meta FROM nwp WHERE step < 6 GROUP BY ALL),
g AS (SELECT variable, unnest(range(lo - 4, hi + 5)) AS t FROM (SELECT variable, min(t) AS lo, max(t) AS hi FROM s GROUP BY variable)),
u AS (SELECT g.variable, g.t, s.v, s.meta FROM g LEFT JOIN s USING (variable, t)),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta, last_value(v IGNORE NULLS) OVER b AS va, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tb, first_value(v IGNORE NULLS) OVER f AS vb, last_value(meta IGNORE NULLS) OVER b AS m
  FROM u WINDOW b AS (PARTITION BY variable ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY variable ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT variable, t, round(CASE WHEN ta IS NULL OR tb IS NULL THEN NULL WHEN ta = tb THEN va ELSE va + (vb - va) * ((t - ta) / (tb - ta)) END, 9) AS v, m AS issue FROM k
""", ("nwp",))
def W03_W04_interpolate(spark, d):
    s = A.nwp(spark, d).where("step < 6").groupBy("variable", ((F.col("issue") + F.col("step")) * 4).alias("t")).agg(F.max(F.when(F.col("step") != 2, F.col("value"))).alias("v"), F.max("issue").alias("issue"))
    g = s.groupBy("variable").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("variable", F.explode(F.sequence(F.col("lo") - 4, F.col("hi") + 4)).alias("t"))
    return windows.interpolate_time(g, s, ["variable"], "t", ["v"], ["issue"]).withColumn("v", F.round("v", 9))


@query("""
WITH t AS (SELECT user_id AS site_id, min(epoch_us(ts) // 3600000000) AS lo, max(epoch_us(ts) // 3600000000) AS hi FROM events GROUP BY user_id),
r AS (SELECT site_id, lo, hi, day * 24 + c.c AS run_hour FROM (SELECT *, unnest(range(lo // 24 - 1, hi // 24 + 1)) AS day FROM t), (SELECT unnest([0, 6, 12, 18]) AS c) c)
SELECT site_id, run_hour, greatest(run_hour // 24, lo // 24) AS start_day, least((run_hour + 24) // 24, hi // 24) AS end_day FROM r WHERE run_hour < hi AND run_hour + 24 > lo
""")
def S23_plan_requests(spark, d):
    t = A.table(spark, d, "events").select(F.col("user_id").alias("site_id"), F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour"))
    return weather.plan_requests(t, ["site_id"], "hour", 1)


@query("SELECT o_orderdate::DATE::VARCHAR AS day, array_to_string(list_sort(list_distinct(list(o_custkey))), ',') AS items FROM orders GROUP BY 1")
def S23_group_requests(spark, d):
    o = A.table(spark, d, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), "o_custkey")
    return weather.group_requests(o, ["day"], "o_custkey").select("day", F.array_join("items", ",").alias("items"))


@query("SELECT variable, count(*) AS rows, count(v) AS available, count(v) / count(*) AS share, count(*) - count(v) AS v_missing FROM (SELECT variable, CASE WHEN step % 5 <> 3 THEN value END AS v FROM nwp) GROUP BY ROLLUP (variable)", ("nwp",))
def A23_weather_coverage(spark, d):
    n = A.nwp(spark, d).select("variable", F.when(F.col("step") % 5 != 3, F.col("value")).alias("v"))
    return weather.coverage(n, ["variable"], ["v"])


@query("""
WITH b AS (SELECT variable AS site_id, (issue + step) * 4 AS time_idx, max(issue) AS issue, arg_max(value, issue) AS value FROM nwp WHERE step BETWEEN 6 AND 12 GROUP BY ALL)
SELECT p.site_id, count(*) AS rows, count(b.value) AS available, count(b.value) / count(*) AS share, count(*) - count(b.value) AS value_missing FROM pv p LEFT JOIN b USING (site_id, time_idx) GROUP BY ROLLUP (p.site_id)
""", ("nwp", "pv"))
def M12_weather_materialisation(spark, d):
    n = A.nwp(spark, d).select(F.col("variable").alias("site_id"), "issue", (F.col("issue") + F.col("step")).alias("target"), "value")
    w = joins.newest_run(n, ["site_id"], delay=6, horizon=12).select("site_id", (F.col("target") * 4).alias("time_idx"), "issue", "value")
    return weather.coverage(weather.attach(A.pv(spark, d), w, ["site_id", "time_idx"]), ["site_id"], ["value"])


MATERIALISED = """
WITH v AS (SELECT variable AS site_id, issue, step, issue + step AS target, value FROM nwp),
b AS (SELECT site_id, target, max(issue) AS issue, arg_max(value, issue) AS value FROM v WHERE site_id IN ('click', 'view') AND step BETWEEN 6 AND 12 GROUP BY ALL
  UNION ALL SELECT site_id, target, issue, value FROM v WHERE site_id = 'purchase' AND issue % 12 = 0 AND step BETWEEN 1 AND 12),
m AS (SELECT p.site_id, p.time_idx, b.issue, coalesce(b.value, 0e0) AS value, (b.value IS NOT NULL)::INT::DOUBLE AS value_available FROM pv p LEFT JOIN b ON b.site_id = p.site_id AND b.target = p.time_idx // 4)
"""


def _materialised(spark, d):
    """Newest runs for two source sites, exact ones for a target site, masks for the others."""
    n = A.nwp(spark, d).select(F.col("variable").alias("site_id"), "issue", (F.col("issue") + F.col("step")).alias("target"), "value")
    newest = joins.newest_run(n.where("site_id IN ('click', 'view')"), ["site_id"], delay=6, horizon=12)
    exact = joins.exact_run(n.where("site_id = 'purchase'"), ["site_id"], 12)
    frame = A.pv(spark, d).select("site_id", "time_idx", F.floor(F.col("time_idx") / 4).alias("target"))
    return weather.materialise(frame, [newest, exact], ["site_id", "target"], ["value"])


@query(MATERIALISED + "SELECT * FROM m", ("nwp", "pv"))
def M12_materialised_weather(spark, d):
    return _materialised(spark, d).drop("target")


@query(MATERIALISED + "SELECT site_id, count(*) AS rows, count(issue) AS served, count(*) - count(issue) AS masked, count(DISTINCT issue) AS runs FROM m GROUP BY ROLLUP (site_id)", ("nwp", "pv"))
def M12_weather_manifest(spark, d):
    masked = (F.count("*") - F.count("issue")).alias("masked")
    return _materialised(spark, d).rollup("site_id").agg(F.count("*").alias("rows"), F.count("issue").alias("served"), masked, F.countDistinct("issue").alias("runs"))


# --- satellite -------------------------------------------------------------------


@query("""
WITH f AS (SELECT '/s/15_' || CASE WHEN event_id % 3 = 0 THEN 'hrv_' ELSE '' END || strftime(ts, '%Y%m%d%H%M') || '.zip' AS path, strftime(ts, '%Y%m%d%H%M') AS stamp, event_id % 3 = 0 AS hrv FROM events)
SELECT stamp, min(path) FILTER (NOT hrv) AS plain, min(path) FILTER (hrv) AS hrv FROM f GROUP BY stamp HAVING count(*) FILTER (hrv) > 0 AND count(*) FILTER (NOT hrv) > 0
""")
def S10_archive_pairs(spark, d):
    path = F.concat(F.lit("/s/15_"), F.when(F.col("event_id") % 3 == 0, "hrv_").otherwise(""), F.date_format("ts", "yyyyMMddHHmm"), F.lit(".zip"))
    return satellite.archive_pairs(A.table(spark, d, "events").select(path.alias("path")))


@query("SELECT vec_id, label::BIGINT AS site_id, len(embedding)::BIGINT AS n FROM embeddings WHERE vec_id % 3 <> 0")
def S11_join_sidecars(spark, d):
    e = A.table(spark, d, "embeddings")
    name = lambda folder, ext: F.concat(F.lit(folder), F.col("vec_id").cast("string"), F.lit(ext))
    side = e.select("vec_id", F.col("label").cast("long").alias("site_id"), name("/m/p", ".json").alias("path"))
    arrays = e.where("vec_id % 3 <> 0").select(name("/a/p", ".npz").alias("array_path"), F.size("embedding").cast("long").alias("n"))
    return satellite.join_sidecars(side, arrays).select("vec_id", "site_id", "n")


CHANNELS = "WITH c AS (SELECT product_id, site_id, time_idx, unnest([0, 1, 2, 3]) AS c, pixels FROM patch), x AS (SELECT product_id, site_id, time_idx, c, unnest(pixels[c * 16 + 1 : c * 16 + 16]) AS v FROM c) "


@query(CHANNELS + """
SELECT product_id, """ + ", ".join(f"round(avg(v) FILTER (c = {c}), 11) AS mean_{c}, round(stddev_pop(v) FILTER (c = {c}), 11) AS std_{c}, min(v) FILTER (c = {c}) AS min_{c}, max(v) FILTER (c = {c}) AS max_{c}" for c in range(4)) + """,
  1 - count(v) / 64e0 AS missing_fraction, round(avg(v) FILTER (c < 2) / (avg(v) FILTER (c >= 2) + 1e-6 + 1e0), 11) AS cloud_index, round(avg(v) FILTER (c < 2), 11) AS irradiance_proxy FROM x GROUP BY product_id
""", ("patch",))
def A20_A21_patch_features(spark, d):
    f = satellite.patch_features(A.patch(spark, d), 4, 16, (0, 2), (2, 4))
    vis = F.col("irradiance_proxy")
    ir = (F.aggregate(F.slice("pixels", 33, 32), F.lit(0.0), lambda a, x: a + x)) / 32
    # an index on a base of 1, as these made-up bands have means about 0
    return rounded(f.withColumn("cloud_index", vis / (ir + 1e-6 + 1.0)).drop("pixels", "site_id", "time_idx"), places=11)


@query(CHANNELS + "SELECT c::BIGINT AS channel, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-6), 6) AS scale, count(DISTINCT product_id) AS patches FROM x GROUP BY c", ("patch",))
def A19_channel_stats(spark, d):
    return rounded(satellite.channel_stats(A.patch(spark, d), 4, 16))


@query(CHANNELS + """, s AS (SELECT site_id % 2 AS fold, c, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x GROUP BY ALL)
SELECT product_id, round(sum((v - m) / s) FILTER (x.c = 0), 4) AS n0, round(sum((v - m) / s) FILTER (x.c = 3), 4) AS n3 FROM x JOIN s ON s.c = x.c AND s.fold = x.site_id % 2 GROUP BY product_id
""", ("patch",))
def P17_normalise(spark, d):
    p = A.patch(spark, d).withColumn("fold", F.col("site_id") % 2)
    v = satellite.as_vectors(satellite.channel_stats(p, 4, 16, ["fold"]), ["fold"])
    n = p.join(F.broadcast(v), "fold").withColumn("n", satellite.normalise("pixels", "means", "scales", 16))
    total = lambda c: F.round(F.aggregate(F.slice("n", c * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x), 4)
    return n.select("product_id", total(0).alias("n0"), total(3).alias("n3"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND max(l_tax) OVER (PARTITION BY l_orderkey, l_returnflag) <= 1 THEN round(180e0 + 150e0 * l_tax, 6) ELSE l_tax END AS value FROM lineitem")
def P16_physical_range(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_tax").alias("value"))
    return rounded(satellite.physical(li, ["l_orderkey", "l_returnflag"], F.col("l_returnflag") == "A").drop("l_returnflag"))


@query("SELECT c_custkey, c_mktsegment AS channel, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 ELSE 1 END AS position FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')")
def P19_select_channels(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("channel"))
    return satellite.select_channels(c, ["MACHINERY", "BUILDING"])


@query("SELECT product_id, array_to_string(list_transform(range(16), lambda k: CASE WHEN (k // 4) % 2 + 0 >= 0 AND k % 4 // 2 + product_id % 3 - 1 BETWEEN 0 AND 3 AND k % 2 + product_id % 4 - 1 BETWEEN 0 AND 3 THEN round(pixels[CAST(k // 4 * 16 + (k % 4 // 2 + product_id % 3 - 1) * 4 + k % 2 + product_id % 4 - 1 + 1 AS BIGINT)] * 1000000)::BIGINT::VARCHAR ELSE 'x' END), ',') AS window FROM patch", ("patch",))
def F12_centre_window(spark, d):
    w = satellite.centre("pixels", 4, 4, 4, F.col("product_id") % 3, F.col("product_id") % 4, 2)
    text = F.transform(w, lambda x: F.coalesce(F.round(x * 1000000).cast("long").cast("string"), F.lit("x")))
    return A.patch(spark, d).select("product_id", F.array_join(text, ",").alias("window"))


def _damaged(spark, d):
    p = A.patch(spark, d)
    bad = F.when(F.col("product_id") % 5 == 0, F.transform("pixels", lambda x: F.lit(None).cast("double"))).when(F.col("product_id") % 5 == 1, F.transform("pixels", lambda x: F.when(x > 0, x))).when(F.col("product_id") % 5 == 2, F.slice("pixels", 1, 63)).otherwise(F.col("pixels"))
    return p.withColumn("pixels", bad)


@query("""
WITH b AS (SELECT product_id, CASE WHEN product_id % 5 = 0 THEN 0 WHEN product_id % 5 = 1 THEN len(list_filter(pixels, lambda x: x > 0)) WHEN product_id % 5 = 2 THEN 63 ELSE 64 END AS finite FROM patch)
SELECT product_id, 1 - finite / 64e0 AS missing_fraction, CASE WHEN product_id % 5 = 2 THEN 'invalid' WHEN finite = 0 THEN 'missing' WHEN finite < 64 THEN 'degraded' ELSE 'ok' END AS status FROM b
""", ("patch",))
def F13_patch_status(spark, d):
    return _damaged(spark, d).withColumns(satellite.patch_status("pixels", 64)).select("product_id", "missing_fraction", "status")


MATRIX = [[(3 * i + 5 * j) % 7 - 3.0 for j in range(3)] for i in range(4)]


@query(CHANNELS + ", m AS (SELECT product_id, c, avg(v) AS m FROM x GROUP BY ALL) SELECT product_id, " + ", ".join(f"round(sum(m * CASE c {' '.join(f'WHEN {i} THEN {MATRIX[i][j]}e0' for i in range(4))} END), 11) AS e{j}" for j in range(3)) + " FROM m GROUP BY product_id", ("patch",))
def F19_project_embedding(spark, d):
    f = satellite.patch_features(A.patch(spark, d), 4, 16, (0, 2), (2, 4))
    e = f.withColumn("e", satellite.project(F.array(*[F.col(f"mean_{c}") for c in range(4)]), MATRIX))
    return e.select("product_id", *[F.round(F.col("e")[j], 11).alias(f"e{j}") for j in range(3)])


class MeanProjection:
    """Channel means times MATRIX, for whole batches."""

    def __call__(self, x):
        return x.reshape(len(x), 4, 16).mean(axis=2) @ np.array(MATRIX)


@query(CHANNELS + ", m AS (SELECT product_id, c, avg(v) AS m FROM x GROUP BY ALL) SELECT product_id, " + ", ".join(f"round(sum(m * CASE c {' '.join(f'WHEN {i} THEN {MATRIX[i][j]}e0' for i in range(4))} END), 11) AS e{j}" for j in range(3)) + " FROM m GROUP BY product_id", ("patch",))
def X04_encode_batches(spark, d):
    e = satellite.encode_batches(A.patch(spark, d), MeanProjection())
    return e.select("product_id", *[F.round(F.col("embedding")[j], 11).alias(f"e{j}") for j in range(3)])


@query(CHANNELS + """, s AS (SELECT f.fold, c, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x JOIN (SELECT unnest([0, 1]) AS fold) f ON x.product_id % 3 <> f.fold GROUP BY ALL),
n AS (SELECT s.fold, product_id, x.c, avg((v - m) / s) AS z FROM x JOIN s ON s.c = x.c GROUP BY ALL)
SELECT fold::BIGINT AS fold, product_id, """ + ", ".join(f"round(sum(z * CASE c {' '.join(f'WHEN {i} THEN {MATRIX[i][j]}e0' for i in range(4))} END), 5) AS e{j}" for j in range(3)) + " FROM n GROUP BY ALL", ("patch",))
def M10_fold_safe_embedding(spark, d):
    p = A.patch(spark, d)
    folds = spark.createDataFrame([(0,), (1,)], "fold long")
    v = satellite.as_vectors(satellite.channel_stats(p.join(F.broadcast(folds), F.col("product_id") % 3 != F.col("fold")), 4, 16, ["fold"]), ["fold"])
    n = p.crossJoin(F.broadcast(v)).withColumn("n", satellite.normalise("pixels", "means", "scales", 16))
    mean = F.array(*[F.aggregate(F.slice("n", c * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x) / 16 for c in range(4)])
    e = n.withColumn("e", satellite.project(mean, MATRIX))
    return e.select("fold", "product_id", *[F.round(F.col("e")[j], 5).alias(f"e{j}") for j in range(3)])


@query("""
WITH k AS (SELECT product_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY product_id) - 1 AS k, count(*) OVER (PARTITION BY site_id) AS n FROM patch),
i AS (SELECT site_id, n, unnest(range(least(n, 5))) AS i FROM (SELECT DISTINCT site_id, n FROM k))
SELECT k.site_id, product_id FROM k JOIN (SELECT DISTINCT site_id, i * (n - 1) // greatest(least(n, 5) - 1, 1) AS k FROM i) USING (site_id, k)
""", ("patch",))
def L04_even_sample(spark, d):
    return windows.even_sample(A.patch(spark, d).select("product_id", "site_id"), ["site_id"], "product_id", 5)


@query(CHANNELS + """, k AS (SELECT product_id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY product_id) - 1 AS k, count(*) OVER (PARTITION BY site_id) AS n FROM patch),
i AS (SELECT site_id, n, unnest(range(least(n, 5))) AS i FROM (SELECT DISTINCT site_id, n FROM k)),
sample AS (SELECT product_id FROM k JOIN (SELECT DISTINCT site_id, i * (n - 1) // greatest(least(n, 5) - 1, 1) AS k FROM i) USING (site_id, k)),
s AS (SELECT c, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x WHERE product_id IN (SELECT product_id FROM sample) GROUP BY c),
z AS (SELECT product_id, x.c, avg((v - m) / s) AS z FROM x JOIN s ON s.c = x.c GROUP BY ALL),
e AS (SELECT product_id, sum(z * CASE c """ + " ".join(f"WHEN {i} THEN {MATRIX[i][0]}e0" for i in range(4)) + """ END) AS e0 FROM z GROUP BY product_id),
r AS (SELECT p.site_id, p.time_idx AS matched_ts, e0 FROM patch p JOIN e USING (product_id)),
l AS (SELECT site_id, unnest(range(min(time_idx), max(time_idx) + 1, 4)) AS time_idx FROM patch GROUP BY site_id),
j AS (SELECT l.site_id, l.time_idx, CASE WHEN l.time_idx - matched_ts <= 6 THEN matched_ts END AS hit, CASE WHEN l.time_idx - matched_ts <= 6 THEN e0 END AS e0 FROM l ASOF LEFT JOIN r ON l.site_id = r.site_id AND l.time_idx >= r.matched_ts)
SELECT site_id, count(*) AS rows, count(hit) AS matched, count(hit) / count(*) AS rate, round(avg(coalesce(e0, 0e0)::FLOAT::DOUBLE), 5) AS mean_embedding FROM j GROUP BY ROLLUP (site_id)
""", ("patch",))
def M11_A22_satellite_alignment(spark, d):
    """Sample, statistics, encoding of every patch, alignment to each site's slots, filling, summary."""
    p = A.patch(spark, d)
    sample = windows.even_sample(p, ["site_id"], "product_id", 5)
    v = satellite.as_vectors(satellite.channel_stats(sample, 4, 16))  # one row
    n = p.crossJoin(F.broadcast(v)).withColumn("n", satellite.normalise("pixels", "means", "scales", 16))
    mean = F.array(*[F.aggregate(F.slice("n", c * 16 + 1, 16), F.lit(0.0), lambda a, x: a + x) / 16 for c in range(4)])
    encoded = n.select("site_id", "time_idx", satellite.project(mean, MATRIX)[0].alias("e0"))
    slots = p.groupBy("site_id").agg(F.sequence(F.min("time_idx"), F.max("time_idx"), F.lit(4).cast("long")).alias("all")).select("site_id", F.explode("all").alias("time_idx"))
    a = satellite.fill_missing(joins.asof_backward(slots, encoded, "site_id", "time_idx", ["e0"], 6), {"e0": 0.0})
    means = a.rollup("site_id").agg(F.round(F.avg("e0"), 5).alias("mean_embedding"))
    both = satellite.alignment_summary(a, "site_id").alias("s").join(means.alias("m"), F.col("s.site_id").eqNullSafe(F.col("m.site_id")))
    return both.select("s.*", "m.mean_embedding")


@query("SELECT product_id, coalesce(CASE WHEN product_id % 3 <> 0 THEN pixels[1] END, 0e0)::FLOAT::DOUBLE AS cloud, coalesce(CASE WHEN product_id % 4 <> 0 THEN 0e0 END, 1e0) AS missing FROM patch", ("patch",))
def P10_fill_defaults(spark, d):
    p = A.patch(spark, d).select("product_id", F.when(F.col("product_id") % 3 != 0, F.col("pixels")[0]).alias("cloud"), F.when(F.col("product_id") % 4 != 0, 0.0).alias("missing"))
    f = satellite.fill_missing(p, {"cloud": 0.0, "missing": 1.0})
    return f.withColumns({c: F.col(c).cast("double") for c in ("cloud", "missing")})


@query("""
WITH j AS (SELECT product_id, pixels, label % 3 AS r, label % 4 AS q FROM patch JOIN embeddings ON vec_id = product_id),
w AS (SELECT product_id, list_transform(range(16), lambda k: CASE WHEN k % 4 // 2 + r - 1 BETWEEN 0 AND 3 AND k % 2 + q - 1 BETWEEN 0 AND 3 THEN pixels[CAST(k // 4 * 16 + (k % 4 // 2 + r - 1) * 4 + k % 2 + q - 1 + 1 AS BIGINT)] END) AS x FROM j),
f AS (SELECT product_id, list_filter(x, lambda v: v IS NOT NULL) AS k FROM w)
SELECT product_id, 1 - len(k) / 16e0 AS missing_fraction, CASE WHEN len(k) = 0 THEN 'missing' WHEN len(k) < 16 THEN 'degraded' ELSE 'ok' END AS status FROM f
""", ("patch",))
def M16_product_to_patch(spark, d):
    p = A.patch(spark, d).withColumn("pixels", satellite.centre("pixels", 4, 4, 4, F.col("site_id") % 3, F.col("site_id") % 4, 2))
    return p.withColumns(satellite.patch_status("pixels", 16)).select("product_id", "missing_fraction", "status")


@query(CHANNELS + """, s AS (SELECT c, avg(v) AS m, greatest(stddev_pop(v), 1e-6) AS s FROM x GROUP BY c),
g AS (SELECT *, CASE WHEN product_id % 7 <> 0 THEN list_transform(range(16), lambda k: power(k // 4 + product_id % 3 * 0.25e0 - site_id % 4 - 0.5e0, 2) + power(k % 4 - site_id % 5, 2)) END AS d, CASE WHEN product_id % 11 = 4 THEN 'time is not UTC' WHEN product_id % 13 = 6 THEN 'wrong shape' END AS reason FROM patch),
p AS (SELECT product_id, pixels, reason, coalesce(list_position(d, list_min(d)) - 1, 10)::BIGINT AS pixel FROM g),
i AS (SELECT *, unnest(range(16)) AS i FROM p),
y AS (SELECT *, i // 4 AS c, pixel // 4 + i % 4 // 2 - 1 AS r, pixel % 4 + i % 2 - 1 AS q FROM i),
w AS (SELECT *, CASE WHEN r BETWEEN 0 AND 3 AND q BETWEEN 0 AND 3 THEN pixels[CAST(c * 16 + r * 4 + q + 1 AS BIGINT)] END AS v FROM y)
SELECT product_id, pixel, reason, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN count(v) = 0 THEN 'missing' WHEN count(v) < 16 THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN reason IS NULL THEN 1 - count(v) / 16e0 END AS missing_fraction,
  CASE WHEN reason IS NULL THEN round(avg((v - m) / s) FILTER (w.c = 0), 6) END AS mean_0, CASE WHEN reason IS NULL THEN round(max((v - m) / s) FILTER (w.c = 3), 6) END AS max_3, product_id || ':' || pixel || ':normalised' AS origin
FROM w JOIN s ON s.c = w.c GROUP BY product_id, pixel, reason
""", ("patch",))
def M16_product_to_features(spark, d):
    """Nearest pixel, window, normalisation, check, features and provenance; some products fail."""
    p = A.patch(spark, d)
    v = satellite.as_vectors(satellite.channel_stats(p, 4, 16))  # one row
    n, at = F.col("product_id"), F.sequence(F.lit(0), F.lit(15))
    made = p.withColumns({
        "ts": F.concat(F.lit("2024-01-01T00:00:00"), F.when(n % 11 == 4, "+02:00").otherwise("Z")), "pixels": F.when((n % 13 == 6) & (n % 11 != 4), F.slice("pixels", 1, 63)).otherwise(F.col("pixels")),
        "lats": F.transform(at, lambda k: F.lit(40.0) + F.floor(k / 4) + n % 3 * 0.25), "lons": F.transform(at, lambda k: F.lit(5.0) + k % 4),
        "lat": F.when(n % 7 != 0, F.lit(40.5) + F.col("site_id") % 4), "lon": F.lit(5.0) + F.col("site_id") % 5,
    })
    f = satellite.site_features(made.crossJoin(F.broadcast(v)), 4, 4, 4, 2, (0, 2), (2, 4), "normalised")
    origin = F.concat_ws(":", F.col("provenance.product").cast("string"), F.col("provenance.pixel").cast("string"), "provenance.variant")
    return rounded(f.select("product_id", "pixel", "reason", "status", "missing_fraction", "mean_0", "max_3", origin.alias("origin")))
