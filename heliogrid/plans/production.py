"""Queries on the canonical grid, scalar functions and series windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import checks, forecast, grid, windows
from ..session import shared_folder
from ..sources import io
from . import adapters as A
from .registry import query


def r6(c):
    return F.round(c, 6)


def rounded(df, *keep, places=6):
    """df with its doubles rounded; sums and sines then agree across engines."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double" and c not in keep})


@query("SELECT p.*, s.capacity_mw, s.lat FROM pv p JOIN site s USING (site_id)", ("pv", "site"))
def S01_read_join_sites(spark, d):
    """Readings from CSV, site metadata from Parquet, each by its suffix."""
    folder = shared_folder(spark, "tabular")
    A.pv(spark, d).write.option("header", True).csv(f"{folder}/pv.csv")
    A.site(spark, d).select("site_id", "capacity_mw", "lat").write.parquet(f"{folder}/site.parquet")
    readings = io.read_tabular(spark, f"{folder}/pv.csv", "site_id string, time_idx long, energy double")
    return readings.join(io.read_tabular(spark, f"{folder}/site.parquet"), "site_id")


WIDE = "SELECT time_idx, " + ", ".join(f"max(CASE WHEN site_id = '{s}' THEN energy END) AS {s}" for s in ("click", "view", "purchase")) + " FROM pv GROUP BY time_idx"


def _wide(spark, d):
    return A.pv(spark, d).groupBy("time_idx").pivot("site_id", ["click", "view", "purchase"]).agg(F.max("energy"))


@query(f"SELECT site_id, time_idx, round(value / 1000e0 * 0.25e0, 9) AS energy_mwh FROM (UNPIVOT ({WIDE}) ON click, view, purchase INTO NAME site_id VALUE value)", ("pv",))
def S02_wide_to_long(spark, d):
    long = grid.wide_to_long(_wide(spark, d), "time_idx", "power_kw").where("energy_mwh IS NOT NULL")
    return long.withColumn("energy_mwh", F.round("energy_mwh", 9))


@query("SELECT s_suppkey::VARCHAR AS site_id, (s_nationkey + 30)::DOUBLE AS lat, (s_nationkey + 5)::DOUBLE AS lon, round(abs(s_acctbal) / 1000e0, 9) AS capacity_mw FROM supplier")
def S03_metadata_aliases(spark, d):
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("alt_id"), (F.col("s_nationkey") + 30).alias("latitude"), (F.col("s_nationkey") + 5).alias("lon"), F.abs("s_acctbal").alias("Pinst_kW"))
    return grid.normalise_metadata(s).withColumn("capacity_mw", F.round("capacity_mw", 9))


def _sheets(spark, d):
    e = A.table(spark, d, "events")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    n = F.col("event_id")
    first = n % 4 == 0
    return e.select(
        F.when(n % 50 == 49, "notes").otherwise(F.concat(F.lit("Q"), (n % 4 + 1).cast("string"), F.lit("_25"))).alias("source_sheet"), n.alias("source_row"),
        F.when(n % 97 == 5, "bad").when(first, F.substring(text, 1, 10)).otherwise(text).alias("a"),
        F.when(first, F.date_format("ts", "HH.mm.ss")).alias("b"),
        F.when(first & (n % 3 == 0), F.col("value").cast("string")).alias("c"), F.when(first & (n % 5 == 0), F.col("value").cast("string")).alias("d"),
        F.lit(None).cast("string").alias("e"), F.when(~first & (n % 3 == 0), F.col("value").cast("string")).alias("f"), F.when(~first & (n % 5 == 0), "n/a").alias("g"),
    )


@query("""
SELECT CASE WHEN event_id % 50 = 49 THEN 'notes' ELSE 'Q' || (event_id % 4 + 1)::VARCHAR || '_25' END AS source_sheet, event_id AS source_row,
  epoch_us(ts) // 1000000 AS at, CASE WHEN event_id % 3 = 0 THEN round(value, 6) END AS planned, CASE WHEN event_id % 4 = 0 AND event_id % 5 = 0 THEN round(value, 6) END AS actual
FROM events WHERE event_id % 50 <> 49 AND event_id >= CASE WHEN event_id % 4 = 0 THEN 3 ELSE 4 END
  AND (event_id % 3 = 0 OR (event_id % 4 = 0 AND event_id % 5 = 0)) AND event_id % 97 <> 5
""")
def S04_parse_sheets(spark, d):
    records, _ = grid.parse_sheets(_sheets(spark, d), "UTC")
    return records.select("source_sheet", "source_row", F.unix_seconds("timestamp_utc").alias("at"), r6(F.col("planned")).alias("planned"), r6(F.col("actual")).alias("actual"))


@query("""
SELECT CASE WHEN event_id % 50 = 49 THEN 'notes' ELSE 'Q' || (event_id % 4 + 1)::VARCHAR || '_25' END AS source_sheet, event_id AS source_row, 'malformed_timestamp' AS reason
FROM events WHERE event_id % 50 <> 49 AND event_id >= 4 AND (event_id % 3 = 0 OR (event_id % 4 = 0 AND event_id % 5 = 0)) AND event_id % 97 = 5
""")
def S04_sheet_exclusions(spark, d):
    return grid.parse_sheets(_sheets(spark, d), "UTC")[1]


@query("""
WITH s AS (SELECT CASE WHEN event_id % 50 = 49 THEN 'notes' ELSE 'Q' || (event_id % 4 + 1)::VARCHAR || '_25' END AS source_sheet, event_id, event_id % 4 = 0 AS first FROM events)
SELECT source_sheet, count(*) AS rows, max(event_id) AS last_row, (1 + max((first)::INT) + max((first AND event_id % 3 = 0)::INT) + max((first AND event_id % 5 = 0)::INT) + max((NOT first AND event_id % 3 = 0)::INT) + max((NOT first AND event_id % 5 = 0)::INT))::BIGINT AS columns
FROM s GROUP BY source_sheet
""")
def S05_sheet_summary(spark, d):
    return grid.sheet_summary(_sheets(spark, d))


def _canonical(spark, d):
    return grid.canonical_grid(A.pv_user(spark, d).withColumnRenamed("energy", "energy_mwh"), _user_sites(spark, d), source="events")


def _user_sites(spark, d):
    return A.pv_user(spark, d).groupBy("site_id").agg((F.max("energy") * 4.0).alias("capacity_mw"))


CANONICAL = """
WITH s AS (SELECT site_id, min(time_idx) AS lo, max(time_idx) AS hi, max(energy) * 4e0 AS capacity_mw FROM pv_user GROUP BY site_id),
g AS (SELECT site_id, capacity_mw, unnest(range(lo, hi + 1)) AS time_idx FROM s),
c AS (SELECT g.site_id, g.time_idx, p.energy AS energy_mwh, round(p.energy / (g.capacity_mw * 0.25e0), 6) AS capacity_factor, p.energy IS NOT NULL AS observation_available,
  CASE WHEN p.energy IS NULL THEN 'missing' ELSE 'ok' END AS quality_status FROM g LEFT JOIN pv_user p ON p.site_id = g.site_id AND p.time_idx = g.time_idx)
"""


@query(CANONICAL + "SELECT * FROM c", ("pv_user",))
def F01_canonical_grid(spark, d):
    return rounded(_canonical(spark, d).drop("capacity_mw", "source"))


def _instants(spark, d):
    """Readings of users at a site's own minute of the quarter hour; a few are off it or can't be read."""
    e = A.table(spark, d, "events")
    at = F.expr("unix_micros(ts) div 900000000 * 900000000 + user_id % 7 * 60000000 + if(event_id % 10 = 3, 30000000, 0)")
    ts = F.when(F.col("event_id") % 13 != 5, F.timestamp_micros(at))
    return e.groupBy(F.col("user_id").alias("site_id"), ts.alias("ts")).agg(F.round(F.sum("value"), 6).alias("energy_mwh"))


INSTANTS = """
WITH o AS (SELECT user_id AS site_id, CASE WHEN event_id % 13 <> 5 THEN epoch_us(ts) // 900000000 * 900000000 + user_id % 7 * 60000000 + CASE WHEN event_id % 10 = 3 THEN 30000000 ELSE 0 END END AS us, round(sum(value), 6) AS energy_mwh FROM events GROUP BY ALL),
f AS (SELECT site_id, min(us) AS first FROM o GROUP BY site_id),
r AS (SELECT o.*, first, CASE WHEN us IS NULL THEN 'malformed_timestamp' WHEN (us - first) % 900000000 <> 0 THEN 'off_grid' END AS reason FROM o JOIN f USING (site_id))
"""


@query(INSTANTS + """, k AS (SELECT * FROM r WHERE reason IS NULL), g AS (SELECT site_id, unnest(range(min(us), max(us) + 1, 900000000)) AS us FROM k GROUP BY site_id)
SELECT g.site_id, g.us, k.energy_mwh, k.energy_mwh IS NOT NULL AS observation_available FROM g LEFT JOIN k USING (site_id, us)
""")
def F01_canonical_series(spark, d):
    o = _instants(spark, d)
    sites = o.select("site_id").distinct().withColumn("capacity_mw", F.lit(1.0))
    return grid.canonical_series(o, sites)[0].select("site_id", F.unix_micros("ts").alias("us"), "energy_mwh", "observation_available")


@query(INSTANTS + "SELECT site_id, us, reason FROM r WHERE reason IS NOT NULL")
def F01_exclusions(spark, d):
    o = _instants(spark, d)
    sites = o.select("site_id").distinct().withColumn("capacity_mw", F.lit(1.0))
    return grid.canonical_series(o, sites)[1].select("site_id", F.unix_micros("ts").alias("us"), "reason")


@query(CANONICAL + """
SELECT site_id, count(*) AS rows, count(energy_mwh) AS observed, count(*) - count(energy_mwh) AS gaps, min(time_idx) AS first_idx, max(time_idx) AS last_idx,
  min(capacity_factor) AS cf_min, max(capacity_factor) AS cf_max, count(*) FILTER (capacity_factor > 1) AS above_one, count(*) FILTER (capacity_factor < 0) AS below_zero
FROM c GROUP BY ROLLUP (site_id)
""", ("pv_user",))
def A12_manifest(spark, d):
    return rounded(grid.manifest(_canonical(spark, d)))


@query("SELECT site_id, time_idx, round(energy / (capacity_mw * 0.25e0), 6) AS cf FROM pv JOIN site USING (site_id)", ("pv", "site"))
def P01_capacity_factor(spark, d):
    j = A.pv(spark, d).join(A.site(spark, d), "site_id")
    return j.select("site_id", "time_idx", r6(fx.capacity_factor("energy", "capacity_mw")).alias("cf"))


@query("SELECT event_id, epoch_us(ts) // 900000000 AS time_idx, (epoch_us(ts) + 450000000) // 900000000 AS nearest_idx FROM events")
def P02_F15_slot_index(spark, d):
    return A.table(spark, d, "events").select("event_id", fx.slot_index("ts").alias("time_idx"), fx.nearest_slot("ts").alias("nearest_idx"))


@query("SELECT event_id, CASE WHEN value - 50 >= 0 THEN round(value - 50, 6) END AS energy, value - 50 >= 0 AS available, CASE WHEN value - 50 >= 0 THEN 'ok' ELSE 'missing' END AS status FROM events")
def P03_mask_negative(spark, d):
    e = A.table(spark, d, "events").withColumn("energy", r6(F.col("value") - 50))
    e = e.withColumn("energy", F.when(F.col("value") - 50 >= 0, F.col("energy")))
    return e.select("event_id", "energy", F.col("energy").isNotNull().alias("available"), F.when(F.col("energy").isNotNull(), "ok").otherwise("missing").alias("status"))


@query("SELECT p_partkey, round(p_retailprice - 273.15e0, 6) AS celsius, round(p_retailprice / 100e0, 6) AS hpa, round(p_retailprice * 1000e0, 6) AS mm, round(p_retailprice * 100e0, 6) AS percent FROM part")
def P04_unit_conversions(spark, d):
    p = F.col("p_retailprice")
    return A.table(spark, d, "part").select("p_partkey", r6(fx.kelvin_to_celsius(p)).alias("celsius"), r6(fx.pascal_to_hpa(p)).alias("hpa"), r6(fx.metres_to_mm(p)).alias("mm"), r6(fx.fraction_to_percent(p)).alias("percent"))


@query("SELECT time_idx, energy, lag(energy) OVER w AS before FROM (SELECT g.time_idx, sum(p.energy) AS energy FROM (SELECT unnest(range(min(time_idx), max(time_idx) + 1)) AS time_idx FROM pv) g LEFT JOIN (SELECT time_idx, round(sum(energy), 6) AS energy FROM pv GROUP BY 1) p USING (time_idx) GROUP BY 1) WINDOW w AS (ORDER BY time_idx)", ("pv",))
def F02_regular_series(spark, d):
    one = A.pv(spark, d).groupBy("time_idx").agg(r6(F.sum("energy")).alias("energy"))
    s = grid.regular_series(one, "time_idx", 1)
    before = one.select((F.col("time_idx") + 1).alias("time_idx"), F.col("energy").alias("before"))
    return s.join(before, "time_idx", "left")


@query("""
SELECT event_id, epoch_us(ts AT TIME ZONE 'Europe/Helsinki') // 1000000 AS utc, epoch_us(timezone('Europe/Ljubljana', ts AT TIME ZONE 'UTC')) // 1000000 AS local FROM events
""")
def F03_F04_time_zones(spark, d):
    e = A.table(spark, d, "events")
    return e.select("event_id", F.unix_seconds(fx.local_to_utc("ts", F.lit("Europe/Helsinki"), F.lit(0))).alias("utc"), F.unix_seconds(fx.local_time("ts", F.lit("Europe/Ljubljana"))).alias("local"))


@query("""
WITH p AS (SELECT event_id, (60 * hour(ts) + minute(ts)) / 1440e0 AS df, dayofyear(ts) AS dy FROM events)
SELECT event_id, """ + ", ".join(f"round({f}(2e0 * pi() * {k}e0 * {phase}), 6) AS {name}_{f}_{k}" for name, phase in (("year", "((dy + df) / 365.25e0)"), ("day", "df")) for k in (1, 2) for f in ("sin", "cos")) + " FROM p")
def F05_harmonics(spark, d):
    return rounded(A.table(spark, d, "events").withColumns(fx.harmonics("ts")).select("event_id", *fx.harmonics("ts")), "event_id")


SUN = """
WITH a AS (SELECT event_id, 40e0 + user_id % 25 AS lat, 5e0 + user_id % 25 AS lon, (epoch_us(ts) // 1000000 - 946728000) / 86400e0 AS dd FROM events),
b AS (SELECT *, dd / 36525e0 AS c FROM a),
m AS (SELECT *, ((280.46646e0 + 36000.76983e0 * c + 0.0003032e0 * c * c) % 360e0 + 360e0) % 360e0 AS l0, ((357.52911e0 + 35999.05029e0 * c - 0.0001537e0 * c * c) % 360e0 + 360e0) % 360e0 AS an FROM b),
e AS (SELECT *, ((l0 + (1.914602e0 - 0.004817e0 * c - 0.000014e0 * c * c) * sin(radians(an)) + (0.019993e0 - 0.000101e0 * c) * sin(radians(2e0 * an)) + 0.000289e0 * sin(radians(3e0 * an))) % 360e0 + 360e0) % 360e0 AS ec,
  23.439291e0 - 0.0130042e0 * c - 0.00000016e0 * c * c + 0.000000504e0 * c * c * c AS ti FROM m),
r AS (SELECT *, (degrees(atan2(cos(radians(ti)) * sin(radians(ec)), cos(radians(ec)))) % 360e0 + 360e0) % 360e0 AS ra, asin(sin(radians(ti)) * sin(radians(ec))) AS de,
  ((280.46061837e0 + 360.98564736629e0 * dd + 0.000387933e0 * c * c - c * c * c / 38710000e0) % 360e0 + 360e0) % 360e0 AS st FROM e),
h AS (SELECT *, ((st + lon - ra) % 360e0 + 360e0) % 360e0 AS ha, radians(lat) AS phi FROM r),
s AS (SELECT *, sin(phi) * sin(de) + cos(phi) * cos(de) * cos(radians(ha)) AS se FROM h),
v AS (SELECT *, degrees(asin(least(greatest(se, -1e0), 1e0))) AS el FROM s),
z AS (SELECT *, degrees(acos(least(greatest((sin(de) - sin(phi) * se) / (cos(phi) * cos(radians(el))), -1e0), 1e0))) AS az0,
  CASE WHEN el > -1 THEN el + 0.0167e0 / tan(radians(el + 10.3e0 / (el + 5.11e0))) ELSE el END AS elevation FROM v)
"""


@query(SUN + """
SELECT event_id, round(CASE WHEN ha > 180 THEN 360e0 - az0 ELSE az0 END, 5) AS azimuth, round(elevation, 6) AS elevation,
  round(CASE WHEN elevation > 0 THEN 1361e0 * sin(radians(elevation)) * pow(0.7e0, pow(1e0 / (cos(radians(90e0 - elevation)) + 0.50572e0 * pow(96.07995e0 - (90e0 - elevation), -1.6364e0)), 0.678e0)) ELSE 0e0 END / 1361e0, 6) AS clear_sky_norm FROM z
""")
def F06_F07_sun(spark, d):
    e = A.table(spark, d, "events").select("event_id", "ts", (F.lit(40.0) + F.col("user_id") % 25).alias("lat"), (F.lit(5.0) + F.col("user_id") % 25).alias("lon"))
    azimuth, elevation = fx.solar_position("ts", "lat", "lon")
    e = e.withColumns({"azimuth": azimuth, "elevation": elevation})
    return e.select("event_id", F.round("azimuth", 5).alias("azimuth"), r6(F.col("elevation")).alias("elevation"), r6(fx.clear_sky_ghi("elevation") / fx.SOLAR_CONSTANT).alias("clear_sky_norm"))


@query("""
WITH w AS (SELECT event_id, value % 40 - 10 AS t, value % 30 - 10 AS dp, value - 50 AS u, value % 7 - 3 AS v FROM events)
SELECT event_id, round(least(greatest(100e0 * exp(17.625e0 * dp / (243.04e0 + dp) - 17.625e0 * t / (243.04e0 + t)), 0e0), 100e0), 6) AS humidity, round(sqrt(u * u + v * v), 6) AS speed,
  round(((270e0 - degrees(atan2(v, u))) % 360e0 + 360e0) % 360e0, 6) AS direction FROM w
""")
def F08_F09_humidity_wind(spark, d):
    v = F.col("value")
    w = A.table(spark, d, "events").select("event_id", (v % 40 - 10).alias("t"), (v % 30 - 10).alias("dp"), (v - 50).alias("u"), (v % 7 - 3).alias("v"))
    return w.select("event_id", r6(fx.relative_humidity("t", "dp")).alias("humidity"), r6(fx.wind_speed("u", "v")).alias("speed"), r6(fx.wind_direction("u", "v")).alias("direction"))


@query("SELECT o_orderkey, round((epoch_us(o_orderdate) - 800000000000000) / 3.6e9, 6) AS lead_hours, (epoch_us(o_orderdate) + (o_custkey % 10 + 0.5e0) * 3600000000)::BIGINT AS valid FROM orders")
def F10_lead_and_valid_time(spark, d):
    o = A.table(spark, d, "orders").withColumn("issue", F.timestamp_micros(F.lit(800000000000000)))
    return o.select("o_orderkey", r6(fx.lead_hours("issue", "o_orderdate")).alias("lead_hours"), F.unix_micros(fx.valid_time("o_orderdate", F.col("o_custkey") % 10 + 0.5)).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort(list_transform([l_discount * 12, l_tax * 9, l_quantity / 60 - 0.1e0], lambda x: least(greatest(x, 0e0), 1e0))), lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',') AS quantiles FROM lineitem")
def F11_monotone_quantiles(spark, d):
    q = fx.monotone_quantiles(F.array(F.col("l_discount") * 12, F.col("l_tax") * 9, F.col("l_quantity") / 60 - 0.1))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(q, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("quantiles"))


@query("SELECT site_id, time_idx, " + ", ".join(f"lag(energy, {k}) OVER w AS energy_lag_{k}" for k in (1, 2, 3)) + " FROM production WINDOW w AS (PARTITION BY site_id ORDER BY time_idx)", ("production",))
def W05_W06_lags(spark, d):
    return windows.lagged(A.production(spark, d), ["energy"], 3, ["site_id"], "time_idx").drop("energy", "cf")


@query("SELECT site_id, time_idx, avg(CAST(round(cf * 1e6) AS BIGINT)) OVER (PARTITION BY site_id ORDER BY time_idx ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS climatology_ppm FROM production", ("production",))
def W07_climatology(spark, d):
    p = A.production(spark, d).withColumn("ppm", F.round(F.col("cf") * 1e6).cast("long"))  # whole numbers, whose mean is exact
    return windows.rolling_means(p, {"climatology_ppm": "ppm"}, 96, ["site_id"], "time_idx").select("site_id", "time_idx", "climatology_ppm")


@query("""
WITH l AS (SELECT *, lag(cf, 96) OVER w AS y, lag(cs, 96) OVER w AS c, lag(cf, 1) OVER w AS y1, lag(cs, 1) OVER w AS c1, lead(cs, 1) OVER w AS ahead FROM sky WINDOW w AS (PARTITION BY site_id ORDER BY time_idx))
SELECT site_id, time_idx, round(CASE WHEN c <> 0 AND y IS NOT NULL THEN greatest(y / c * cs, 0e0) END, 6) AS day_before, round(CASE WHEN c1 <> 0 AND y1 IS NOT NULL THEN greatest(y1 / c1 * cs, 0e0) END, 6) AS horizon_1, round(CASE WHEN c1 <> 0 AND y1 IS NOT NULL AND ahead IS NOT NULL THEN greatest(y1 / c1 * ahead, 0e0) END, 6) AS horizon_2 FROM l
""", ("sky",))
def W08_W09_clear_sky_persistence(spark, d):
    p = lambda w, lag, ahead=0: r6(windows.clear_sky_persistence("cf", "cs", lag, ["site_id"], "time_idx", ahead, w=w))
    named = lambda w: {"day_before": p(w, 96), "horizon_1": p(w, 1), "horizon_2": p(w, 1, 1)}
    return windows.by_places(A.sky(spark, d), ["site_id"], "time_idx", named, back=96, ahead=1).drop("energy", "cf", "cs")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time_idx) AS k, count(*) OVER (PARTITION BY site_id) AS n FROM pv_user)
SELECT site_id, time_idx, CASE WHEN k <= floor(n * 0.6e0) THEN 'train' WHEN k <= floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'validation' ELSE 'test' END AS split FROM n
""", ("pv_user",))
def W11_chronological_split(spark, d):
    return windows.chronological_split(A.pv_user(spark, d).select("site_id", "time_idx"), ["site_id"], "time_idx", 0.6, 0.2)


GAPS = "SELECT site_id, time_idx, (time_idx - lag(time_idx) OVER (PARTITION BY site_id ORDER BY time_idx)) * 15 AS gap FROM pv_user"


def _gaps(spark, d):
    rows = windows.lagged(A.pv_user(spark, d), ["time_idx"], 1, ["site_id"], "time_idx")
    return rows.select("site_id", "time_idx", ((F.col("time_idx") - F.col("time_idx_lag_1")) * 15).alias("gap"))


@query(GAPS, ("pv_user",))
def W12_gap_minutes(spark, d):
    return _gaps(spark, d)


@query(f"SELECT gap, count(*) AS n FROM ({GAPS}) WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 20", ("pv_user",))
def L02_top_gaps(spark, d):
    g = _gaps(spark, d).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "gap").limit(20)


@query(f"SELECT site_id, greatest(mode_gap, 1) AS step FROM (SELECT site_id, min(gap) FILTER (c = top) AS mode_gap FROM (SELECT *, max(c) OVER (PARTITION BY site_id) AS top FROM (SELECT site_id, gap, count(*) AS c FROM ({GAPS}) WHERE gap IS NOT NULL GROUP BY ALL)) GROUP BY site_id)", ("pv_user",))
def A28_dominant_step(spark, d):
    g = _gaps(spark, d).where("gap IS NOT NULL").groupBy("site_id").agg(F.mode("gap", True).alias("m"))
    return g.select("site_id", F.greatest("m", F.lit(1)).alias("step"))


@query("SELECT site_id, h.h AS horizon, arg_max(energy, time_idx) AS forecast FROM pv_user, (SELECT unnest([1, 2])::BIGINT AS h) h GROUP BY site_id, h.h", ("pv_user",))
def W10_last_value(spark, d):
    from ..operators.baselines import last_value

    return last_value(A.pv_user(spark, d), 2, "site_id", "time_idx", "energy")


@query("""
WITH f AS (SELECT *, time_idx % 7 <> 0 AS observed, time_idx % 96 BETWEEN 24 AND 71 AS day FROM sky)
SELECT site_id, time_idx, least(greatest(coalesce(cf, 0e0), 0e0), 1e0) AS target, CASE WHEN observed THEN coalesce(cf, 0e0) ELSE 0e0 END AS observed_cf,
  round(CASE WHEN observed AND cs > 1e-6 THEN least(greatest(coalesce(cf, 0e0) / cs, 0e0), 1e0) ELSE 0e0 END, 6) AS csi, (observed AND cs > 1e-6)::INT::DOUBLE AS csi_flag,
  CASE WHEN NOT observed THEN 0e0 WHEN day THEN 1e0 ELSE 0.1e0 END AS loss_weight FROM f
""", ("sky",))
def P06_model_frame(spark, d):
    s = A.sky(spark, d).withColumn("observed", F.col("time_idx") % 7 != 0)
    f = forecast.model_frame(s, "cf", "observed", "cs", (F.col("time_idx") % 96).between(24, 71))
    return rounded(f.select("site_id", "time_idx", "target", "observed_cf", "csi", "csi_flag", "loss_weight"))


@query("SELECT site_id, issue_idx, time_idx, CASE WHEN time_idx > issue_idx + 2 THEN 0e0 ELSE point END AS cloud, CASE WHEN time_idx > issue_idx + 2 THEN 1e0 ELSE 0e0 END AS missing FROM forecasts", ("forecasts",))
def P08_mask_future(spark, d):
    f = A.forecasts(spark, d).select("site_id", "issue_idx", "time_idx", F.col("point").alias("cloud"), F.lit(0.0).alias("missing"), (F.col("issue_idx") + 2).alias("cut"))
    return forecast.mask_future(f, "time_idx", "cut", ["cloud"], "missing").drop("cut")


@query("SELECT site_id, count(*) AS rows, round(avg(energy), 6) AS mean_energy FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time_idx DESC) AS k FROM production) WHERE k <= 1344 GROUP BY site_id", ("production",))
def L07_last_two_weeks(spark, d):
    w = Window.partitionBy("site_id").orderBy(F.desc("time_idx"))
    t = A.production(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 1344")
    return t.groupBy("site_id").agg(F.count("*").alias("rows"), r6(F.avg("energy")).alias("mean_energy"))


@query("SELECT site_id, min(time_idx) AS first_idx, arg_min(energy, time_idx) AS first_energy FROM pv_user GROUP BY site_id", ("pv_user",))
def A27_first_row(spark, d):
    return A.pv_user(spark, d).groupBy("site_id").agg(F.min("time_idx").alias("first_idx"), F.min_by("energy", "time_idx").alias("first_energy"))


@query("SELECT 'order' AS kind, o_orderkey AS id, o_totalprice AS amount, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_acctbal FROM customer")
def U01_union_by_name(spark, d):
    o = A.table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    c = A.table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return o.unionByName(c, allowMissingColumns=True)


@query("SELECT time_idx FROM pv WHERE site_id = 'click' UNION SELECT time_idx FROM pv WHERE site_id = 'view'", ("pv",))
def U02_union_distinct(spark, d):
    p = A.pv(spark, d)
    return p.where("site_id = 'click'").select("time_idx").union(p.where("site_id = 'view'").select("time_idx")).distinct()


@query("SELECT time_idx FROM pv INTERSECT SELECT time_idx FROM pv_user WHERE site_id % 2 = 0", ("pv", "pv_user"))
def U03_intersection(spark, d):
    return A.pv(spark, d).select("time_idx").intersect(A.pv_user(spark, d).where("site_id % 2 = 0").select("time_idx"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def U04_difference(spark, d):
    return A.table(spark, d, "customer").select("c_custkey").subtract(A.table(spark, d, "orders").select("o_custkey"))


@query("SELECT o_custkey, o_orderkey AS first_order, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def U05_keep_first(spark, d):
    o = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("r"))
    return o.select("o_custkey", F.col("r.o_orderkey").alias("first_order"), F.col("r.o_totalprice").alias("price"))


@query("SELECT o_custkey, o_orderkey AS last_order FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def W16_latest_row(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return windows.latest(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("last_order"))


@query("SELECT s.site_id, t.target FROM (SELECT DISTINCT site_id FROM pv) s, (SELECT DISTINCT time_idx AS target FROM pv) t", ("pv",))
def U06_site_target_grid(spark, d):
    p = A.pv(spark, d)
    return p.select("site_id").distinct().crossJoin(p.select(F.col("time_idx").alias("target")).distinct())


@query("""
SELECT rule, n FROM (UNPIVOT (SELECT count(*) FILTER (NOT l_discount BETWEEN 0.02e0 AND 0.08e0) AS discount, count(*) FILTER (NOT l_quantity >= 2) AS quantity, count(*) FILTER (NOT l_tax < 0.08e0) AS tax FROM lineitem) ON discount, quantity, tax INTO NAME rule VALUE n)
""")
def V05_rule_counts(spark, d):
    return checks.violation_counts(A.table(spark, d, "lineitem"), {"discount": checks.between("l_discount", 0.02, 0.08), "quantity": F.col("l_quantity") >= 2, "tax": F.col("l_tax") < 0.08})


@query("""
WITH w AS (SELECT event_id, value % 130 - 10 AS h, value * 5 - 20 AS dir, value - 5 AS sp, value % 9 - 1 AS pr FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN NOT h BETWEEN 0 AND 100 THEN 'humidity' END, CASE WHEN NOT dir BETWEEN 0 AND 360 THEN 'direction' END, CASE WHEN NOT sp >= 0 THEN 'speed' END, CASE WHEN NOT pr >= 0 THEN 'precipitation' END], lambda x: x IS NOT NULL), ',') AS violations FROM w
""")
def V05_weather_ranges(spark, d):
    v = F.col("value")
    w = A.table(spark, d, "events").select("event_id", (v % 130 - 10).alias("relative_humidity"), (v * 5 - 20).alias("wind_direction"), (v - 5).alias("wind_speed"), (v % 9 - 1).alias("precipitation"))
    return checks.violations(w, checks.weather_rules()).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT rule, n FROM (UNPIVOT (SELECT count(*) FILTER (NOT horizon > 0) AS horizon, count(*) FILTER (NOT q90 >= q10) AS p90_p10, count(*) FILTER (NOT q90 >= q50) AS p90_p50 FROM forecasts) ON horizon, p90_p10, p90_p50 INTO NAME rule VALUE n)", ("forecasts",))
def V06_forecast_rules(spark, d):
    return checks.violation_counts(A.forecasts(spark, d), checks.forecast_rules())


@query("SELECT rule, n FROM (UNPIVOT (SELECT count(*) FILTER (NOT p_size / 50e0 > 0.1e0) AS soc_order, count(*) FILTER (NOT (p_retailprice / 1500e0 > 0 AND p_retailprice / 1500e0 <= 1)) AS efficiency, count(*) FILTER (NOT p_size - 1 > 0) AS capacity FROM part) ON soc_order, efficiency, capacity INTO NAME rule VALUE n)")
def V07_battery_rules(spark, d):
    p = A.table(spark, d, "part").select((F.col("p_size") / 50).alias("max_soc"), F.lit(0.1).alias("min_soc"), (F.col("p_retailprice") / 1500).alias("efficiency"), (F.col("p_size") - 1).alias("capacity_mwh"))
    return checks.violation_counts(p, checks.battery_rules())


@query("SELECT count(*) AS rows, count(*) FILTER (user_id % 11 = 0) AS malformed, (SELECT count(*) FROM (SELECT user_id, epoch_us(ts) // 900000000 FROM events WHERE user_id % 11 <> 0 GROUP BY ALL HAVING count(*) > 1)) AS repeated, false AS empty, 'some' AS input FROM events UNION ALL SELECT 0, 0, 0, true, 'none'")
def V08_canonical_input(spark, d):
    e = A.table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 11 != 0, fx.slot_index("ts")).alias("slot"))
    some, none = (checks.canonical_problems(rows, "user_id", "slot").withColumn("input", F.lit(n)) for n, rows in (("some", e), ("none", e.where("slot < 0"))))
    return some.unionByName(none)


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT (c_custkey % 7 > 0 AND c_custkey % 7 % 2 = 0) THEN 'even_size' END, CASE WHEN NOT c_acctbal / 100 BETWEEN -90 AND 90 THEN 'latitude' END, CASE WHEN NOT c_nationkey * 9e0 BETWEEN -180 AND 180 THEN 'longitude' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'channels' END], lambda x: x IS NOT NULL), ',') AS violations FROM customer")
def V09_site_rules(spark, d):
    c = A.table(spark, d, "customer").withColumns({"lat": F.col("c_acctbal") / 100, "lon": F.col("c_nationkey") * 9.0})
    rules = checks.site_rules(F.col("c_custkey") % 7, F.array("c_mktsegment"), ["BUILDING"])
    return checks.violations(c, rules).select("c_custkey", F.array_join("violations", ",").alias("violations"))
