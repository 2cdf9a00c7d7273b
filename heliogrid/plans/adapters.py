"""Solar-shaped tables derived from the given ones, and the same as SQL.

Each function returns a DataFrame; its entry in SQL is a common table expression
of that name over the given tables. Time is the LONG number of a 15-minute slot
or hour, so that no time zone enters a comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import slot_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; wall-clock times become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def pv(spark, d) -> DataFrame:
    """(site_id, time_idx, energy): site is the event type."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("site_id"), slot_index("ts").alias("time_idx")).agg(F.round(F.sum("value"), 6).alias("energy"))


def pv_user(spark, d) -> DataFrame:
    """(site_id, time_idx, energy): site is the user, and most slots are missing."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("site_id"), slot_index("ts").alias("time_idx")).agg(F.round(F.sum("value"), 6).alias("energy"))


def site(spark, d) -> DataFrame:
    """(site_id, lat, lon, timezone, capacity_mw) of pv."""
    return pv(spark, d).groupBy("site_id").agg((F.max("energy") * 4.0).alias("capacity_mw")).select(
        "site_id",
        (F.lit(40.0) + F.length("site_id")).alias("lat"),
        (F.lit(5.0) + F.length("site_id")).alias("lon"),
        F.when(F.length("site_id") % 2 == 0, "Europe/Helsinki").otherwise("Europe/Ljubljana").alias("timezone"),
        "capacity_mw",
    )


def production(spark, d) -> DataFrame:
    """(site_id, time_idx, energy, cf): pv on its full grid; cf is NULL in a gap."""
    p = pv(spark, d)
    ends = p.groupBy("site_id").agg(F.min("time_idx").alias("lo"), F.max("time_idx").alias("hi"), F.max("energy").alias("top"))
    grid = ends.select("site_id", "top", F.explode(F.sequence("lo", "hi")).alias("time_idx"))
    return grid.join(p, ["site_id", "time_idx"], "left").select("site_id", "time_idx", "energy", F.round(F.col("energy") / F.col("top"), 6).alias("cf"))


def sky(spark, d) -> DataFrame:
    """production with a made-up clear-sky curve `cs` of the hour of the day, 0 at night."""
    day = F.col("time_idx") % 96
    return production(spark, d).withColumn("cs", F.when((day >= 24) & (day < 72), F.round(F.sin((day - 24) / 48.0 * F.lit(3.141592653589793)), 6)).otherwise(0.0))


def nwp(spark, d) -> DataFrame:
    """(issue, step, variable, value): hourly sums of events, issued every 6 hours for 12 hours."""
    e = table(spark, d, "events")
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000).cast("long")
    h = e.groupBy(hour.alias("hour"), F.col("event_type").alias("variable")).agg(F.round(F.sum("value"), 6).alias("value"))
    h = h.withColumn("issue", F.explode(F.sequence(F.floor((F.col("hour") - 12 + 5) / 6).cast("long") * 6, F.floor(F.col("hour") / 6).cast("long") * 6, F.lit(6).cast("long"))))
    return h.select("issue", (F.col("hour") - F.col("issue")).alias("step"), "variable", "value").where("step between 0 and 12")


def forecasts(spark, d) -> DataFrame:
    """(site_id, issue_idx, time_idx, horizon, fold, elev, actual, point, scratch, smart, q02..q98): horizons 1 to 4 of sky."""
    s = sky(spark, d)
    a = s.select("site_id", F.col("time_idx").alias("issue_idx"), F.coalesce("cf", F.lit(0.0)).alias("last"), F.explode(F.array(*[F.lit(h).cast("long") for h in (1, 2, 3, 4)])).alias("horizon"))
    b = s.select("site_id", "time_idx", F.col("cf").alias("actual"), "cs")
    j = a.withColumn("time_idx", F.col("issue_idx") + F.col("horizon")).join(b, ["site_id", "time_idx"])
    point = F.round((F.col("last") + 2 * F.col("cs")) / 3.0, 6)
    cols = {f"q{q:02d}": F.round(point * (0.4 + q / 100.0) / 1.1, 6) for q in (2, 10, 25, 50, 75, 90, 98)}
    return j.select("site_id", "issue_idx", "time_idx", "horizon", F.floor(F.col("time_idx") / 960).cast("long").alias("fold"), (F.col("cs") * 60.0 - 1.0).alias("elev"), "actual", point.alias("point"), F.round(F.col("last") / 1.1, 6).alias("scratch"), F.round(F.col("cs") * 0.8, 6).alias("smart"), *[c.alias(n) for n, c in cols.items()])


def patch(spark, d) -> DataFrame:
    """(product_id, site_id, time_idx, pixels): 4 channels of 4 x 4 pixels."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("product_id"), F.col("label").cast("long").alias("site_id"), (F.col("vec_id") * 1).alias("time_idx"), F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("pixels"))


def products(spark, d) -> DataFrame:
    """(seq, product_id, status, happened): a log of what happened to products."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("product_id"), F.col("event_type").alias("status"), F.unix_micros("ts").alias("happened"))


def coverage(spark, d) -> DataFrame:
    """(grp, lo, hi): half-open intervals in days, some empty."""
    o = table(spark, d, "orders")
    day = F.floor(F.unix_micros("o_orderdate") / 86_400_000_000).cast("long")
    return o.select(F.concat_ws("-", "o_orderstatus", (F.col("o_custkey") % 50).cast("string")).alias("grp"), day.alias("lo"), (day + F.col("o_custkey") % 5).alias("hi"), F.col("o_orderkey").alias("interval_id"))


SQL = {
    "pv": "SELECT event_type AS site_id, epoch_us(ts) // 900000000 AS time_idx, round(sum(value), 6) AS energy FROM events GROUP BY ALL",
    "pv_user": "SELECT user_id AS site_id, epoch_us(ts) // 900000000 AS time_idx, round(sum(value), 6) AS energy FROM events GROUP BY ALL",
    "site": "SELECT site_id, 40e0 + length(site_id) AS lat, 5e0 + length(site_id) AS lon, CASE WHEN length(site_id) % 2 = 0 THEN 'Europe/Helsinki' ELSE 'Europe/Ljubljana' END AS timezone, max(energy) * 4e0 AS capacity_mw FROM pv GROUP BY site_id",
    "production": "SELECT g.site_id, g.time_idx, p.energy, round(p.energy / g.top, 6) AS cf FROM (SELECT site_id, top, unnest(range(lo, hi + 1)) AS time_idx FROM (SELECT site_id, min(time_idx) AS lo, max(time_idx) AS hi, max(energy) AS top FROM pv GROUP BY site_id)) g LEFT JOIN pv p ON p.site_id = g.site_id AND p.time_idx = g.time_idx",
    "sky": "SELECT *, CASE WHEN time_idx % 96 >= 24 AND time_idx % 96 < 72 THEN round(sin((time_idx % 96 - 24) / 48e0 * 3.141592653589793e0), 6) ELSE 0e0 END AS cs FROM production",
    "hourly": "SELECT epoch_us(ts) // 3600000000 AS hour, event_type AS variable, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    "nwp": "SELECT i.issue, h.hour - i.issue AS step, h.variable, h.value FROM hourly h, (SELECT DISTINCT hour // 6 * 6 + k.k AS issue FROM hourly, (SELECT unnest([-12, -6, 0]) AS k) k) i WHERE h.hour - i.issue BETWEEN 0 AND 12",
    "forecasts0": "SELECT a.site_id, a.time_idx AS issue_idx, b.time_idx, h.h AS horizon, b.time_idx // 960 AS fold, b.cs * 60e0 - 1e0 AS elev, b.cf AS actual, round((coalesce(a.cf, 0e0) + 2 * b.cs) / 3e0, 6) AS point, round(coalesce(a.cf, 0e0) / 1.1e0, 6) AS scratch, round(b.cs * 0.8e0, 6) AS smart FROM sky a, (SELECT unnest([1, 2, 3, 4])::BIGINT AS h) h, sky b WHERE b.site_id = a.site_id AND b.time_idx = a.time_idx + h.h",
    "forecasts": "SELECT *, " + ", ".join(f"round(point * (0.4e0 + {q} / 100e0) / 1.1e0, 6) AS q{q:02d}" for q in (2, 10, 25, 50, 75, 90, 98)) + " FROM forecasts0",
    "patch": "SELECT vec_id AS product_id, label::BIGINT AS site_id, vec_id AS time_idx, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS pixels FROM embeddings",
    "products": "SELECT event_id AS seq, user_id AS product_id, event_type AS status, epoch_us(ts) AS happened FROM events",
    "coverage": "SELECT o_orderstatus || '-' || (o_custkey % 50)::VARCHAR AS grp, epoch_us(o_orderdate) // 86400000000 AS lo, epoch_us(o_orderdate) // 86400000000 + o_custkey % 5 AS hi, o_orderkey AS interval_id FROM orders",
}
_NEEDS = {"site": ["pv"], "production": ["pv"], "sky": ["production"], "nwp": ["hourly"], "forecasts0": ["sky"], "forecasts": ["forecasts0"]}


def ctes(*names: str) -> str:
    """The common table expressions of the names and of what they need, without WITH."""
    order: list[str] = []

    def add(name):
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return ", ".join(f"{n} AS ({SQL[n]})" for n in order)
