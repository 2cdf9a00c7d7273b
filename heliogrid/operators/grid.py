"""Production readings on the canonical 15-minute grid, and their sources' shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..session import settled
from .checks import unique

#: Names under which site metadata come, by what they mean; the first that is present counts.
ALIASES = {
    "site_id": ("site_id", "alt_id", "id", "site"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "capacity_mw": ("capacity_mw",),
    "capacity_kw": ("capacity_kw", "Pinst_kW", "kwp", "pv_max"),
}


#: Slots of a stretch of a site's grid, which one task fills.
STRETCH = 4096


def normalise_metadata(meta: DataFrame) -> DataFrame:
    """(site_id, lat, lon, capacity_mw) from the first known alias of each; kW become MW."""
    found = {k: next((c for c in names if c in meta.columns), None) for k, names in ALIASES.items()}
    missing = [k for k in ("site_id", "lat", "lon") if not found[k]]
    if missing or not (found["capacity_mw"] or found["capacity_kw"]):
        raise ValueError(f"metadata lack {missing or ['capacity']}")
    capacity = F.col(found["capacity_mw"]) if found["capacity_mw"] else F.col(found["capacity_kw"]) / 1000
    return meta.select(F.col(found["site_id"]).cast("string").alias("site_id"), *[F.col(found[k]).cast("double").alias(k) for k in ("lat", "lon")], capacity.cast("double").alias("capacity_mw"))


def wide_to_long(wide: DataFrame, ts: str, kind: str = "power_kw", timezone: str | None = None) -> DataFrame:
    """(site_id, ts, energy_mwh): a column for each site becomes rows; wall-clock times of `timezone` become UTC."""
    sites = [c for c in wide.columns if c != ts]
    value = {"power_kw": fx.power_to_energy("value"), "energy_mwh": F.col("value")}.get(kind)
    if value is None:
        raise ValueError(f"unknown kind of value {kind!r}")
    long = wide.withColumns({c: F.col(f"`{c}`").cast("double") for c in sites}).unpivot([ts], sites, "site_id", "value")
    at = F.to_utc_timestamp(ts, timezone) if timezone else F.col(ts)
    return long.select("site_id", at.alias(ts), value.alias("energy_mwh"))


def without_metadata(long: DataFrame, meta: DataFrame) -> DataFrame:
    """Site ids of series that no metadata row describes."""
    return long.select("site_id").distinct().join(meta, "site_id", "left_anti")


def canonical_grid(observations: DataFrame, sites: DataFrame, extra: list[str] = (), source: str = "unknown") -> DataFrame:
    """One row for each site and slot from its first to its last observation.

    observations: (site_id, time_idx, energy_mwh, ...) with unique keys; sites:
    (site_id, capacity_mw), one row each. Negative energy counts as missing; a gap
    is NULL with observation_available false and quality_status `missing`, never 0.
    Each observation makes the gap after it, within a stretch of STRETCH slots of the
    site, so that only observations are shuffled, and a long series is many groups.
    """
    o = observations.where("site_id IS NOT NULL AND time_idx IS NOT NULL").withColumn("energy_mwh", F.when(F.col("energy_mwh") >= 0, F.col("energy_mwh")))
    piece = lambda c: F.floor(F.col(c) / STRETCH).cast("long")
    ends = o.groupBy("site_id").agg(F.min("time_idx").alias("lo"), F.max("time_idx").alias("hi"))
    begins = ends.withColumn("__piece", F.explode(F.sequence(piece("lo"), piece("hi"))))
    at, until = F.greatest("lo", F.col("__piece") * STRETCH), F.least("hi", (F.col("__piece") + 1) * STRETCH - 1)
    begins = begins.select("site_id", "__piece", at.alias("time_idx"), until.alias("__until"))
    rows = begins.unionByName(o.select("site_id", piece("time_idx").alias("__piece"), "time_idx", F.struct("energy_mwh", *extra).alias("__seen")), allowMissingColumns=True)
    w = Window.partitionBy("site_id", "__piece").orderBy("time_idx", F.col("__until").isNull())  # the beginning of a stretch comes first
    rows = rows.join(sites, "site_id").withColumns({"__next": F.lead("time_idx").over(w), "__last": F.first("__until").over(w)})
    gap = F.coalesce(F.col("__next"), F.col("__last") + 1) - F.col("time_idx")
    slots = F.greatest(gap, F.col("__seen").isNotNull().cast("long"))
    rows = rows.where(slots > 0).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)))
    value = lambda c: F.when(F.col("__k") == 0, F.col(f"__seen.{c}")).alias(c)
    out = rows.select("site_id", (F.col("time_idx") + F.col("__k")).alias("time_idx"), value("energy_mwh"), *[value(c) for c in extra], *[c for c in sites.columns if c != "site_id"])
    seen = F.col("energy_mwh").isNotNull()
    return out.withColumns(
        {
            "capacity_factor": fx.capacity_factor("energy_mwh", "capacity_mw"),
            "observation_available": seen,
            "quality_status": F.when(seen, "ok").otherwise("missing"),
            "source": F.lit(source),
        }
    )


def canonical_series(observations: DataFrame, sites: DataFrame, ts: str = "ts", step: int = 900, source: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(grid, exclusions) of observations (site_id, ts, energy_mwh) at instants.

    Each site's grid goes from its first observation, which is not rounded, by
    `step` seconds to its last; times that can't be read and those off the grid are
    exclusions with a reason. Two observations of a site at one time, and an input
    without any time that can be read, are errors.
    """
    us = F.unix_micros(ts)
    o = observations.withColumn("__us", us)
    first = settled(o.where("__us IS NOT NULL").groupBy("site_id").agg(F.min("__us").alias("__first")))
    if first.isEmpty():
        raise ValueError("no observation")
    o = o.join(first, "site_id", "left").withColumn("time_idx", F.expr(f"(__us - __first) div {step * 1_000_000}"))
    reason = F.when(F.col("__us").isNull(), "malformed_timestamp").when((F.col("__us") - F.col("__first")) % (step * 1_000_000) != 0, "off_grid")
    o = o.withColumn("reason", reason)
    good = unique(o.where("reason IS NULL"), ["site_id", "time_idx"]).select("site_id", "time_idx", "energy_mwh")
    at = F.timestamp_micros(F.col("__first") + F.col("time_idx") * (step * 1_000_000))
    grid = canonical_grid(good, sites, source=source).join(first, "site_id").withColumn(ts, at).drop("__first")
    return grid, o.where("reason IS NOT NULL").select("site_id", ts, "reason")


def regular_series(df: DataFrame, order: str, step: int) -> DataFrame:
    """One series at every `step` from its first to its last value of order."""
    ends = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias(order)).join(df, order, "left")


def manifest(canonical: DataFrame) -> DataFrame:
    """Counts and ranges for each site, and, of these, for all with site_id NULL."""
    cf = F.col("capacity_factor")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sites = canonical.groupBy("site_id").agg(
        F.count("*").alias("rows"),
        count(F.col("observation_available")).alias("observed"),
        count(~F.col("observation_available")).alias("gaps"),
        F.min("time_idx").alias("first_idx"),
        F.max("time_idx").alias("last_idx"),
        F.min(cf).alias("cf_min"),
        F.max(cf).alias("cf_max"),
        count(cf > 1).alias("above_one"),
        count(cf < 0).alias("below_zero"),
    )
    least, most = ("first_idx", "cf_min"), ("last_idx", "cf_max")
    return sites.rollup("site_id").agg(*[(F.min(c) if c in least else F.max(c) if c in most else F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in sites.columns[1:]])


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} AS double)")


def parse_sheets(rows: DataFrame, timezone: str, by: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records, exclusions) of sheet rows (by, source_sheet, source_row, a..g as text); by names whose sheets they are.

    Sheets are named like Q1_25. The first quarter has the date in a (text or a
    spreadsheet's day number), an interval that begins HH.MM.SS in b, plan in c,
    actual in d, from row 3; the others have the time in a, plan in f, actual in
    g, from row 4. Rows without either value are skipped; those whose time can't
    be read are exclusions. A wall-clock time seen twice in a sheet is the later
    one the second time.
    """
    r = rows.where(F.col("source_sheet").rlike(r"^Q[1-4]_\d{2}$"))
    first = F.col("source_sheet").startswith("Q1")
    r = r.where(F.when(first, F.col("source_row") >= 3).otherwise(F.col("source_row") >= 4))
    serial = F.expr("try_cast(a AS double)")
    whole = F.floor(serial).cast("int")
    day = F.coalesce(F.when(F.col("a").rlike(r"^\d{4}-\d{2}-\d{2}"), F.expr("try_cast(substr(a, 1, 10) AS date)")), F.when(serial.between(1, 2958465), F.date_add(F.lit("1899-12-30").cast("date"), whole)))
    clock = F.regexp_extract(F.coalesce("b", F.lit("")), r"^(\d{2})\.(\d{2})\.(\d{2})", 0)
    q1 = F.expr("try_cast(concat(cast(__day AS string), ' ', replace(__clock, '.', ':')) AS timestamp)")
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("long")
    by_serial = F.when(serial.between(1, 2958465), F.timestamp_seconds(F.unix_date(F.col("__day")).cast("long") * 86400 + seconds))
    later = F.when(F.length("a") >= 16, F.expr("try_cast(a AS timestamp)"))
    r = r.withColumns({"__day": day, "__clock": clock})
    r = r.withColumns(
        {
            "local": F.when(first, F.when(F.col("__clock") != "", q1)).otherwise(F.coalesce(later, by_serial)),
            "planned": F.when(first, _number("c")).otherwise(_number("f")),
            "actual": F.when(first, _number("d")).otherwise(_number("g")),
        }
    ).where("planned IS NOT NULL OR actual IS NOT NULL")
    exclusions = r.where("local IS NULL").select(*by, "source_sheet", "source_row", F.lit("malformed_timestamp").alias("reason"))
    nth = F.row_number().over(Window.partitionBy(*by, "source_sheet", "local").orderBy("source_row")) - 1
    good = r.where("local IS NOT NULL").withColumn("__nth", nth)
    records = good.select(*by, "source_sheet", "source_row", fx.local_to_utc("local", F.lit(timezone), "__nth").alias("timestamp_utc"), "planned", "actual")
    return records, exclusions


def production_dataset(sheets: DataFrame, sites: DataFrame, timezone: str) -> tuple[DataFrame, DataFrame]:
    """(canonical series, exclusions (site_id, reason)) of the sites' sheets: the actual is the energy, and rows
    whose time can't be read or is off the grid of the site are exclusions."""
    records, malformed = parse_sheets(sheets, timezone, ["site_id"])
    o = settled(records.select("site_id", F.col("timestamp_utc").alias("ts"), F.col("actual").alias("energy_mwh")))  # parsed once
    series, dropped = canonical_series(o, sites, source="sheets")
    return series, malformed.select("site_id", "reason").unionByName(dropped.select("site_id", "reason"))


def sheet_summary(rows: DataFrame) -> DataFrame:
    """(source_sheet, rows, last_row, columns): columns counts those with any value."""
    cells = sum((F.max(F.col(c).isNotNull().cast("long")) for c in "bcdefg"), F.max(F.col("a").isNotNull().cast("long")))
    return rows.groupBy("source_sheet").agg(F.count("*").alias("rows"), F.max("source_row").alias("last_row"), cells.alias("columns"))
