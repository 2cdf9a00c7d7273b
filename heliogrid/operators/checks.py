"""Column checks, joins of a stated cardinality and row-level rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import SLOT_MICROS


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df itself; an error that lists the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself; an error that shows some of the keys that repeat. It runs a job."""
    some = duplicates(df, keys).limit(5).collect()
    if some:
        raise ValueError(f"repeated keys: {[tuple(r[k] for k in keys) for r in some]}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides have unique keys as `validate` says: one_to_one, one_to_many or many_to_one."""
    before, after = validate.split("_to_")
    if before == "one":
        unique(left, keys)
    if after == "one":
        unique(right, keys)
    return left.join(right, keys, how)


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `violations`, the names of the rules whose condition is false; one that is NULL holds."""
    named = [F.when(~rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass; rules that no row breaks are listed with 0."""
    counted = df.agg(*[F.coalesce(F.sum((~rule).cast("long")), F.lit(0)).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], list(rules), "rule", "n")


def between(name: str, low: float, high: float) -> Column:
    return F.col(name).between(low, high)


def weather_rules() -> dict[str, Column]:
    """Ranges of a weather row."""
    return {
        "humidity": between("relative_humidity", 0, 100),
        "direction": between("wind_direction", 0, 360),
        "speed": F.col("wind_speed") >= 0,
        "precipitation": F.col("precipitation") >= 0,
    }


def forecast_rules() -> dict[str, Column]:
    return {"horizon": F.col("horizon") > 0, "p90_p10": F.col("q90") >= F.col("q10"), "p90_p50": F.col("q90") >= F.col("q50")}


def battery_rules() -> dict[str, Column]:
    return {
        "soc_order": F.col("max_soc") > F.col("min_soc"),
        "efficiency": (F.col("efficiency") > 0) & (F.col("efficiency") <= 1),
        "capacity": F.col("capacity_mwh") > 0,
    }


def site_rules(size: Column, channels: Column, expected: list[str]) -> dict[str, Column]:
    return {
        "even_size": (size > 0) & (size % 2 == 0),
        "latitude": between("lat", -90, 90),
        "longitude": between("lon", -180, 180),
        "channels": channels == F.array(*[F.lit(c) for c in expected]),
    }


def window_rules(issue: str, target: str) -> dict[str, Column]:
    """A target comes after its issue and begins a slot."""
    t, i = F.unix_micros(target), F.unix_micros(issue)
    return {"after_issue": t > i, "lead": t - i >= 0, "on_grid": t % SLOT_MICROS == 0}


def operational_rules(issue: str, target: str, pv_issue: str, delay_hours: float = 6, cutoff_hours: float = 2) -> dict[str, Column]:
    """A run is used no sooner than it is out, and was out before the production forecast."""
    hour = 3_600_000_000
    return {
        "released": F.unix_micros(target) >= F.unix_micros(issue) + int(delay_hours * hour),
        "cutoff": F.unix_micros(issue) <= F.unix_micros(pv_issue) - int(cutoff_hours * hour),
    }


def usable_weather(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row: the mean of each availability flag and whether all are above 0."""
    means = [F.avg(f).alias(f) for f in flags]
    good = F.lit(True)
    for f in flags:
        good = good & (F.avg(f) > 0)
    return df.agg(*means, good.alias("usable"))


def manifest_problems(products: DataFrame, key: str, sensing: str) -> DataFrame:
    """(problem, value, n): product keys that repeat and sensing times that products share."""
    one = duplicates(products, [key]).select(F.lit("duplicate_id").alias("problem"), F.col(key).cast("string").alias("value"), "n")
    two = products.groupBy(sensing).agg(F.countDistinct(key).alias("n")).where("n > 1")
    return one.unionByName(two.select(F.lit("shared_time").alias("problem"), F.col(sensing).cast("string").alias("value"), "n"))


def canonical_problems(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row of counts for an input of the grid: rows, malformed times, repeated keys, and whether it is empty."""
    rows = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col(ts).isNull().cast("long")), F.lit(0)).alias("malformed"))
    repeated = duplicates(df.where(F.col(ts).isNotNull()), [key, ts]).agg(F.count("*").alias("repeated"))
    return rows.crossJoin(repeated).withColumn("empty", F.col("rows") == F.col("malformed"))


def reusable(files: DataFrame, known: DataFrame) -> DataFrame:
    """files whose recorded metadata still hold: same path, size and modification time."""
    return files.join(known, ["path", "size", "mtime"], "left_semi")
