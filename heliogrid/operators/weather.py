"""Weather: payloads, forecast runs, and their alignment with production without leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx

HOURLY = ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_direction_10m", "shortwave_radiation", "cloud_cover_low", "cloud_cover")
PRESETS = {
    "none": (),
    "radiation": ("shortwave_radiation",),
    "radiation_low_cloud": ("shortwave_radiation", "cloud_cover_low"),
    "full": HOURLY[:7],
}


def parse_payload(payloads: DataFrame, json_col: str, variables: list[str] = HOURLY, masked: str = "cloud_cover") -> DataFrame:
    """Hourly rows of JSON payloads: hourly.time[] beside an array for each variable.

    Absent variables, short arrays and values that aren't numbers give NULL. The
    issue is the argument column issue_micros if there is one, else the payload's
    forecast_reference_utc or issue_timestamp_utc. Each variable has a mask of 0
    or 1; the masked variable (total cloud) is NULL throughout.
    """
    fields = ", ".join(f"{v}: array<string>" for v in variables)
    parsed = F.from_json(json_col, f"hourly struct<time: array<string>, {fields}>, forecast_reference_utc string, issue_timestamp_utc string")
    keep = [c for c in payloads.columns if c not in (json_col, "issue_micros")]
    given = F.col("issue_micros") if "issue_micros" in payloads.columns else F.lit(None).cast("long")
    p = payloads.select(*keep, given.alias("__given"), parsed.alias("p"))
    p = p.select(*keep, "__given", "p", F.posexplode("p.hourly.time").alias("k", "time"))
    at = lambda c: F.expr(f"unix_micros(try_cast({c} AS timestamp))")
    value = {v: F.lit(None).cast("double") if v == masked else F.expr(f"try_cast(get(p.hourly.{v}, k) AS double)") for v in variables}
    out = p.select(*keep, at("time").alias("valid_micros"), F.coalesce("__given", at("p.forecast_reference_utc"), at("p.issue_timestamp_utc")).alias("issue_micros"), *[e.alias(v) for v, e in value.items()])
    masks = {f"{v}_available": F.col(v).isNotNull().cast("double") for v in variables}
    return out.withColumns(masks | {"lead_hours": (F.col("valid_micros") - F.col("issue_micros")) / 3.6e9})


def normalise_records(records: DataFrame) -> DataFrame:
    """Long records (issue_attr, time, step_hours, valid, value as text) with issue, valid (micros) and a number."""
    issue = F.coalesce("issue_attr", "time")
    valid = F.coalesce(F.col("valid"), issue + (F.col("step_hours") * 3.6e9).cast("long"))
    return records.select("variable", issue.alias("issue"), "step_hours", valid.alias("valid"), F.expr("try_cast(value AS double)").alias("value"))


def inventory(paths: DataFrame, first: str, last: str) -> DataFrame:
    """(path, month, stream) of archive paths whose month lies within [first, last]; months sort as text."""
    p = paths.select("path", F.regexp_extract("path", r"(\d{4}-\d{2})", 1).alias("month"), F.regexp_extract("path", r"(scda|oper)", 1).alias("stream"))
    return p.where((F.col("month") != "") & (F.col("stream") != "") & F.col("month").between(first, last))


def pivot_variables(long: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One column for each of the listed variables; the list is fixed, so no job finds it."""
    return long.groupBy(*keys).pivot("variable", list(variables)).agg(F.first("value"))


def canonical_nwp(wide: DataFrame) -> DataFrame:
    """wide (t2m, d2m, u10, v10 in K and m/s, tp in m, lcc as a share, issue, valid) in canonical units with masks."""
    t, d = fx.kelvin_to_celsius("t2m"), fx.kelvin_to_celsius("d2m")
    values = {
        "temperature": t,
        "dewpoint": d,
        "humidity": fx.relative_humidity(t, d),
        "wind_speed": fx.wind_speed("u10", "v10"),
        "wind_direction": fx.wind_direction("u10", "v10"),
        "precipitation": fx.metres_to_mm("tp"),
        "low_cloud": fx.fraction_to_percent("lcc"),
        "total_cloud": F.lit(None).cast("double"),
    }
    out = wide.withColumns(values).withColumns({f"{v}_available": F.col(v).isNotNull().cast("double") for v in values})
    return out.withColumn("available", F.greatest(*[F.col(f"{v}_available") for v in values]))


def attach(frame: DataFrame, weather: DataFrame, keys: list[str]) -> DataFrame:
    """frame with the weather of the same keys, which must be unique in weather."""
    return frame.join(weather, keys, "left")


def materialise(frame: DataFrame, runs: list[DataFrame], keys: list[str], variables: list[str]) -> DataFrame:
    """frame with the weather of the runs, each of its own sites: issue, the variables and a mask for each.
    What no run serves has zeros, masks 0 and no issue."""
    served = reduce(DataFrame.unionByName, runs)
    out = attach(frame, served.select(*keys, "issue", *variables), keys)
    masks = {f"{v}_available": F.col(v).isNotNull().cast("double") for v in variables}
    return out.withColumns(masks).withColumns({v: F.coalesce(F.col(v), F.lit(0.0)) for v in variables})


def masked_rows(targets: DataFrame, variables: list[str]) -> DataFrame:
    """Placeholder weather for sites without runs: zeros, masks 0, no issue."""
    zero = F.lit(0.0)
    return targets.select("*", *[zero.alias(v) for v in variables], *[zero.alias(f"{v}_available") for v in variables], F.lit(None).cast("long").alias("issue"))


def coverage(rows: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """Rows, rows with any weather, their share, and the missing values of each variable; by group and overall."""
    some = any_available(variables).cast("long")
    return rows.rollup(*by).agg(F.count("*").alias("rows"), F.sum(some).alias("available"), F.avg(some.cast("double")).alias("share"), *[F.sum(F.col(v).isNull().cast("long")).alias(f"{v}_missing") for v in variables])


def plan_requests(targets: DataFrame, by: list[str], ts: str, days: int, cycles: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """(by, run_hour, start_day, end_day): runs that can serve the targets, ts in hours; a run at r serves hours r to r + 24 * days."""
    ends = targets.groupBy(*by).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    day = F.explode(F.sequence(F.floor(F.col("lo") / 24) - days, F.floor(F.col("hi") / 24)))
    runs = ends.select(*by, "lo", "hi", day.alias("day")).withColumn("run_hour", F.explode(F.array(*[F.col("day") * 24 + c for c in cycles])))
    runs = runs.where((F.col("run_hour") < F.col("hi")) & (F.col("run_hour") + 24 * days > F.col("lo")))
    start = F.greatest(F.floor(F.col("run_hour") / 24), F.floor(F.col("lo") / 24))
    end = F.least(F.floor((F.col("run_hour") + 24 * days) / 24), F.floor(F.col("hi") / 24))
    return runs.select(*by, F.col("run_hour").cast("long").alias("run_hour"), start.cast("long").alias("start_day"), end.cast("long").alias("end_day"))


def group_requests(requests: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One request for all that share keys, with the sorted list of items."""
    return requests.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))


def guard(frame: DataFrame, columns: list[str], issue: str, flag: str, target: str) -> DataFrame:
    """frame with weather columns 0 where the issue is unknown or not before the target, or the flag is 0 or less."""
    bad = F.col(issue).isNull() | (F.coalesce(F.col(flag), F.lit(0.0)) <= 0) | (F.col(target) <= F.col(issue))
    return frame.withColumns({c: F.when(bad, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.lit(0.0))) for c in columns})


def select_preset(frame: DataFrame, preset: str, keys: list[str]) -> DataFrame:
    """The keys and the preset's variables with their masks."""
    names = PRESETS[preset]
    return frame.select(*keys, *names, *[f"{n}_available" for n in names])


def any_available(variables: list[str]):
    return reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in variables])
