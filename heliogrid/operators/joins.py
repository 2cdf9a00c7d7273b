"""Joins in time and space without all-pairs plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import few, settled
from .scans import WIDTH, known_around


def asof_backward(left: DataFrame, right: DataFrame, by: str, ts: str, columns: list[str], tolerance: int, cutoff: str | None = None) -> DataFrame:
    """left with, of each `by`, the columns of the latest right row at or before ts.

    ts is a number on both sides. A right row farther back than tolerance doesn't
    count: the columns, and matched_ts, are then NULL and `missing` is 1. With
    cutoff, a column of left, right rows after it don't count either. Of right
    rows at one time the last by their columns wins. Both sides go through one
    shuffle as a union; a window carries the latest right row along, so the work
    grows with the rows and not with pairs of them. Time is cut in stretches of 16
    tolerances and right rows are repeated in the next one that they reach, so that
    one long series is many groups.
    """
    length = max(16 * tolerance, 1)
    piece = lambda c: F.floor(c / length).cast("long")
    at = F.least(F.col(ts), F.col(cutoff)) if cutoff else F.col(ts)
    l = left.select(F.col(by).alias("__by"), piece(at).alias("__piece"), at.alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    payload = F.struct(F.col(ts).alias("matched_ts"), *columns)
    reach = F.explode(F.sequence(piece(F.col(ts)), piece(F.col(ts) + tolerance)))
    r = right.select(F.col(by).alias("__by"), reach.alias("__piece"), F.col(ts).alias("__at"), F.lit(0).alias("__side"), payload.alias("__right"))
    w = Window.partitionBy("__by", "__piece").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__hit", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    near = F.when(F.col(f"__left.{ts}") - F.col("__hit.matched_ts") <= tolerance, F.col("__hit"))
    out = both.select("__left.*", near.alias("__hit"))
    return out.select(*left.columns, *[F.col(f"__hit.{c}").alias(c) for c in ("matched_ts", *columns)], F.col("__hit").isNull().cast("long").alias("missing"))


def latest_in_range(candidates: DataFrame, targets: DataFrame, horizon: int, columns: list[str], bucket: int | None = None, delay: int = 0, strict: bool = True) -> DataFrame:
    """(target, issue, columns): for each target the latest issue with
    issue + delay < target <= issue + horizon; `strict=False` lets the first be <=.

    A newer issue wins even if its columns are NULL; targets without one are left
    out. Targets and issues meet on buckets of time: an issue is in each bucket
    that its range touches, so the join is by equality and its fan-out bounded.
    """
    size = bucket or max(1, horizon)
    first = F.floor((F.col("issue") + delay) / size).cast("long")
    c = candidates.withColumn("__bucket", F.explode(F.sequence(first, F.floor((F.col("issue") + horizon) / size).cast("long"))))
    t = targets.select("target").distinct().withColumn("__bucket", F.floor(F.col("target") / size).cast("long"))
    low = F.col("target") > F.col("issue") + delay if strict else F.col("target") >= F.col("issue") + delay
    pairs = c.join(t, "__bucket").where(low & (F.col("target") <= F.col("issue") + horizon))
    return pairs.groupBy("target").agg(F.max_by(F.struct("issue", *columns), "issue").alias("r")).select("target", "r.*")


def newest_run(values: DataFrame, keys: list[str], delay: int, horizon: int, every: int = 1) -> DataFrame:
    """(keys, target, issue, value): values (keys, issue, target, value) that are out, issue + delay <= target
    <= issue + horizon, of the newest issue. Partial maxima go through the shuffle, not rows."""
    usable = values.where((F.col("target") >= F.col("issue") + delay) & (F.col("target") <= F.col("issue") + horizon) & (F.col("target") % every == 0))
    best = usable.groupBy(*keys, "target").agg(F.max_by(F.struct("issue", "value"), "issue").alias("r"))
    return best.select(*keys, "target", "r.issue", "r.value")


def exact_run(values: DataFrame, keys: list[str], every: int) -> DataFrame:
    """(keys, target, issue, value): values of the runs at multiples of `every`, each serving the targets up to the next run."""
    serves = (F.col("issue") % every == 0) & (F.col("target") > F.col("issue")) & (F.col("target") <= F.col("issue") + every)
    return values.where(serves).select(*keys, "target", "issue", "value")


def nearest_point(sites: DataFrame, points: DataFrame, most: int = 256) -> DataFrame:
    """(site_id, point_id, d2): the nearest grid point by squared degrees; of equals the smallest point_id.

    Places count once, however many sites or points are there; a NULL or not finite one is none.
    The points' extent is cut in 4 x 4 cells, these again, until none has more than `most` places. A site
    goes down from cell to cell, level by level, with the bounds of the points in them: cells that begin
    farther off than another one ends are left out. So the work grows with sites times levels, not with
    pairs, wherever points are dense.
    """
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < F.lit(float("inf")))
    places = settled(points.where(finite("lat") & finite("lon")).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("point_id").alias("point_id")))
    low_y, low_x, high_y, high_x = places.agg(F.min("plat"), F.min("plon"), F.max("plat"), F.max("plon")).first()
    size = 1.0 if low_y is None else float(max(high_y - low_y, high_x - low_x)) or 1.0

    def in_cells(level: int) -> DataFrame:
        n = 4**level
        cell = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / size * n).cast("long"), F.lit(n - 1))
        return places.withColumns({"y": cell("plat", low_y), "x": cell("plon", low_x)})

    levels = 0
    while levels < 16 and not in_cells(levels).groupBy("y", "x").count().where(F.col("count") > most).isEmpty():
        levels += 1
    leaves = in_cells(levels)
    square = lambda c: c * c
    near = sites.where(finite("lat") & finite("lon")).select("lat", "lon").distinct().withColumns({"y": F.lit(0).cast("long"), "x": F.lit(0).cast("long")})
    for level in range(1, levels + 1):
        up = lambda c, by: F.shiftright(c, 2 * by)
        at = [up("y", levels - level).alias("cy"), up("x", levels - level).alias("cx")]
        ends = [f("p" + c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))]
        cells = settled(leaves.groupBy(*at).agg(*ends)).withColumns({"y": up("cy", 1), "x": up("cx", 1)})
        below, above = ({c: F.col(f"lo_{c}") - F.col(c) for c in ("lat", "lon")}, {c: F.col(c) - F.col(f"hi_{c}") for c in ("lat", "lon")})
        begins = sum(square(F.greatest(below[c], above[c], F.lit(0))) for c in ("lat", "lon"))
        ends_at = sum(square(F.greatest(F.abs(below[c]), F.abs(above[c]))) for c in ("lat", "lon"))
        near = near.join(few(cells), ["y", "x"]).select("lat", "lon", F.col("cy").alias("y"), F.col("cx").alias("x"), begins.alias("begins"), ends_at.alias("ends"))
        near = near.withColumn("least", F.min("ends").over(Window.partitionBy("lat", "lon"))).where("begins <= least").select("lat", "lon", "y", "x")
    d2 = (F.col("lat") - F.col("plat")) * (F.col("lat") - F.col("plat")) + (F.col("lon") - F.col("plon")) * (F.col("lon") - F.col("plon"))
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("d2", "point_id")).alias("r")).select(*by, "r.point_id", "r.d2")
    best = first(near.join(few(leaves), ["y", "x"]).withColumn("d2", d2), "lat", "lon")
    return first(sites.select("site_id", "lat", "lon").join(best, ["lat", "lon"]), "site_id")


def assign_folds(rows: DataFrame, folds: DataFrame, ts: str, most: int = 1000) -> DataFrame:
    """rows in each fold's part whose half-open window [start, end) holds ts; folds are (fold, part, start, end).

    Up to `most` windows are broadcast and tried row by row. More meet the rows on buckets of time as long as a
    window is on average: a window is in each bucket that it touches, so the join is by equality.
    """
    inside = (F.col(ts) >= F.col("start")) & (F.col(ts) < F.col("end"))
    if folds.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(folds), inside).drop("start", "end")
    kinds = dict(folds.dtypes) | {ts: dict(rows.dtypes)[ts]}
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c].startswith(("timestamp", "date")) else F.col(c)
    width = float(folds.agg(F.avg(number("end") - number("start"))).first()[0] or 1.0)
    bucket = lambda c: F.floor(number(c) / width).cast("long")
    spread = folds.where(number("start") < number("end")).withColumn("__bucket", F.explode(F.sequence(bucket("start"), bucket("end"))))
    return rows.withColumn("__bucket", bucket(ts)).join(spread, "__bucket").where(inside).drop("start", "end", "__bucket")


def covered(chunks: DataFrame, merged: DataFrame, by: str, kind: str = "left_semi", width: float = WIDTH) -> DataFrame:
    """chunks [lo, hi) that lie within one merged interval of their group; with left_anti, those that don't.

    merged intervals of a group don't overlap, so only the last one that begins at or before a chunk
    can hold it: one sorted scan over chunks and intervals together, cut in stretches of `width` of lo, finds
    it. The work grows with the rows of a group, not with pairs of them. A NULL group or bound is in none.
    """
    c = chunks.select(F.col(by).alias("__by"), F.col("lo").alias("__at"), F.lit(1).alias("__side"), F.struct(*chunks.columns).alias("__chunk"))
    m = merged.select(F.col(by).alias("__by"), F.col("lo").alias("__at"), F.lit(0).alias("__side"), F.col("hi").alias("__hi")).where("__by is not null and __at is not null and __hi is not null")
    both = known_around(c.unionByName(m, allowMissingColumns=True), ["__by"], "__at", {"__end": F.col("__hi")}, width=width, ties=["__side"])
    inside = F.coalesce(F.col("__end") >= F.col("__chunk.hi"), F.lit(False)) & F.col("__at").isNotNull()
    return both.where("__side = 1").where(inside if kind == "left_semi" else ~inside).select("__chunk.*")


def merge_records(known: DataFrame, found: DataFrame, key: str, fields: list[str], terminal: Column) -> DataFrame:
    """known records by key, overridden field by field by found ones unless known is terminal; new keys are added."""
    k, n = known.alias("k"), found.alias("n")
    keep = F.coalesce(terminal, F.lit(False))
    pick = lambda f: F.when(keep, F.col(f"k.{f}")).otherwise(F.coalesce(F.col(f"n.{f}"), F.col(f"k.{f}")))
    return k.join(n, key, "full_outer").select(key, *[pick(f).alias(f) for f in fields])
