"""Scans along series of any length: values carried from row to row, and running sums, without a task that holds a series.

A series is cut in stretches of its order. A window goes over each stretch, an
aggregate makes one row of each, the few rows of a series' stretches are scanned,
and what they carry over a border is added to the rows behind it. What is shuffled
is the rows once, and a row for each stretch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a series' order in a stretch: about six weeks of quarter hours, eleven years of days.
WIDTH = 4096
BEFORE, AFTER = Window.unboundedPreceding, Window.unboundedFollowing


def _stretched(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn("__stretch", F.floor(F.col(order) / width).cast("long"))


def _carried(rows: DataFrame, by: list[str], order: str, partials: dict[str, Column], scans: dict[str, Column]) -> DataFrame:
    """rows with what the other stretches of their series carry: partials is an aggregate of a stretch, scans
    a window expression over a series' stretches (in columns of the partials' names)."""
    each = rows.groupBy(*by, "__stretch").agg(*[c.alias(n) for n, c in partials.items()]).select(*by, "__stretch", *[c.alias(n) for n, c in scans.items()])
    keys = [*by, "__stretch"]
    each = each.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return rows.join(each, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def known_around(df: DataFrame, by: list[str], order: str, last: dict[str, Column] = {}, following: dict[str, Column] = {}, width: float = WIDTH, ties: list[str] = (), strict: bool = False) -> DataFrame:
    """df with a column for each name: of `last`, the latest value that isn't NULL at or before a row of its
    series; of `following`, the earliest one at or after it.

    Rows at one time see each other, unless ties order them: then a row sees those up to itself, and with
    strict, those before itself only. A NULL order comes first. Columns of values must be orderable.
    """
    values = {f"__v_{n}": c for n, c in {**last, **following}.items()}
    rows = _stretched(df, order, width).withColumns(values)
    at = F.struct(order, *ties)
    by_time = Window.partitionBy(*by, "__stretch").orderBy(order, *ties)
    up, down = (by_time.rowsBetween(BEFORE, -1 if strict else 0), by_time.rowsBetween(1 if strict else 0, AFTER)) if ties or strict else (by_time.rangeBetween(BEFORE, 0), by_time.rangeBetween(0, AFTER))
    local = {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(up) for n in last} | {f"__l_{n}": F.first(f"__v_{n}", ignorenulls=True).over(down) for n in following}
    seen = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), F.struct(at.alias("at"), F.col(f"__v_{n}").alias("v")))
    partials = {f"__c_{n}": F.max(seen(n)) for n in last} | {f"__c_{n}": F.min(seen(n)) for n in following}
    series = Window.partitionBy(*by).orderBy("__stretch")
    scans = {f"__c_{n}": F.last(f"__c_{n}", ignorenulls=True).over(series.rowsBetween(BEFORE, -1)) for n in last}
    scans |= {f"__c_{n}": F.first(f"__c_{n}", ignorenulls=True).over(series.rowsBetween(1, AFTER)) for n in following}
    out = _carried(rows.withColumns(local), by, order, partials, scans)
    names = [*last, *following]
    # a known value is not NULL, so a NULL says that the stretch has none
    return out.withColumns({n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__c_{n}.v")) for n in names}).drop("__stretch", *[f"__{k}_{n}" for k in "vlc" for n in names])


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], width: float = WIDTH, ties: list[str] = ()) -> DataFrame:
    """df with a column for each name: the sum over the rows of the series up to and with this one (NULLs count as 0)."""
    rows = _stretched(df, order, width).withColumns({f"__v_{n}": c for n, c in sums.items()})
    up = Window.partitionBy(*by, "__stretch").orderBy(order, *ties).rowsBetween(BEFORE, 0)
    series = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(BEFORE, -1)
    local = {f"__l_{n}": F.sum(f"__v_{n}").over(up) for n in sums}
    out = _carried(rows.withColumns(local), by, order, {f"__c_{n}": F.sum(f"__v_{n}") for n in sums}, {f"__c_{n}": F.sum(f"__c_{n}").over(series) for n in sums})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumns({n: zero(f"__l_{n}") + zero(f"__c_{n}") for n in sums}).drop("__stretch", *[f"__{k}_{n}" for k in "vlc" for n in sums])


def running_greatest(df: DataFrame, by: list[str], order: str, values: dict[str, Column], width: float = WIDTH) -> DataFrame:
    """df with a column for each name: the greatest value of the series' rows before this one, NULL where none is known; the order
    has to be unique in a series."""
    rows = _stretched(df, order, width).withColumns({f"__v_{n}": c for n, c in values.items()})
    up = Window.partitionBy(*by, "__stretch").orderBy(order).rowsBetween(BEFORE, -1)
    series = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(BEFORE, -1)
    local = {f"__l_{n}": F.max(f"__v_{n}").over(up) for n in values}
    out = _carried(rows.withColumns(local), by, order, {f"__c_{n}": F.max(f"__v_{n}") for n in values}, {f"__c_{n}": F.max(f"__c_{n}").over(series) for n in values})
    return out.withColumns({n: F.greatest(f"__l_{n}", f"__c_{n}") for n in values}).drop("__stretch", *[f"__{k}_{n}" for k in "vlc" for n in values])


def placed(df: DataFrame, by: list[str], order: str, name: str, width: float = WIDTH, size: str | None = None) -> DataFrame:
    """df with each row's place in its series, from 0, and as `size` the rows of the series; the order has to be unique in a series."""
    series = Window.partitionBy(*by)
    number = {name: F.row_number().over(Window.partitionBy(*by, "__stretch").orderBy(order))}
    counts = {"__before": F.sum("__before").over(series.orderBy("__stretch").rowsBetween(BEFORE, -1)), "__size": F.sum("__size").over(series)}
    out = _carried(_stretched(df, order, width).withColumns(number), by, order, dict.fromkeys(counts, F.count("*")), counts)
    out = out.withColumn(name, F.col(name) - 1 + F.coalesce("__before", F.lit(0)))
    return (out.withColumn(size, F.col("__size")) if size else out).drop("__stretch", "__before", "__size")
