"""Window operators over series: differences, filling, lags, intervals, blocks, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .scans import WIDTH, known_around, placed, running_greatest, running_sums

BEFORE = Window.unboundedPreceding


def over(by: list[str], order: str | list[str]):
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, str) else order))


def deaccumulated(df: DataFrame, value: str, by: list[str], order: str, name: str, width: float = WIDTH) -> DataFrame:
    """df with the steps of an accumulated series, at least 0; the first is the value itself. A
    missing value stays missing, and the step after it counts from the last one known."""
    out = known_around(df, by, order, {"__last": F.col(value)}, width=width, strict=True)
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(F.col(value) - F.coalesce("__last", F.lit(0.0)), F.lit(0.0)))).drop("__last")


def interval_means(df: DataFrame, value: str, by: list[str], order: str, per_hour: float, name: str, width: float = WIDTH) -> DataFrame:
    """df with accumulated J/m2 as the mean W/m2 since the previous row, missing or not (1 hour for the first); order counts per_hour to the hour."""
    out = known_around(df, by, order, {"__before": F.col(order)}, width=width, strict=True)
    out = deaccumulated(out, value, by, order, name, width)
    hours = (F.col(order) - F.col("__before")) / per_hour
    return out.withColumn(name, F.col(name) / (F.greatest(F.coalesce(hours, F.lit(1.0)), F.lit(1e-9)) * 3600.0)).drop("__before")


def interpolate_time(grid: DataFrame, source: DataFrame, by: list[str], ts: str, linear: list[str], filled: list[str] = (), width: float = WIDTH) -> DataFrame:
    """grid rows with source columns interpolated linearly in time, within what is known only,
    and the `filled` ones carried forward. Of source rows at one time the first counts
    (the smallest by their columns). All columns share one sort; a series is cut in stretches of
    `width`, across whose borders known values are carried."""
    s = source.select(*by, ts, *linear, *filled, F.lit(0).alias("__grid"))
    s = s.withColumn("__n", F.row_number().over(Window.partitionBy(*by, ts).orderBy(*linear, *filled))).where("__n = 1").drop("__n")
    both = s.unionByName(grid.select(*by, ts, F.lit(1).alias("__grid")), allowMissingColumns=True)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v"))) for c in linear}
    both = known_around(both, by, ts, {f"__a_{c}": k for c, k in known.items()} | {f"__f_{c}": F.col(c) for c in filled}, {f"__b_{c}": k for c, k in known.items()}, width)

    def value(c):
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        share = (F.col(ts) - a["t"]) / (b["t"] - a["t"])
        return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a["t"] == b["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * share).alias(c)

    return both.where("__grid = 1").select(*by, ts, *[value(c) for c in linear], *[F.col(f"__f_{c}").alias(c) for c in filled])


def stretches(df: DataFrame, order: str, length: int, before: int = 0, after: int = 0) -> DataFrame:
    """df with __stretch, the number of a piece of `length` of order, and __own; rows that a piece needs of
    the others, those up to `before` past its end or `after` ahead of its begin, are repeated there with __own
    false. Windows by (series, __stretch) then see what windows by series would, if they reach no farther."""
    piece = lambda k: F.floor((F.col(order) + k) / length).cast("long")
    return df.withColumn("__stretch", F.explode(F.sequence(piece(-before), piece(after)))).withColumn("__own", F.col("__stretch") == piece(0))


def by_places(df: DataFrame, by: list[str], order: str, columns, back: int = 0, ahead: int = 0, length: int = 0, width: float = WIDTH) -> DataFrame:
    """df with columns(w), a dict of window expressions that reach `back` rows before and `ahead` rows after a row
    of its series, w being a window by order. Rows are numbered along their series first; stretches of that number,
    with the rows that they need of their neighbours, are the windows, so a long or sparse series is many groups."""
    s = stretches(placed(df, by, order, "__place", width), "__place", length or 16 * max(back + ahead, 256), before=ahead, after=back)
    return s.withColumns(columns(over([*by, "__stretch"], order))).where("__own").drop("__stretch", "__own", "__place")


def lagged(df: DataFrame, columns: list[str], steps: int, by: list[str], order: str) -> DataFrame:
    """df with column_lag_1 .. column_lag_steps."""
    return by_places(df, by, order, lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in range(1, steps + 1)}, back=steps)


def rolling_means(df: DataFrame, columns: dict[str, str], rows: int, by: list[str], order: str) -> DataFrame:
    """df with the mean of each column (name: column) over a row and the rows - 1 before it."""
    return by_places(df, by, order, lambda w: {n: F.avg(c).over(w.rowsBetween(-(rows - 1), 0)) for n, c in columns.items()}, back=rows - 1)


def clear_sky_persistence(value: str, sky: str, lag: int, by: list[str], order: str, ahead: int = 0, floor: bool = True, w=None) -> Column:
    """The clear-sky index `lag` rows back times the clear sky `ahead` rows on; NULL where the index divides by 0. w: a window
    of by_places, else one over the whole series."""
    w = w or over(by, order)
    now = F.lead(sky, ahead).over(w) if ahead else F.col(sky)
    out = F.try_divide(F.lag(value, lag).over(w), F.lag(sky, lag).over(w)) * now
    return F.when(out.isNotNull(), F.greatest(out, F.lit(0.0))) if floor else out


def split_by_rank(by: list[str], order: str, train: float, validation: float) -> Column:
    """train, validation or test by a row's place in its series; shares are of the count, cut down to whole rows."""
    n = F.count("*").over(Window.partitionBy(*by))
    k = F.row_number().over(over(by, order))
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train)) + F.floor(n * F.lit(validation))
    return F.when(k <= a, "train").when(k <= b, "validation").otherwise("test")


def chronological_split(df: DataFrame, by: list[str], order: str, train: float, validation: float, name: str = "split", width: float = WIDTH) -> DataFrame:
    """df with split_by_rank as a column, rows numbered in stretches of their series, so that no task orders a whole one."""
    out = placed(df, by, order, "__place", width, "__rows")
    a, b = F.floor(F.col("__rows") * F.lit(train)), F.floor(F.col("__rows") * F.lit(validation))
    split = F.when(F.col("__place") < a, "train").when(F.col("__place") < a + b, "validation").otherwise("test")
    return out.withColumn(name, split).drop("__place", "__rows")


def merge_intervals(intervals: DataFrame, by: list[str], width: float = WIDTH) -> DataFrame:
    """(by, lo, hi): half-open intervals joined where they overlap or touch; empty ones are dropped, and those with a NULL bound.

    Intervals of one begin become one first. How far those before reach, and which begin an interval
    belongs to, is carried over stretches of `width` of lo; no task orders a whole group. lo and hi are numbers.
    """
    i = intervals.where("lo < hi").groupBy(*by, "lo").agg(F.max("hi").alias("hi"))
    i = running_greatest(i, by, "lo", {"__reach": F.col("hi")}, width)
    begins = F.when(F.col("lo") <= F.col("__reach"), F.lit(None)).otherwise(F.col("lo"))
    i = known_around(i, by, "lo", {"__begin": begins}, width=width)
    return i.groupBy(*by, "__begin").agg(F.max("hi").alias("hi")).select(*by, F.col("__begin").alias("lo"), "hi")


def coverage_end(intervals: DataFrame, by: list[str], start: int) -> DataFrame:
    """(by, end): how far coverage goes on without a gap from start; start itself where it isn't covered."""
    inside = F.when((F.col("lo") <= start) & (F.col("hi") > start), F.col("hi"))
    return merge_intervals(intervals, by).groupBy(*by).agg(F.coalesce(F.max(inside), F.lit(start)).cast("long").alias("end"))


def max_concurrency(intervals: DataFrame, by: list[str], width: float = WIDTH) -> DataFrame:
    """(by, most): the most intervals open at once; one that ends where another begins doesn't overlap it.
    Changes are summed for each time first, and times are run through in stretches of `width`."""
    i = intervals.where("lo < hi")
    steps = i.select(*by, F.col("lo").alias("t"), F.lit(1).alias("d")).unionByName(i.select(*by, F.col("hi").alias("t"), F.lit(-1).alias("d")))
    steps = steps.groupBy(*by, "t").agg(F.sum("d").alias("d"))
    return running_sums(steps, by, "t", {"open": F.col("d")}, width).groupBy(*by).agg(F.max("open").alias("most"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place in order, from 0, without a window over all of them: ranges of rows are
    numbered each on their own and shifted by the sizes of those before. The order has to be unique."""
    dealt = settled(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, shifts = 0, [(-1, 0)]
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
        shifts.append((r["__part"], before))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(shifts, "__part int, __shift long")
    own = F.row_number().over(over(["__part"], order)) - 1
    return dealt.withColumn(name, own).join(F.broadcast(shift), "__part").withColumn(name, F.col(name) + F.col("__shift")).drop("__part", "__shift")


def issue_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """(by, order, pos, n, sums): rows reduced to sums for each issue, which are numbered from 0."""
    each = rows.groupBy(*by, *order).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    if not by:
        return numbered(each, order, "pos")
    return each.withColumn("pos", (F.row_number().over(over(by, order)) - 1).cast("long"))


def issue_blocks(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], length: int) -> DataFrame:
    """(by, block, n, sums): moving blocks of `length` consecutive issues, or of all where there are fewer.

    An issue is the rows that are equal in order, as (fold, issue); plain rows are
    issues of their own, if order names them one by one. Rows are reduced to sums
    for each issue before anything else; each issue is then added to the up to
    `length` blocks that it is in, so no task gets all issues.
    """
    each = issue_sums(rows, by, order, sums)
    return _blocks(each, by, list(sums), length)


def _blocks(each: DataFrame, by: list[str], names: list[str], length: int) -> DataFrame:
    number = each.groupBy(*by).agg(F.count("*").alias("__k"))
    each = each.join(number, by) if by else each.crossJoin(F.broadcast(number))
    size = F.least(F.lit(length), F.col("__k"))
    first, last = F.greatest(F.col("pos") - size + 1, F.lit(0)), F.least(F.col("pos"), F.col("__k") - size)
    inside = each.withColumn("block", F.explode(F.sequence(first, last)))
    return inside.groupBy(*by, "block").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def draws(blocks: DataFrame, total: int, replicates: int, choose: Column) -> DataFrame:
    """(replicate, place, block, n, ...): of blocks (block, n, ...), as many draws for each replicate as give `total`
    rows, and few more. choose is the block as a function of replicate, place and k, the number of blocks.

    As many blocks are drawn as their mean size asks for, and those replicates that still lack rows draw again for
    what they lack, until all have enough. A block far smaller than the others costs nothing.
    """
    spark = blocks.sparkSession
    k, mean = blocks.agg(F.count("*"), F.avg("n")).first()
    left = spark.range(replicates if k else 0).select(F.col("id").alias("replicate"), F.lit(0).cast("long").alias("next"), F.lit(total).cast("long").alias("need"))
    out = None
    while True:
        more = F.ceil(F.col("need") / F.lit(float(mean or 1)))
        more = (more + F.floor(F.sqrt(more) / 2) + 1).cast("long")  # a little more, as sizes vary
        table = left.withColumn("place", F.explode(F.sequence("next", F.col("next") + more - 1))).withColumn("k", F.lit(k))
        drawn = settled(table.select("replicate", "place", choose.cast("long").alias("block")).join(blocks, "block"))
        out = drawn if out is None else out.unionByName(drawn)
        got = drawn.groupBy("replicate").agg(F.sum("n").alias("__n"), F.count("*").alias("__k"))
        left = settled(left.join(got, "replicate").select("replicate", (F.col("next") + F.col("__k")).alias("next"), (F.col("need") - F.col("__n")).alias("need")).where("need > 0"))
        if left.isEmpty():
            return out


def moving_block_bootstrap(rows: DataFrame, order: list[str], within: list[str], sums: dict[str, Column], length: int, replicates: int, seed: int = 42, choose: Column | None = None) -> DataFrame:
    """(replicate, n, sums): sums over blocks of issues drawn with replacement until they have at least
    as many rows as there are, cut to that number.

    Rows become one row for each issue, blocks are their sums; draws are made in
    tasks, by a hash of seed, replicate and place unless choose says otherwise. Only
    the last block of a replicate is opened: whole issues of it are added, and of
    the issue in which the cut falls the first rows by `within`, which has to be
    unique in an issue. Without rows there are no replicates.
    """
    names = ["n", *sums]
    each = settled(issue_sums(rows, [], order, sums))
    blocks = settled(_blocks(each, [], list(sums), length))
    total, k = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    size = min(length, k)
    pick = choose if choose is not None else F.pmod(F.xxhash64(F.lit(seed), "replicate", "place"), F.col("k"))
    drawn = running_sums(draws(blocks, total, replicates, pick), ["replicate"], "place", {"__upto": F.col("n")})
    drawn = settled(drawn.withColumn("need", F.lit(total) - F.col("__upto") + F.col("n")).where("need > 0").drop("__upto"))
    whole = drawn.where("n <= need").select("replicate", *names)

    cut = drawn.where("n > need").select("replicate", "block", "need")  # at most one a replicate
    opened = cut.withColumn("pos", F.explode(F.sequence(F.col("block"), F.col("block") + size - 1))).join(each, "pos")
    before = F.coalesce(F.sum("n").over(over(["replicate"], "pos").rowsBetween(BEFORE, -1)), F.lit(0))
    opened = opened.withColumn("rest", F.col("need") - before).where("rest > 0")
    issues = opened.where("n <= rest").select("replicate", *names)
    last = opened.where("n > rest").select("replicate", "rest", *order)
    each_row = rows.select(*order, *within, F.lit(1).alias("n"), *[c.alias(n) for n, c in sums.items()])
    some = last.join(each_row, order).withColumn("__place", F.row_number().over(over(["replicate"], within))).where(F.col("__place") <= F.col("rest"))
    parts = whole.unionByName(issues).unionByName(some.select("replicate", *names))
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])


def sample_with_replacement(rows: DataFrame, order: list[str], n: int, seed: int = 42, choose: Column | None = None) -> DataFrame:
    """n rows drawn with replacement, each row as likely in every draw, with `draw` from 0 to n - 1.

    Rows are numbered in order (unique) and met by the draws' numbers; choose is the
    number as a function of draw and k, the number of rows, by default a hash.
    """
    places = settled(numbered(rows, order, "__place"))
    k = places.count()
    if not k:
        return places.drop("__place").withColumn("draw", F.lit(0).cast("long"))
    pick = choose if choose is not None else F.pmod(F.xxhash64(F.lit(seed), "draw"), F.col("k"))
    drawn = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.lit(k).alias("k")).select("draw", pick.cast("long").alias("__place"))
    return places.join(drawn, "__place").drop("__place")


def sequences(dense: DataFrame, by: list[str], order: str, columns: list[str], back: int, ahead: int) -> DataFrame:
    """Rows of a dense grid with a full encoder (the `back` rows up to this one) and decoder (the `ahead` rows after it), as arrays of structs.
    A long series is cut in stretches, so that it is many groups."""
    s = stretches(dense, order, 16 * (back + ahead), before=ahead, after=back - 1)
    w = over([*by, "__stretch"], order)
    row = F.struct(order, *columns)
    out = s.select(*by, order, "__own", F.collect_list(row).over(w.rowsBetween(-(back - 1), 0)).alias("encoder"), F.collect_list(row).over(w.rowsBetween(1, ahead)).alias("decoder"))
    return out.where(F.col("__own") & (F.size("encoder") == back) & (F.size("decoder") == ahead)).drop("__own")


def latest(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The row of each key with the greatest order."""
    names = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")


def even_sample(df: DataFrame, by: list[str], order: str, count: int, width: float = WIDTH) -> DataFrame:
    """Up to count rows of each group at even steps of its order, the first and last included. Rows are
    numbered in stretches of `width` of the order, a number that is unique in a group."""
    k, n = F.col("__place"), F.col("__rows")
    take = F.least(n, F.lit(count))
    # row k is taken if some i has floor(i * (n - 1) / (take - 1)) = k
    i = F.ceil(k * (take - 1) / F.greatest(n - 1, F.lit(1)))
    hit = F.floor(i * (n - 1) / F.greatest(take - 1, F.lit(1))) == k
    return placed(df, by, order, "__place", width, "__rows").where((hit & (i < take)) | (n == 1)).drop("__place", "__rows")
