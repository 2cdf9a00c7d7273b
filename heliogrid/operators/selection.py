"""Exact percentiles of groups of any size: a sketch narrows the range of values, a count picks the ranks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: A sketch's ranks are off by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float], accuracy: int = ACCURACY, max_rows: int = 1_000_000) -> DataFrame:
    """(by, one column for each name of shares): the percentile of value, interpolated linearly between the two ranks
    about (n - 1) * share, as in `percentile`; NULLs don't count, and a group without values has no row.

    `percentile` holds all distinct values of a group in one buffer. Here a sketch of bounded size gives, for each
    group and share, two values between which both ranks lie; the rows below are counted; equal rows between are
    counted together and put in order. What one task orders is about 1 / (accuracy / 8) of a group's rows. Should a
    sketch miss, its range is opened to the whole group, so the result is exact in any case.
    """
    names, step = list(shares), 2.0 / accuracy
    values = rows.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    ends = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-step, step)]
    sketch = values.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.percentile_approx("__v", ends, accuracy).alias("__e"))

    def ranges(pairs: list) -> Column:
        """An entry for each share: its place, the range, and the two ranks (from 0) with the weight of the upper one."""
        out = []
        for k, (s, (lo, hi)) in enumerate(zip(shares.values(), pairs)):
            at = (F.col("__n") - 1) * F.lit(float(s))
            out.append(F.struct(F.lit(k).alias("k"), lo.alias("lo"), hi.alias("hi"), F.floor(at).alias("first"), F.ceil(at).alias("second"), (at - F.floor(at)).alias("w")))
        return F.array(*out)

    near = settled(sketch.select(*by, "__n", "__lo", "__hi", ranges([(F.get("__e", 2 * k), F.get("__e", 2 * k + 1)) for k in range(len(names))]).alias("__r")))  # a row for each group

    def met(table: DataFrame) -> DataFrame:
        few = table.count() <= max_rows
        if not by:
            return values.crossJoin(F.broadcast(table))
        return values.join(F.broadcast(table) if few else table, by)

    entry = lambda k: F.get("__r", k)
    sides = [f(F.when(c, 1)).alias(f"{n}{k}") for k in range(len(names)) for n, f, c in (("b", F.count, F.col("__v") < entry(k)["lo"]), ("u", F.count, F.col("__v") <= entry(k)["hi"]))]
    counted = met(near).groupBy(*by, "__n", "__lo", "__hi", "__r").agg(*sides)
    held = [(F.col(f"b{k}") <= entry(k)["first"]) & (F.col(f"u{k}") > entry(k)["second"]) for k in range(len(names))]
    checked = counted.select(
        *by,
        F.array(*[F.struct(F.lit(k).alias("k"), F.when(ok, entry(k)["lo"]).otherwise(F.col("__lo")).alias("lo"), F.when(ok, entry(k)["hi"]).otherwise(F.col("__hi")).alias("hi"), F.when(ok, F.col(f"b{k}")).otherwise(0).alias("below"), entry(k)["first"].alias("first"), entry(k)["second"].alias("second"), entry(k)["w"].alias("w")) for k, ok in enumerate(held)]).alias("__r"),
    )
    inside = met(settled(checked)).withColumn("__one", F.explode(F.filter("__r", lambda r: (F.col("__v") >= r["lo"]) & (F.col("__v") <= r["hi"]))))
    facts = [F.col(f"__one.{c}").alias(f"__{c}") for c in ("k", "below", "first", "second", "w")]
    equal = inside.groupBy(*by, *facts, "__v").agg(F.count("*").alias("__times"))
    upto = equal.withColumn("__upto", F.sum("__times").over(Window.partitionBy(*by, "__k").orderBy("__v")))
    last, before = F.col("__below") + F.col("__upto"), F.col("__below") + F.col("__upto") - F.col("__times")
    at = lambda rank: F.max(F.when((before <= F.col(rank)) & (F.col(rank) < last), F.col("__v")))
    ranked = upto.groupBy(*by, "__k", "__w").agg(at("__first").alias("__x"), at("__second").alias("__y"))
    ranked = ranked.withColumn("__p", F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__w"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("__k") == k, F.col("__p"))).alias(n) for k, n in enumerate(names)])
