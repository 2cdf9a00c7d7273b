"""Forecast metrics as aggregates; every metric of a grouping comes from one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import QUANTILES, pinball, quantile_name
from ..session import settled
from .selection import percentiles
from .windows import by_places


def _e(actual: str, forecast: str) -> Column:
    return F.col(forecast) - F.col(actual)


def mae(actual: str, forecast: str) -> Column:
    return F.avg(F.abs(_e(actual, forecast)))


def mse(actual: str, forecast: str) -> Column:
    return F.avg(_e(actual, forecast) * _e(actual, forecast))


def rmse(actual: str, forecast: str) -> Column:
    return F.sqrt(mse(actual, forecast))


def mbe(actual: str, forecast: str) -> Column:
    """Forecast less actual."""
    return F.avg(_e(actual, forecast))


def mape(actual: str, forecast: str, eps: float = 1e-6) -> Column:
    return F.avg(F.abs(_e(actual, forecast) / F.greatest(F.abs(actual), F.lit(eps))))


def nrmse(actual: str, forecast: str, factor: float) -> Column:
    if factor == 0:
        raise ValueError("the factor must not be 0")
    return rmse(actual, forecast) / factor


def skill_score(actual: str, forecast: str, reference: str, metric=mse) -> Column:
    """1 - error / reference error; where the latter is 0, 1 for a perfect forecast, else minus infinity."""
    own, ref = metric(actual, forecast), metric(actual, reference)
    return F.when(ref != 0, F.lit(1.0) - F.try_divide(own, ref)).when(own == 0, 1.0).when(own.isNotNull(), F.lit(float("-inf")))


def skill(own: Column, ref: Column) -> Column:
    """1 - own / ref, NULL where ref is 0."""
    return F.lit(1.0) - F.try_divide(own, ref)


def summary(actual: str, forecast: str, reference: str) -> list[Column]:
    """count, mse, rmse, mae, mbe and mse skill of the rows of a group."""
    m = mse(actual, forecast)
    return [F.count("*").alias("count"), m.alias("mse"), F.sqrt(m).alias("rmse"), mae(actual, forecast).alias("mae"), mbe(actual, forecast).alias("mbe"), skill(m, mse(actual, reference)).alias("skill")]


def daylight(rows: DataFrame, elevation: str, actual: str, required: list[str], strict: bool = True) -> DataFrame:
    """Rows with the sun up and an actual. With strict, a row among them that lacks a required
    prediction is an error when it is read; else such rows are left out."""
    seen = rows.where((F.col(elevation) > 0) & F.col(actual).isNotNull())
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    if not strict:
        return seen.where(whole)
    return seen.where(F.when(whole, True).otherwise(F.raise_error(F.lit("a daylight row lacks a prediction")).cast("boolean")))


def lacking(rows: DataFrame, elevation: str, actual: str, required: list[str]) -> DataFrame:
    """Daylight rows that lack a required prediction."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return rows.where((F.col(elevation) > 0) & F.col(actual).isNotNull() & ~whole)


def report(rows: DataFrame, models: list[str], actual: str, reference: str, groups: list[str]) -> DataFrame:
    """(model, group, value, count, mse, ...): each model overall and by each of groups, from one expansion of the rows."""
    long = rows.select(actual, F.col(reference).alias("__ref"), *groups, *models).unpivot([actual, "__ref", *groups], models, "model", "forecast").where("forecast IS NOT NULL")
    sets = long.withColumns({g: F.col(g).cast("string") for g in groups}).groupingSets([[F.col("model")], *[[F.col("model"), F.col(g)] for g in groups]], "model", *groups)
    out = sets.agg(F.grouping_id().alias("__g"), *summary(actual, "forecast", "__ref"))
    every = (1 << len(groups)) - 1
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for k, g in enumerate(groups):
        mine = F.col("__g") == every - (1 << (len(groups) - 1 - k))
        name, value = F.when(mine, g).otherwise(name), F.when(mine, F.col(g)).otherwise(value)
    return out.select("model", name.alias("grouping"), value.alias("value"), "count", "mse", "rmse", "mae", "mbe", "skill")


def zero_diagnostics(rows: DataFrame, actual: str, forecast: str, fold: str) -> DataFrame:
    """How often and at what cost a forecast is 0, for each fold and (fold NULL) overall."""
    e2 = _e(actual, forecast) * _e(actual, forecast)
    zero = F.abs(F.col(forecast)) <= 1e-12
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.rollup(fold).agg(
        F.count("*").alias("count"),
        n(zero).alias("zeros"),
        n(zero & (F.col(actual) > 0.1)).alias("zeros_while_producing"),
        F.avg(F.when(zero, e2)).alias("zero_mse"),
        F.try_divide(F.coalesce(F.sum(F.when(zero, e2)), F.lit(0.0)), F.sum(e2)).alias("zero_error_share"),
    )
    out = out.withColumn("zero_rate", F.col("zeros") / F.col("count"))
    suspicious = (F.col("zero_rate") > 0.5) | (F.col("zeros_while_producing") > 0) | (F.coalesce("zero_error_share", F.lit(0.0)) > 0.5)
    return out.withColumn("suspicious", suspicious)


def acceptance(skill_col: Column, low_col: Column, threshold: float) -> tuple[Column, Column]:
    """Whether skill and its lower bound reach the threshold; what isn't finite doesn't."""
    good = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")) & (c >= threshold), F.lit(False))
    return good(skill_col), good(low_col)


def diagnostics(rows: DataFrame, by: list[str], order: str, actual: str, forecast: str, sky: str) -> DataFrame:
    """Distribution of a forecast, its bias, ramps and night values, by series (rows of which are known; the order is unique)."""
    known = rows.where(F.col(actual).isNotNull() & F.col(forecast).isNotNull())
    r = by_places(known, by, order, lambda w: {"__ramp": F.abs(F.col(forecast) - F.lag(forecast).over(w))}, back=1)
    r = settled(r.select(*dict.fromkeys([*by, actual, forecast, sky, "__ramp"])))  # read by several aggregates
    f = F.col(forecast)
    share = lambda c: F.avg(c.cast("double"))
    out = r.groupBy(*by).agg(
        F.count("*").alias("count"), F.min(f).alias("min"), F.max(f).alias("max"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"),
        F.sum(f).alias("sum"), share(F.abs(f) <= 1e-9).alias("zero_share"), mbe(actual, forecast).alias("bias_mean"), F.sum(_e(actual, forecast)).alias("bias_sum"),
        F.corr(actual, forecast).alias("corr"), F.sum((f < 0).cast("long")).alias("negatives"), F.avg("__ramp").alias("ramp_mean"),
        F.avg(F.when(F.col(sky) <= 1, (f > 1e-6).cast("double"))).alias("night_positive_share"),
    )
    own = percentiles(r, by, f, {f"p{round(q * 100):02d}": q for q in (0.01, 0.05, 0.5, 0.95, 0.99)})
    ramps = percentiles(r, by, F.col("__ramp"), {"ramp_p95": 0.95})  # a series of one row has no ramp
    return out.join(own, by).join(ramps, by, "left")


def interval_diagnostics(actual: str, low: str, high: str) -> list[Column]:
    return [F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("width")]


def mean_pinball(actual: str, quantiles=QUANTILES) -> Column:
    """Mean over the quantile columns of their mean pinball loss."""
    parts = [F.avg(pinball(q, quantile_name(q), actual)) for q in quantiles]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def point_metrics(rows: DataFrame, by: list[str], actual: str, models: list[str], reference: str) -> DataFrame:
    """(by, model, count, mse, ...) on rows where actual, forecast and reference are all known."""
    long = rows.select(*by, actual, F.col(reference).alias("__ref"), *models).unpivot([*by, actual, "__ref"], models, "model", "forecast")
    return long.where(F.col(actual).isNotNull() & F.col("forecast").isNotNull() & F.col("__ref").isNotNull()).groupBy(*by, "model").agg(*summary(actual, "forecast", "__ref"))


def compare_to(rows: DataFrame, key: str, current: str, columns: list[str]) -> DataFrame:
    """rows with each column's difference from the one row whose key is `current`; not exactly one such row is an error."""
    base = rows.where(F.col(key) == current).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__{c}") for c in columns])
    checked = F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit("one current row is needed")).cast("boolean"))
    out = rows.crossJoin(F.broadcast(base)).where(checked)
    return out.withColumns({f"{c}_delta": F.col(c) - F.col(f"__{c}") for c in columns}).drop("__n", *[f"__{c}" for c in columns])
