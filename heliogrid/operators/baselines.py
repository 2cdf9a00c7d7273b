"""Persistence baselines and the harmonic clear-sky curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from .certified import fit_certified
from .checks import unique
from .heads import dot


def horizons(rows: DataFrame, h: int, issue: str = "time_idx") -> DataFrame:
    """rows, once for each horizon 1..h, with `horizon` and `target_idx`."""
    out = rows.withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))))
    return out.withColumn("target_idx", F.col(issue) + F.col("horizon"))


def clear_sky_index(actual, sky) -> Column:
    """actual / sky in [0, 2]; 1 where either is missing or the sky is dark."""
    a, s = F.col(actual), F.col(sky)
    return clip(F.when(a.isNull() | s.isNull() | (s <= 1e-4), F.lit(1.0)).otherwise(F.try_divide(a, s)), 0, 2)


def smart_persistence(history: DataFrame, h: int, by: str = "site_id", order: str = "time_idx", actual: str = "cf", sky: str = "cs", check: bool = False) -> DataFrame:
    """(by, order, horizon, target_idx, forecast): the clear-sky index at the issue, kept for h
    steps on the clear sky of each target. Targets beyond the history have no row. Only
    the actual of the issue is read. With check, repeated times are an error."""
    if check:
        unique(history, [by, order])
    issues = horizons(history.select(by, order, clear_sky_index(actual, sky).alias("csi")), h, order)
    targets = history.select(F.col(by), F.col(order).alias("target_idx"), F.col(sky).alias("target_sky"))
    return issues.join(targets, [by, "target_idx"]).select(by, order, "horizon", "target_idx", clip(F.col("csi") * F.col("target_sky"), 0, 1).alias("forecast"))


def last_value(series: DataFrame, h: int, by: str, order: str, value: str) -> DataFrame:
    """(by, horizon, forecast): each series' last known value, h times."""
    last = series.where(F.col(value).isNotNull()).groupBy(by).agg(F.max_by(value, order).alias("forecast"))
    return last.select(by, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(h).cast("long"))).alias("horizon"), "forecast")


def fit_quantile(rows: DataFrame, features: list[str], target: str, q: float, steps: int = 80, weight: str | None = None) -> list[float]:
    """Coefficients [intercept, features...] of a linear quantile regression over all rows, whose loss is the least."""
    fitted = fit_certified(rows.withColumn("__all", F.lit(0)), ["__all"], features, target, q, steps=steps, weight=weight)
    return fitted.first()["coefficients"]


def linear(coefficients: list[float], features: list[str]) -> Column:
    return sum((F.col(f) * float(b) for f, b in zip(features, coefficients[1:])), F.lit(float(coefficients[0])))


def harmonic_persistence(history: DataFrame, train: DataFrame, h: int, features: list[str], by: str = "site_id", order: str = "time_idx", actual: str = "cf", q: float = 0.99, steps: int = 80) -> DataFrame:
    """smart_persistence on a clear-sky curve fitted, on train rows only, as the q quantile of the actual by harmonics."""
    coefficients = fit_quantile(train, features, actual, q, steps)
    curve = history.withColumn("__curve", clip(linear(coefficients, features), 0, 1))
    return smart_persistence(curve, h, by, order, actual, "__curve")


def fold_baselines(predictions: DataFrame, train: DataFrame, history: DataFrame, features: list[str], version: str, by: str = "site_id", order: str = "time_idx", actual: str = "cf", sky: str = "cs", q: float = 0.99, steps: int = 80) -> DataFrame:
    """predictions (fold, by, issue_idx, target_idx, ...) with each fold's baselines.

    The harmonic curve is fitted on the fold's train rows only, all folds in one fit. Version v1 names its
    persistence smart_persistence; v2 names it legacy_harmonic_smart_persistence and has the physical one
    as smart_persistence. A pair without history on either end has NULL.
    """
    if version not in ("v1", "v2"):
        raise ValueError(f"unknown version {version}")
    curves = fit_certified(train, ["fold"], features, actual, q, steps=steps).select("fold", F.col("coefficients").alias("__curve"))
    side = lambda name: history.select(by, F.col(order).alias(f"{name}_idx"), F.struct(actual, sky, *features).alias(f"__{name}"))
    out = predictions.join(side("issue"), [by, "issue_idx"], "left").join(side("target"), [by, "target_idx"], "left").join(F.broadcast(curves), "fold", "left")
    curve = {e: clip(dot(F.col("__curve"), [f"__{e}.{f}" for f in features]), 0, 1) for e in ("issue", "target")}
    out = out.withColumns({f"__{e}_curve": c for e, c in curve.items()})
    persist = lambda at, to: F.when(F.col("__issue").isNotNull(), clip(clear_sky_index(f"__issue.{actual}", at) * F.col(to), 0, 1))
    harmonic, physical = persist("__issue_curve", "__target_curve"), persist(f"__issue.{sky}", f"__target.{sky}")
    named = {"smart_persistence": harmonic} if version == "v1" else {"legacy_harmonic_smart_persistence": harmonic, "smart_persistence": physical}
    return out.withColumns(named).drop("__issue", "__target", "__curve", "__issue_curve", "__target_curve")
