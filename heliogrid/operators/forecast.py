"""Frames for models, the pooled linear forecaster, transfer, folds."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import QUANTILES, clip, monotone_quantiles, quantile_name
from .baselines import smart_persistence
from .heads import dot, fit_heads
from .selection import percentiles
from .windows import stretches


class Forecaster(Protocol):
    """What evaluation takes: fit on history, then predict h steps for each issue."""

    def fit(self, history: DataFrame) -> Forecaster: ...

    def predict(self, issues: DataFrame, h: int) -> DataFrame: ...


class SmartPersistence:
    """A Forecaster of (site_id, time_idx, horizon, target_idx, forecast); it keeps the history for the clear sky of targets."""

    def fit(self, history: DataFrame) -> SmartPersistence:
        self.history = history
        return self

    def predict(self, issues: DataFrame, h: int) -> DataFrame:
        return smart_persistence(self.history, h).join(issues, ["site_id", "time_idx"], "left_semi")


def model_frame(frame: DataFrame, cf: str, observed: str, sky: str, daylight: Column, fills: dict[str, float] = {}) -> DataFrame:
    """frame with target, observed_cf, csi and its flag, loss weight (1 by day, 0.1 by night, 0 unobserved); fills replace NULLs."""
    seen = F.coalesce(F.col(observed), F.lit(False))
    value = F.coalesce(F.col(cf), F.lit(0.0))
    has = seen & (F.col(sky) > 1e-6)
    return frame.withColumns(
        {
            "target": clip(value, 0, 1),
            "observed_cf": F.when(seen, value).otherwise(0.0),
            "csi": F.when(has, clip(F.try_divide(value, F.col(sky)), 0, 1)).otherwise(0.0),
            "csi_flag": has.cast("double"),
            "loss_weight": F.when(~seen, 0.0).when(daylight, 1.0).otherwise(0.1),
        }
        | {c: F.coalesce(F.col(c), F.lit(float(v))) for c, v in fills.items()}
    )


def mask_future(frame: DataFrame, ts: str, issue: str, columns: list[str], missing: str) -> DataFrame:
    """frame with what lies after the issue hidden: columns 0, missing 1."""
    future = F.col(ts) > F.col(issue)
    return frame.withColumns({c: F.when(future, F.lit(0.0)).otherwise(F.col(c)) for c in columns} | {missing: F.when(future, F.lit(1.0)).otherwise(F.col(missing))})


def horizon_rows(dense: DataFrame, by: str, order: str, x: str, known: list[str], static: list[str], weight: str, back: int = 8, ahead: int = 8) -> tuple[DataFrame, list[str]]:
    """Rows (by, issue_idx, horizon, target_idx, features, target, weight) of a dense grid, and the features' names.

    Features are the `back` values of x up to the issue, the static columns, and the known ones at the
    target; x is never read past the issue but as the target. Issues without a full encoder are left
    out. Series are cut in stretches with what they need of their neighbours, so a long one is many groups.
    """
    s = stretches(dense, order, 16 * (back + ahead), before=ahead, after=back - 1)
    w = Window.partitionBy(by, "__stretch").orderBy(order)
    lags = {f"{x}_lag_{k}": F.lag(x, k).over(w) for k in range(1, back)}
    later = F.struct(F.col(order).alias("target_idx"), F.col(x).alias("target"), F.col(weight).alias("weight"), *known)
    out = s.withColumns(lags | {"__later": F.array(*[F.lead(later, h).over(w) for h in range(1, ahead + 1)])}).where("__own")
    out = out.where(F.col(f"{x}_lag_{back - 1}").isNotNull() if back > 1 else F.lit(True))
    flat = out.select(by, F.col(order).alias("issue_idx"), x, *lags, *static, F.posexplode("__later").alias("__h", "__r")).where("__r IS NOT NULL")
    return flat.select(by, "issue_idx", (F.col("__h") + 1).cast("long").alias("horizon"), x, *lags, *static, "__r.*"), [x, *lags, *static, *known]


def fit_forecaster(rows: DataFrame, by: list[str], features: list[str], target: str = "target", quantiles=QUANTILES, steps: int = 20, weight: str | None = "weight") -> dict:
    """Direct forecaster, pooled over sites: for each group of by (horizon, say) a point head and a head for each quantile."""
    return {"by": by, "features": features, "quantiles": quantiles, "heads": fit_heads(rows, by, features, target, quantiles, steps, weight)}


def predict(model: dict, rows: DataFrame, offset: Column | None = None) -> DataFrame:
    """rows with point and q02..q98 in [0, 1], the latter in order; offset is added to each head."""
    base = F.lit(0.0) if offset is None else offset
    out = rows.join(F.broadcast(model["heads"].withColumnsRenamed({"point": "__point", "heads": "__heads"})), model["by"])
    out = out.withColumn("point", clip(base + dot(F.col("__point"), model["features"]), 0, 1))
    if model["quantiles"]:
        heads = F.array(*[base + dot(F.get("__heads", i), model["features"]) for i in range(len(model["quantiles"]))])
        out = out.withColumn("__q", monotone_quantiles(heads)).withColumns({quantile_name(q): F.col("__q")[i] for i, q in enumerate(model["quantiles"])}).drop("__q")
    return out.drop("__point", "__heads")


def source_point(source: dict, rows: DataFrame) -> DataFrame:
    """rows with source_point, the source model's point before it is held in [0, 1]."""
    out = rows.join(F.broadcast(source["heads"].select(*source["by"], F.col("point").alias("__point"))), source["by"])
    return out.withColumn("source_point", dot(F.col("__point"), source["features"])).drop("__point")


def fit_transfer(source: dict, rows: DataFrame, by: list[str], features: list[str], target: str = "target", quantiles=QUANTILES, steps: int = 20, weight: str | None = "weight") -> dict:
    """A source model and heads of its residual on the target site; the site's name isn't a feature."""
    r = source_point(source, rows).withColumn("__residual", F.col(target) - F.col("source_point"))
    return {"source": source, "residual": fit_forecaster(r, by, features, "__residual", quantiles, steps, weight)}


def predict_transfer(model: dict, rows: DataFrame) -> DataFrame:
    return predict(model["residual"], source_point(model["source"], rows), F.col("source_point"))


def last_days(rows: DataFrame, order: str, days: int = 30, per_day: int = 96) -> DataFrame:
    """rows with `valid`, whether order is within so many days of the last one: the validation rows of pretraining."""
    end = rows.agg((F.max(order) - days * per_day).alias("__end"))
    return rows.crossJoin(F.broadcast(end)).withColumn("valid", F.col(order) > F.col("__end")).drop("__end")


def validation_days(rows: DataFrame, order: str, most: int = 30, share: float = 0.2, per_day: int = 96) -> int:
    """Days of validation for `last_days`: `most`, or a share of the days that rows cover where that is less."""
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    return 0 if lo is None else min(most, int((hi - lo + 1) / per_day * share))


def rolling_folds(spark: SparkSession, start: str, end: str, train: int, validation: int = 1, test: int = 1) -> DataFrame:
    """(fold, part, start, end): month windows that move on by a month while the test ends within [start, end]; ends are exclusive dates."""
    months = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}', interval 1 month)) AS m")
    at = lambda k: F.add_months("m", k)
    f = months.select((F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("fold"), "m").where(at(train + validation + test) <= F.date_add(F.lit(end).cast("date"), 1))
    parts = [("train", 0, train), ("validation", train, train + validation), ("test", train + validation, train + validation + test)]
    return f.select("fold", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), at(a).alias("start"), at(b).alias("end")) for p, a, b in parts])).alias("r")).select("fold", "r.*")


def expanding_folds(spark: SparkSession, year: int, timezone: str = "UTC") -> DataFrame:
    """(fold, part, start, end): train January to m - 1, validate on m, test on m + 1 for m from April to November; local months as UTC instants."""
    f = spark.range(4, 12).select((F.col("id") - 4).alias("fold"), F.col("id").cast("int").alias("m"))
    first = lambda m: F.to_utc_timestamp(F.add_months(F.make_date(F.lit(year), F.lit(1), F.lit(1)), m - 1).cast("timestamp"), timezone)
    one = F.lit(1)
    parts = [("train", one, F.col("m")), ("validation", F.col("m"), F.col("m") + 1), ("test", F.col("m") + 1, F.col("m") + 2)]
    return f.select("fold", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), first(a).alias("start"), first(b).alias("end")) for p, a, b in parts])).alias("r")).select("fold", "r.*")


def final_epochs(rows: DataFrame, by: list[str], epoch: str) -> DataFrame:
    """(by, epochs): max(1, floor(median + 0.5)) of the epochs of each group."""
    median = percentiles(rows, by, F.col(epoch), {"__median": 0.5})
    return median.select(*by, F.greatest(F.lit(1), F.floor(F.col("__median") + 0.5)).cast("long").alias("epochs"))


def checkpoint_fields(path: str) -> dict[str, Column]:
    """epoch and val_loss from a name like epoch=12-val_loss=0.034.ckpt; NULL where absent."""
    number = lambda name, kind: F.regexp_extract(path, rf"{name}=(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast(kind)
    return {"epoch": number("epoch", "long"), "val_loss": number("val_loss", "double")}


def battery_schedule(forecast: DataFrame, battery: DataFrame, by: str, column: str) -> DataFrame:
    """For each forecast row no charge, no discharge, and the lowest state of charge; a capacity of 0 or less is an error."""
    if column not in forecast.columns:
        raise ValueError(f"no forecast column {column}")
    good = F.when(F.col("capacity_mwh") > 0, F.col("capacity_mwh")).otherwise(F.raise_error(F.lit("capacity must be positive")).cast("double"))
    zero = F.lit(0.0)
    return forecast.join(battery, by).withColumns({"charge": zero, "discharge": zero, "soc": good * F.col("min_soc")})


def markdown(small: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(k, line): a result as lines of a Markdown table; meant for aggregated results."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    body = small.select((F.row_number().over(Window.orderBy(order)) + 1).cast("long").alias("k"), cells.alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    return small.sparkSession.createDataFrame(head, "k long, line string").unionByName(body)
