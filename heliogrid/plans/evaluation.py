"""Queries on baselines, metrics, folds, blocks and forecasting pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.columns import QUANTILES, quantile_name
from ..operators import baselines, catalog, forecast, joins, metrics, trees, windows
from ..session import few, settled, shared_folder
from ..operators.certified import fit_certified
from ..operators.heads import dot
from ..sources import io
from ..sources.runs import FoldRun
from . import adapters as A
from .production import r6, rounded
from .registry import query

E = "(f - a)"
DAY = "SELECT * FROM forecasts WHERE elev > 0 AND actual IS NOT NULL"
MODELS = ["point", "scratch", "q50", "smart"]


def _day(spark, d):
    return metrics.daylight(A.forecasts(spark, d), "elev", "actual", ["point", "scratch", "smart"])


def _summary(f: str) -> str:
    return f"count(*) AS count, round(avg(({f} - actual) * ({f} - actual)), 9) AS mse, round(sqrt(avg(({f} - actual) * ({f} - actual))), 9) AS rmse, round(avg(abs({f} - actual)), 9) AS mae, round(avg({f} - actual), 9) AS mbe, round(1e0 - avg(({f} - actual) * ({f} - actual)) / nullif(avg((smart - actual) * (smart - actual)), 0e0), 9) AS skill"


PERSIST = """
i AS (SELECT site_id, time_idx, least(greatest(CASE WHEN cf IS NULL OR cs IS NULL OR cs <= 1e-4 THEN 1e0 ELSE cf / cs END, 0e0), 2e0) AS csi FROM sky),
p AS (SELECT i.site_id, i.time_idx, h.h AS horizon, t.time_idx AS target_idx, least(greatest(csi * t.cs, 0e0), 1e0) AS forecast, t.cf AS actual, t.cs FROM i, (SELECT unnest(range(1, 9)) AS h) h, sky t WHERE t.site_id = i.site_id AND t.time_idx = i.time_idx + h.h)
"""


@query(f"WITH {PERSIST} SELECT site_id, time_idx, horizon, target_idx, round(forecast, 6) AS forecast FROM p", ("sky",))
def M01_smart_persistence(spark, d):
    return rounded(baselines.smart_persistence(A.sky(spark, d), 8))


@query(f"WITH {PERSIST} SELECT site_id, time_idx, horizon, round(forecast, 6) AS forecast FROM p WHERE time_idx % 24 = 0 AND horizon <= 4", ("sky",))
def X03_forecaster(spark, d):
    s = A.sky(spark, d)
    issues = s.where("time_idx % 24 = 0").select("site_id", "time_idx")
    return rounded(forecast.SmartPersistence().fit(s).predict(issues, 4).drop("target_idx"))


@query(f"WITH {PERSIST} SELECT horizon, count(*) AS count, round(avg((forecast - actual) * (forecast - actual)), 9) AS mse, round(avg(abs(forecast - actual)), 9) AS mae, round(avg(forecast - actual), 9) AS mbe FROM p WHERE cs > 0 AND actual IS NOT NULL GROUP BY ROLLUP (horizon)", ("sky",))
def M01_smart_persistence_metrics(spark, d):
    s = A.sky(spark, d)
    p = baselines.smart_persistence(s, 8).join(s.select("site_id", F.col("time_idx").alias("target_idx"), F.col("cf").alias("actual"), "cs"), ["site_id", "target_idx"])
    p = metrics.daylight(p, "cs", "actual", ["forecast"])
    out = p.rollup("horizon").agg(F.count("*").alias("count"), metrics.mse("actual", "forecast").alias("mse"), metrics.mae("actual", "forecast").alias("mae"), metrics.mbe("actual", "forecast").alias("mbe"))
    return rounded(out, places=9)


@query("SELECT count(*) AS n, round(avg(abs(point - actual)), 9) AS mae, round(sqrt(avg((point - actual) * (point - actual))), 9) AS rmse, round(avg(point - actual), 9) AS mbe, round(avg(abs((point - actual) / greatest(abs(actual), 1e-6))), 6) AS mape, round(avg((point - actual) * (point - actual)), 9) AS mse, round(sqrt(avg((point - actual) * (point - actual))) / 0.8e0, 9) AS nrmse, fold FROM (" + DAY + ") GROUP BY fold", ("forecasts",))
def A01_A06_point_metrics(spark, d):
    m = metrics
    out = _day(spark, d).groupBy("fold").agg(
        F.count("*").alias("n"), m.mae("actual", "point").alias("mae"), m.rmse("actual", "point").alias("rmse"), m.mbe("actual", "point").alias("mbe"),
        F.round(m.mape("actual", "point"), 6).alias("mape"), m.mse("actual", "point").alias("mse"), m.nrmse("actual", "point", 0.8).alias("nrmse"),
    )
    return rounded(out, "mape", places=9)


@query("""
SELECT site_id, horizon, round(CASE WHEN avg((smart - actual) * (smart - actual)) <> 0 THEN 1e0 - avg((point - actual) * (point - actual)) / avg((smart - actual) * (smart - actual)) END, 9) AS skill_mse, round(1e0 - avg(abs(point - actual)) / nullif(avg(abs(smart - actual)), 0), 9) AS skill_mae,
  round(1e0 - sqrt(avg((point - actual) * (point - actual))) / nullif(sqrt(avg((smart - actual) * (smart - actual))), 0), 9) AS skill_rmse FROM (""" + DAY + ") GROUP BY ALL", ("forecasts",))
def A07_skill_scores(spark, d):
    s = lambda m: metrics.skill_score("actual", "point", "smart", m)
    out = _day(spark, d).groupBy("site_id", "horizon").agg(s(metrics.mse).alias("skill_mse"), s(metrics.mae).alias("skill_mae"), s(metrics.rmse).alias("skill_rmse"))
    return rounded(out, places=9)


@query("SELECT site_id, " + _summary("point") + " FROM (" + DAY + ") GROUP BY site_id", ("forecasts",))
def A08_metric_summary(spark, d):
    return rounded(_day(spark, d).groupBy("site_id").agg(*metrics.summary("actual", "point", "smart")), places=9)


@query("WITH day AS (" + DAY + "), l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {m} AS f, actual, smart, horizon, fold, time_idx // 2880 AS month FROM day" for m in MODELS) + ") "
    + " UNION ALL ".join(f"SELECT model, '{g}' AS grouping, {v} AS value, {_summary('f')} FROM l GROUP BY ALL" for g, v in (("overall", "NULL::VARCHAR"), ("horizon", "horizon::VARCHAR"), ("month", "month::VARCHAR"), ("fold", "fold::VARCHAR"))), ("forecasts",))
def A09_A31_evaluation_report(spark, d):
    day = _day(spark, d).withColumn("month", F.floor(F.col("time_idx") / 2880).cast("long"))
    return rounded(metrics.report(day.withColumn("ref", F.col("smart")), MODELS, "actual", "ref", ["horizon", "month", "fold"]), places=9)


@query("""
WITH z AS (SELECT fold, actual, CASE WHEN time_idx % 3 = 0 THEN 0e0 ELSE smart END AS f FROM (""" + DAY + """)), g AS (SELECT fold, count(*) AS count, count(*) FILTER (abs(f) <= 1e-12) AS zeros, count(*) FILTER (abs(f) <= 1e-12 AND actual > 0.1e0) AS zeros_while_producing,
  avg((f - actual) * (f - actual)) FILTER (abs(f) <= 1e-12) AS zm, coalesce(sum((f - actual) * (f - actual)) FILTER (abs(f) <= 1e-12), 0) / nullif(sum((f - actual) * (f - actual)), 0) AS zs FROM z GROUP BY ROLLUP (fold))
SELECT fold, count, zeros, zeros_while_producing, round(zm, 9) AS zero_mse, round(zs, 9) AS zero_error_share, round(zeros / count, 9) AS zero_rate, zeros / count > 0.5e0 OR zeros_while_producing > 0 OR coalesce(zs, 0) > 0.5e0 AS suspicious FROM g
""", ("forecasts",))
def A10_zero_diagnostics(spark, d):
    z = _day(spark, d).withColumn("f", F.when(F.col("time_idx") % 3 == 0, 0.0).otherwise(F.col("smart")))
    return rounded(metrics.zero_diagnostics(z, "actual", "f", "fold"), places=9)


@query("SELECT site_id, coalesce(1e0 - avg((point - actual) * (point - actual)) / nullif(avg((smart - actual) * (smart - actual)), 0) >= 0.1e0, false) AS accepted, coalesce(1e0 - avg(abs(point - actual)) / nullif(avg(abs(smart - actual)), 0) >= 0.1e0, false) AS low_accepted FROM (" + DAY + ") GROUP BY site_id", ("forecasts",))
def A11_acceptance(spark, d):
    g = _day(spark, d).groupBy("site_id").agg(metrics.skill(metrics.mse("actual", "point"), metrics.mse("actual", "smart")).alias("s"), metrics.skill(metrics.mae("actual", "point"), metrics.mae("actual", "smart")).alias("low"))
    a, b = metrics.acceptance(F.col("s"), F.col("low"), 0.1)
    return g.select("site_id", a.alias("accepted"), b.alias("low_accepted"))


@query("""
WITH r AS (SELECT *, abs(f - lag(f) OVER (PARTITION BY site_id ORDER BY time_idx)) AS ramp FROM (SELECT site_id, time_idx, actual, point AS f, elev FROM forecasts WHERE horizon = 1 AND actual IS NOT NULL))
SELECT site_id, count(*) AS count, min(f) AS min, max(f) AS max, round(avg(f), 9) AS mean, round(stddev_pop(f), 9) AS std, """ + ", ".join(f"round(quantile_cont(f, {q}), 9) AS p{round(q * 100):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + """,
  round(sum(f), 6) AS sum, round(avg((abs(f) <= 1e-9)::INT), 9) AS zero_share, round(avg(f - actual), 9) AS bias_mean, round(sum(f - actual), 6) AS bias_sum, round(corr(actual, f), 9) AS corr, count(*) FILTER (f < 0) AS negatives,
  round(avg(ramp), 9) AS ramp_mean, round(quantile_cont(ramp, 0.95), 9) AS ramp_p95, round(avg((f > 1e-6)::INT) FILTER (elev <= 1), 9) AS night_positive_share FROM r GROUP BY site_id
""", ("forecasts",))
def A14_forecast_diagnostics(spark, d):
    f = A.forecasts(spark, d).where("horizon = 1")
    out = metrics.diagnostics(f, ["site_id"], "time_idx", "actual", "point", "elev")
    return rounded(out.withColumns({"sum": r6(F.col("sum")), "bias_sum": r6(F.col("bias_sum"))}), places=9)


@query("SELECT fold, round(avg((actual BETWEEN q10 AND q90)::INT), 9) AS coverage, round(avg(q90 - q10), 9) AS width FROM (" + DAY + ") GROUP BY fold", ("forecasts",))
def A15_interval_diagnostics(spark, d):
    return rounded(_day(spark, d).groupBy("fold").agg(*metrics.interval_diagnostics("actual", "q10", "q90")), places=9)


@query("SELECT fold, round((" + " + ".join(f"avg(greatest({q}e0 * (actual - {quantile_name(q)}), ({q}e0 - 1e0) * (actual - {quantile_name(q)})))" for q in QUANTILES) + ") / 7e0, 9) AS pinball FROM (" + DAY + ") GROUP BY fold", ("forecasts",))
def A16_pinball(spark, d):
    return rounded(_day(spark, d).groupBy("fold").agg(metrics.mean_pinball("actual").alias("pinball")), places=9)


@query("WITH s AS (SELECT *, CASE WHEN fold % 3 = 0 THEN 'train' WHEN fold % 3 = 1 THEN 'validation' ELSE 'test' END AS split FROM forecasts WHERE actual IS NOT NULL), l AS (SELECT split, 'point' AS model, point AS f, actual, smart FROM s UNION ALL SELECT split, 'scratch', scratch, actual, smart FROM s) SELECT split, model, " + _summary("f") + " FROM l GROUP BY ALL", ("forecasts",))
def A17_metrics_table(spark, d):
    f = A.forecasts(spark, d).withColumn("split", F.when(F.col("fold") % 3 == 0, "train").when(F.col("fold") % 3 == 1, "validation").otherwise("test"))
    return rounded(metrics.point_metrics(f, ["split"], "actual", ["point", "scratch"], "smart"), places=9)


LOSSES = {"mse": "e * e", "mse_heavy": "0.75e0 * e * e + 0.25e0 * hub", "balanced": "0.5e0 * e * e + 0.5e0 * hub", "mae_heavy": "0.75e0 * abs(e) + 0.25e0 * e * e", "mae": "abs(e)"}


@query("WITH x AS (SELECT horizon, (point - actual) * 4e0 AS e FROM forecasts WHERE actual IS NOT NULL), h AS (SELECT *, CASE WHEN abs(e) <= 1 THEN 0.5e0 * e * e ELSE abs(e) - 0.5e0 END AS hub FROM x) SELECT horizon, " + ", ".join(f"round(avg({s}), 8) AS {n}" for n, s in LOSSES.items()) + " FROM h GROUP BY horizon", ("forecasts",))
def A18_point_losses(spark, d):
    f = A.forecasts(spark, d).where("actual IS NOT NULL")
    return rounded(f.groupBy("horizon").agg(*[F.avg(fx.point_loss(n, F.col("point") * 4, F.col("actual") * 4)).alias(n) for n in LOSSES]), places=8)


@query("WITH m AS (SELECT site_id, round(avg(abs(point - actual)), 9) AS mae, round(avg((point - actual) * (point - actual)), 9) AS mse FROM (" + DAY + ") GROUP BY site_id) SELECT m.site_id, m.mae, m.mse, round(m.mae - b.mae, 9) AS mae_delta, round(m.mse - b.mse, 9) AS mse_delta FROM m, m b WHERE b.site_id = 'click'", ("forecasts",))
def A30_compare_to_current(spark, d):
    m = rounded(_day(spark, d).groupBy("site_id").agg(metrics.mae("actual", "point").alias("mae"), metrics.mse("actual", "point").alias("mse")), places=9)
    return rounded(metrics.compare_to(m, "site_id", "click", ["mae", "mse"]), places=9)


@query("SELECT site_id, issue_idx, time_idx, horizon FROM (" + DAY + ")", ("forecasts",))
def P12_common_daylight(spark, d):
    return _day(spark, d).select("site_id", "issue_idx", "time_idx", "horizon")


@query("SELECT site_id, time_idx, horizon FROM (SELECT *, CASE WHEN time_idx % 50 <> 0 THEN point END AS p FROM forecasts) WHERE elev > 0 AND actual IS NOT NULL AND p IS NULL ORDER BY site_id, time_idx, horizon LIMIT 5", ("forecasts",))
def P12_L03_lacking_sample(spark, d):
    f = A.forecasts(spark, d).withColumn("p", F.when(F.col("time_idx") % 50 != 0, F.col("point")))
    return metrics.lacking(f, "elev", "actual", ["p"]).select("site_id", "time_idx", "horizon").orderBy("site_id", "time_idx", "horizon").limit(5)


@query("SELECT site_id, time_idx, horizon FROM forecasts WHERE horizon % 2 > 0 AND fold % 3 > 0", ("forecasts",))
def P13_valid_weather(spark, d):
    f = A.forecasts(spark, d).withColumns({"flag_a": F.col("horizon") % 2, "flag_b": F.col("fold") % 3})
    return f.where("flag_a > 0 AND flag_b > 0").select("site_id", "time_idx", "horizon")


@query("SELECT site_id, time_idx, greatest(energy - 20, 0e0) AS actual, round(cs * 1361e0, 6) AS clear_sky FROM sky WHERE energy IS NOT NULL", ("sky",))
def P14_plan_comparison_rows(spark, d):
    s = A.sky(spark, d).where("energy IS NOT NULL")
    return s.select("site_id", "time_idx", F.greatest(F.col("energy") - 20, F.lit(0.0)).alias("actual"), r6(F.col("cs") * fx.SOLAR_CONSTANT).alias("clear_sky"))


@query("SELECT s.s_suppkey AS site_id, p.p_brand AS battery, 0e0 AS charge, 0e0 AS discharge, round(p.p_size * 0.15e0, 6) AS soc FROM supplier s JOIN part p ON p.p_partkey = s.s_suppkey")
def P18_battery_schedule(spark, d):
    """Each supplier with the part of its number as its battery."""
    b = A.table(spark, d, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("battery"), F.col("p_size").cast("double").alias("capacity_mwh"), F.lit(0.15).alias("min_soc"))
    s = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.lit(0.0).alias("forecast"))
    return forecast.battery_schedule(s, b, "site_id", "forecast").select("site_id", "battery", "charge", "discharge", r6(F.col("soc")).alias("soc"))


@query("""
WITH s AS (SELECT site_id, time_idx, energy, row_number() OVER (PARTITION BY site_id ORDER BY time_idx) <= floor(count(*) OVER (PARTITION BY site_id) * 0.6e0) AS train FROM pv),
t AS (SELECT site_id, greatest(max(energy) FILTER (train), 1e0) AS top FROM s GROUP BY site_id)
SELECT site_id, time_idx, round(energy / top, 9) AS scaled, CASE WHEN NOT train THEN round(greatest(energy / top - 0.1e0, 0e0) * top, 6) END AS q50 FROM s JOIN t USING (site_id)
""", ("pv",))
def P20_legacy_scaling(spark, d):
    s = windows.chronological_split(A.pv(spark, d), ["site_id"], "time_idx", 0.6, 0.2)
    top = s.groupBy("site_id").agg(F.greatest(F.max(F.when(F.col("split") == "train", F.col("energy"))), F.lit(1.0)).alias("top"))
    s = s.join(few(top), "site_id").withColumn("scaled", F.col("energy") / F.col("top"))
    q = F.when(F.col("split") != "train", r6(F.greatest(F.col("scaled") - 0.1, F.lit(0.0)) * F.col("top")))
    return s.select("site_id", "time_idx", F.round("scaled", 9).alias("scaled"), q.alias("q50"))


@query("""
WITH i AS (SELECT site_id, fold, issue_idx, count(*) AS n, sum(round((point - actual) * (point - actual) * 1e9)::BIGINT) AS sse FROM (""" + DAY + """) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY fold, issue_idx) - 1 AS block, least(15, count(*) OVER (PARTITION BY site_id)) AS size FROM i)
SELECT site_id, block, sum(n) OVER w::BIGINT AS n, sum(sse) OVER w::BIGINT AS sse FROM b WINDOW w AS (PARTITION BY site_id ORDER BY block ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) QUALIFY count(*) OVER w = size
""", ("forecasts",))
def W17_issue_blocks(spark, d):
    e = F.col("point") - F.col("actual")
    return windows.issue_blocks(_day(spark, d), ["site_id"], ["fold", "issue_idx"], {"sse": F.round(e * e * 1e9).cast("long")}, 15)


@query("""
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS block, least(10, count(*) OVER (PARTITION BY user_id)) AS size, event_id FROM events)
SELECT user_id, block, count(*) OVER w AS n, (sum(event_id) OVER w)::BIGINT AS total FROM r WINDOW w AS (PARTITION BY user_id ORDER BY block ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) QUALIFY count(*) OVER w = size
""")
def W17_row_blocks(spark, d):
    """Plain rows, where nothing says which belong together; a user with fewer than 10 has one block."""
    return windows.issue_blocks(A.table(spark, d, "events"), ["user_id"], ["event_id"], {"total": F.col("event_id")}, 10)


def _intervals(replicates):
    """The five metrics of each replicate, and their 2.5 and 97.5 percentiles."""
    n = F.col("n")
    m = replicates.select((F.col("sse") / n).alias("mse"), F.sqrt(F.col("sse") / n).alias("rmse"), (F.col("sae") / n).alias("mae"), (F.col("se") / n).alias("mbe"), (1 - F.try_divide(F.col("sse"), F.col("ref"))).alias("skill"))
    return m.unpivot([], ["mse", "rmse", "mae", "mbe", "skill"], "metric", "v").groupBy("metric").agg(F.percentile("v", F.lit(0.025)).alias("ci_low"), F.percentile("v", F.lit(0.975)).alias("ci_high"))


def _loss_sums():
    e, r = F.col("point") - F.col("actual"), F.col("smart") - F.col("actual")
    return {"sse": e * e, "sae": F.abs(e), "se": e, "ref": r * r}


#: Common table expressions of the replicates' metrics m, and of their intervals ci.
BOOTSTRAP = """
d AS (""" + DAY + """), i AS (SELECT fold, issue_idx, count(*) AS n, row_number() OVER (ORDER BY fold, issue_idx) - 1 AS pos FROM d GROUP BY fold, issue_idx),
s AS (SELECT count(*) AS issues, sum(n) AS total, least(15, count(*)) AS size FROM i),
b AS (SELECT pos AS block, sum(n) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS n FROM i QUALIFY pos <= (SELECT issues - size FROM s)),
w AS (SELECT r AS replicate, p AS place, (r * 31 + p * 17 + r * p * 7) % (SELECT count(*) FROM b) AS block FROM range(0, 20) t(r), range(0, (SELECT ceil(total / (SELECT min(n) FROM b))::BIGINT FROM s)) u(p)),
c AS (SELECT w.*, coalesce(sum(b.n) OVER (PARTITION BY replicate ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w JOIN b USING (block)),
x AS (SELECT c.replicate, c.place, i.pos, d.* FROM c JOIN i ON i.pos BETWEEN c.block AND c.block + (SELECT size FROM s) - 1 JOIN d ON d.fold = i.fold AND d.issue_idx = i.issue_idx WHERE c.before < (SELECT total FROM s)),
y AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY place, pos, site_id, horizon) AS k FROM x),
m AS (SELECT replicate, """ + _summary("point").replace("count(*) AS count, ", "") + """ FROM y WHERE k <= (SELECT total FROM s) GROUP BY replicate),
ci AS (SELECT metric, round(quantile_cont(v, 0.025), 7) AS ci_low, round(quantile_cont(v, 0.975), 7) AS ci_high FROM (UNPIVOT (SELECT mse, rmse, mae, mbe, skill FROM m) ON mse, rmse, mae, mbe, skill INTO NAME metric VALUE v) GROUP BY metric)
"""


@query(f"WITH {BOOTSTRAP} SELECT * FROM ci", ("forecasts",))
def W18_block_bootstrap(spark, d):
    """Draws by a formula that SQL has as well; `choose` is left out for draws by a hash."""
    return rounded(_intervals(_replicates(_day(spark, d))), places=7)


def _replicates(rows):
    choose = F.expr("(replicate * 31 + place * 17 + replicate * place * 7) % k")
    return windows.moving_block_bootstrap(rows, ["fold", "issue_idx"], ["site_id", "horizon"], _loss_sums(), 15, 20, choose=choose)


@query("""
WITH w AS (SELECT site_id, time_idx, list(coalesce(cf, 0e0)) OVER (PARTITION BY site_id ORDER BY time_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS enc, list(cs) OVER (PARTITION BY site_id ORDER BY time_idx ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS dec FROM sky)
SELECT site_id, time_idx, array_to_string(list_transform(enc, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',') AS encoder, array_to_string(list_transform(dec, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ',') AS decoder FROM w WHERE len(enc) = 8 AND len(dec) = 8
""", ("sky",))
def W19_sequences(spark, d):
    s = windows.sequences(A.sky(spark, d).withColumn("x", F.coalesce("cf", F.lit(0.0))), ["site_id"], "time_idx", ["x", "cs"], 8, 8)
    text = lambda c, f: F.array_join(F.transform(c, lambda r: F.round(r[f] * 1000000).cast("long").cast("string")), ",")
    return s.select("site_id", "time_idx", text("encoder", "x").alias("encoder"), text("decoder", "cs").alias("decoder"))


def _rows_of_parts(folds, events):
    """folds with the number of events in each part: the few folds go to the events, not the other way round."""
    n = joins.assign_folds(events, folds, "ts").groupBy("fold", "part").agg(F.count("*").alias("rows"))
    return folds.join(n, ["fold", "part"], "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


@query("""
WITH m AS (SELECT i AS fold, (DATE '2023-11-01' + i * INTERVAL 1 MONTH)::DATE AS m FROM range(0, 12) t(i)), f AS (SELECT * FROM m WHERE (m + INTERVAL 5 MONTH)::DATE <= DATE '2024-06-30' + 1)
SELECT f.fold, p.part, count(e.event_id) AS rows FROM f, (VALUES ('train', 0, 3), ('validation', 3, 4), ('test', 4, 5)) p (part, a, b)
LEFT JOIN events e ON e.ts >= f.m + p.a * INTERVAL 1 MONTH AND e.ts < f.m + p.b * INTERVAL 1 MONTH GROUP BY ALL
""")
def F17_rolling_folds(spark, d):
    folds = forecast.rolling_folds(spark, "2023-11-01", "2024-06-30", 3)
    e = A.table(spark, d, "events").select("event_id", "ts")
    return _rows_of_parts(folds, e).select("fold", "part", "rows")


@query("""
WITH f AS (SELECT m - 4 AS fold, m FROM range(4, 12) t(m)), w AS (SELECT fold, part, timezone('Europe/Helsinki', make_date(2024, 1, 1) + (a - 1) * INTERVAL 1 MONTH) AS lo, timezone('Europe/Helsinki', make_date(2024, 1, 1) + (b - 1) * INTERVAL 1 MONTH) AS hi
  FROM (SELECT fold, 'train' AS part, 1 AS a, m AS b FROM f UNION ALL SELECT fold, 'validation', m, m + 1 FROM f UNION ALL SELECT fold, 'test', m + 1, m + 2 FROM f))
SELECT fold, part, epoch_us(lo) // 1000000 AS lo, epoch_us(hi) // 1000000 AS hi, count(e.event_id) AS rows FROM w LEFT JOIN events e ON epoch_us(e.ts) >= epoch_us(lo) AND epoch_us(e.ts) < epoch_us(hi) GROUP BY ALL
""")
def F18_expanding_folds(spark, d):
    folds = forecast.expanding_folds(spark, 2024, "Europe/Helsinki")
    e = A.table(spark, d, "events").select("event_id", "ts")
    return _rows_of_parts(folds, e).select("fold", "part", F.unix_seconds("start").alias("lo"), F.unix_seconds("end").alias("hi"), "rows")


@query("SELECT o_custkey, greatest(1, floor(quantile_cont(o_orderkey % 37, 0.5) + 0.5e0))::BIGINT AS epochs FROM orders GROUP BY o_custkey")
def A29_final_epochs(spark, d):
    o = A.table(spark, d, "orders").withColumn("epoch", F.col("o_orderkey") % 37)
    return forecast.final_epochs(o, ["o_custkey"], "epoch")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size::BIGINT END AS epoch, p_partkey / 100 AS val_loss FROM part")
def F16_checkpoint_fields(spark, d):
    path = F.concat(F.lit("/c/"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("epoch="), F.col("p_size").cast("string"), F.lit("-"))).otherwise(""), F.lit("val_loss="), F.format_string("%.2f", F.col("p_partkey") / 100), F.lit(".ckpt"))
    return A.table(spark, d, "part").withColumn("path", path).select("p_partkey", *[c.alias(n) for n, c in forecast.checkpoint_fields("path").items()])


FEATURES = [f"{p}_{f}_{k}" for p in ("year", "day") for k in (1, 2) for f in ("sin", "cos")]
START = 1893408  # the slot of 2024-01-01


def _harmonic(spark, d):
    """sky with the harmonics of the site's local time."""
    zone = A.site(spark, d).select("site_id", "lat", "capacity_mw", "timezone")
    s = A.sky(spark, d).join(few(zone), "site_id").withColumn("local", fx.local_time(fx.slot_start("time_idx"), F.col("timezone")))
    return s.withColumns(fx.harmonics("local"))


def _folds(spark, train: int, validation: int, test: int, count: int):
    """Windows of days that move on by the test's length: the events cover 30 days, not the months of real folds."""
    day = lambda n: F.lit(START).cast("long") + (F.col("fold") * test + n) * 96
    parts = [("train", 0, train), ("validation", train, train + validation), ("test", train + validation, train + validation + test)]
    f = spark.range(count).select(F.col("id").alias("fold"))
    return f.select("fold", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), day(a).alias("start"), day(b).alias("end")) for p, a, b in parts])).alias("r")).select("fold", "r.*")


@query()
def M02_M03_harmonic_persistence(spark, d):
    s = _harmonic(spark, d)
    train = s.where((F.col("cs") > 0) & F.col("cf").isNotNull() & (F.col("time_idx") < START + 96 * 20))
    return baselines.harmonic_persistence(s.where(F.col("time_idx") >= START + 96 * 20), train, 8, FEATURES)


@query(f"""
WITH f AS (SELECT fold, {START} + fold * 288 AS lo, {START} + fold * 288 + 1440 AS hi FROM range(0, 5) t(fold)), r AS (SELECT fold, count(*) AS rows FROM f JOIN sky ON time_idx >= lo AND time_idx < hi AND cs > 0 AND cf IS NOT NULL GROUP BY fold)
SELECT fold, rows, true AS certified, true AS balanced FROM r
""", ("sky",))
def M02_certified_curves(spark, d):
    """The clear-sky curve of each fold: that its loss is within a millionth of the least one, and that a share of 1 - q of
    the rows lies above it, but for the few rows on it."""
    s = _harmonic(spark, d)
    train = joins.assign_folds(s.select("time_idx", "cs", "cf", *FEATURES), _folds(spark, 15, 3, 3, 5), "time_idx").where("part = 'train' AND cs > 0 AND cf IS NOT NULL")
    curves = fit_certified(train, ["fold"], FEATURES, "cf", 0.99)
    above = train.join(F.broadcast(curves), "fold").withColumn("off", F.col("cf") - dot(F.col("coefficients"), FEATURES))
    n = above.groupBy("fold").agg(F.count("*").alias("rows"), F.count(F.when(F.col("off") > 1e-7, 1)).alias("over"), F.count(F.when(F.col("off") >= -1e-7, 1)).alias("on_or_over"))
    balanced = (F.col("over") <= F.col("rows") * 0.01 + 1e-9) & (F.col("on_or_over") >= F.col("rows") * 0.01 - 1e-9)
    return curves.join(n, "fold").select("fold", "rows", (F.col("gap") <= 1e-6 * F.col("loss")).alias("certified"), balanced.alias("balanced"))


@query()
def M03_fold_baselines(spark, d):
    """Both baselines of every fold's test targets, by the names of version 2."""
    s = _harmonic(spark, d)
    in_fold = joins.assign_folds(s.select("site_id", "time_idx", "cs", "cf", *FEATURES), _folds(spark, 15, 3, 3, 5), "time_idx")
    train = in_fold.where("part = 'train' AND cs > 0 AND cf IS NOT NULL")
    tests = in_fold.where("part = 'test'").select("fold", "site_id", F.col("time_idx").alias("target_idx"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("horizon"))
    return baselines.fold_baselines(tests.withColumn("issue_idx", F.col("target_idx") - F.col("horizon")), train, s, FEATURES, "v2")


def _supervised(spark, d):
    """Rows of eight horizons: an encoder of eight values, what is known of the target's time, the site's latitude and capacity."""
    s = _harmonic(spark, d).withColumn("x", F.coalesce("cf", F.lit(0.0)))
    weight = F.when(F.col("cf").isNull(), 0.0).when(F.col("cs") > 0, 1.0).otherwise(0.1)
    return forecast.horizon_rows(s.withColumn("weight", weight), "site_id", "time_idx", "x", [*FEATURES, "cs"], ["lat", "capacity_mw"], "weight")


def _pretrained(spark, d):
    """(model, rows, features): fitted on the source sites but for their last 30 days, or the last fifth of shorter data."""
    rows, features = _supervised(spark, d)
    rows = forecast.last_days(rows, "target_idx", forecast.validation_days(A.sky(spark, d), "time_idx"))
    return forecast.fit_forecaster(rows.where("site_id <> 'view' AND NOT valid"), ["horizon"], features, steps=12), rows, features


@query("""
WITH e AS (SELECT min(time_idx) AS lo, max(time_idx) AS hi FROM sky), v AS (SELECT (SELECT max(time_idx) FROM sky WHERE site_id <> 'view') AS hi, least(30, floor((hi - lo + 1) / 96e0 * 0.2e0))::BIGINT AS days FROM e)
SELECT site_id, time_idx > hi - days * 96 AS valid, days, count(*) AS rows, min(time_idx) AS first_idx, max(time_idx) AS last_idx FROM sky, v WHERE site_id <> 'view' GROUP BY ALL
""", ("sky",))
def M05_pretraining_split(spark, d):
    """What pretraining fits and validates on: the source sites, the last 30 days (a fifth of shorter data) held out."""
    s = A.sky(spark, d)
    days = forecast.validation_days(s, "time_idx")
    split = forecast.last_days(s.where("site_id <> 'view'"), "time_idx", days)
    return split.groupBy("site_id", "valid").agg(F.count("*").alias("rows"), F.min("time_idx").alias("first_idx"), F.max("time_idx").alias("last_idx")).withColumn("days", F.lit(days).cast("long"))


@query()
def M04_M05_pooled_forecaster(spark, d):
    """Eight horizons with a point and seven quantiles each, on the source sites' last days and on a site never seen."""
    model, rows, _ = _pretrained(spark, d)
    return forecast.predict(model, rows.where("valid")).select("site_id", "issue_idx", "target_idx", "horizon", "target", "point", *[quantile_name(q) for q in QUANTILES])


@query()
def M04_boosted_forecaster(spark, d):
    """Boosted trees beside the linear heads, fitted on the same rows: errors and quantile loss on the days held out, by
    horizon, of the source sites and of the site never seen."""
    linear, rows, features = _pretrained(spark, d)
    train = rows.where("site_id <> 'view' AND NOT valid")
    model = trees.fit_trees(train, ["horizon"], features, "target", QUANTILES, trees=12, weight="weight")
    held = forecast.predict(linear, rows.where("valid AND weight > 0")).withColumnRenamed("point", "linear")
    names = [quantile_name(q) for q in QUANTILES]
    held = held.withColumn("linear_pinball", sum((fx.pinball(q, n, "target") for q, n in zip(QUANTILES, names)), F.lit(0.0)) / len(QUANTILES)).drop(*names)
    scored = trees.predict_trees(model, held).withColumn("seen", F.col("site_id") != "view")
    return scored.groupBy("horizon", "seen").agg(F.count("*").alias("count"), metrics.mse("target", "point").alias("trees_mse"), metrics.mse("target", "linear").alias("linear_mse"), metrics.mean_pinball("target").alias("trees_pinball"), F.avg("linear_pinball").alias("linear_pinball"))


@query()
def M06_transfer_vs_scratch(spark, d):
    """On each fold of the target site: the source model with a fitted residual, against one fitted on the fold alone."""
    source, rows, features = _pretrained(spark, d)
    own = joins.assign_folds(rows.where("site_id = 'view'").drop("valid"), _folds(spark, 15, 3, 3, 4), "target_idx")
    train, by = own.where("part = 'train'"), ["fold", "horizon"]
    transfer = forecast.fit_transfer(source, train, by, features, steps=12)
    scratch = forecast.fit_forecaster(train, by, features, quantiles=())
    scored = forecast.predict(scratch, own.where("part <> 'train'").where("weight > 0")).withColumnRenamed("point", "scratch")
    scored = forecast.predict_transfer(transfer, scored)
    return scored.groupBy(*by, "part").agg(F.count("*").alias("count"), metrics.mse("target", "point").alias("transfer_mse"), metrics.mse("target", "scratch").alias("scratch_mse"), metrics.mse("target", "source_point").alias("source_mse"), metrics.mean_pinball("target").alias("pinball"))


def _rolling(spark, d):
    """(run, folds by run): a run that ends before the last fold; one that writes the last fold, badly, and breaks off
    before it is committed; and one that goes on from the state that these left."""
    f, folder = _day(spark, d), shared_folder(spark, "rolling")
    identity = io.provenance(f, KEY) + ":smart:v2"  # data set, configuration, schema
    last = f.agg(F.max("fold")).first()[0]
    first = FoldRun(spark, folder, identity).evaluate(f.where(F.col("fold") < last))
    FoldRun(spark, folder, identity).write(f.where(F.col("fold") == last).withColumn("point", F.lit(0.0)))
    resumed = FoldRun(spark, folder, identity)
    second = resumed.evaluate(f)
    return resumed, first, second


@query("SELECT fold, CASE WHEN fold < (SELECT max(fold) FROM forecasts WHERE elev > 0 AND actual IS NOT NULL) THEN 1 ELSE 2 END AS run, " + _summary("point") + " FROM (" + DAY + ") GROUP BY fold", ("forecasts",))
def M07_resumed_rolling_evaluation(spark, d):
    """Metrics of each fold from the stored predictions, and the run that finished it."""
    run, first, second = _rolling(spark, d)
    by = spark.createDataFrame([(k, n) for n, folds in ((1, first), (2, second)) for k in folds], "fold long, run int")
    scored = rounded(run.predictions().groupBy("fold").agg(*metrics.summary("actual", "point", "smart")), places=9)
    return scored.join(F.broadcast(by), "fold")


@query(f"WITH {BOOTSTRAP}, p AS (SELECT {_summary('point').replace('count(*) AS count, ', '')} FROM d), v AS (UNPIVOT p ON mse, rmse, mae, mbe, skill INTO NAME metric VALUE value) SELECT metric, value, ci_low, ci_high FROM v JOIN ci USING (metric)", ("forecasts",))
def M07_pooled_intervals(spark, d):
    """Pooled metrics over the stored folds of all runs, with the intervals of a block bootstrap."""
    run, _, _ = _rolling(spark, d)
    stored = run.predictions()
    pooled = rounded(stored.agg(*metrics.summary("actual", "point", "smart")).drop("count"), places=9)
    return pooled.unpivot([], pooled.columns, "metric", "value").join(rounded(_intervals(_replicates(stored)), places=7), "metric")


KEY = ["site_id", "issue_idx", "time_idx", "horizon", "fold"]
PROVENANCE = "(SELECT sum(('0x' || substr(sha256(site_id || '|' || issue_idx || '|' || time_idx || '|' || horizon || '|' || fold), 1, 15))::BIGINT)::VARCHAR FROM (" + DAY + "))"


@query(f"WITH {PERSIST}, j AS (SELECT f.site_id, f.issue_idx, f.horizon, f.point, f.actual, f.smart AS legacy_persistence, round(p.forecast, 6) AS smart FROM forecasts f JOIN p ON p.site_id = f.site_id AND p.time_idx = f.issue_idx AND p.horizon = f.horizon WHERE f.elev > 0 AND f.actual IS NOT NULL) SELECT horizon, " + _summary("point") + ", round(avg(legacy_persistence), 9) AS legacy_mean, " + PROVENANCE + " AS provenance FROM j GROUP BY horizon", ("forecasts",))
def M08_reevaluation(spark, d):
    """Stored predictions scored against a baseline made anew, with a digest of what was scored, in a folder of its own."""
    source, destination = shared_folder(spark, "predictions"), shared_folder(spark, "reevaluated")
    _day(spark, d).write.parquet(source)
    f = spark.read.parquet(source).withColumnRenamed("smart", "legacy_persistence")
    digest = io.provenance(f, KEY)
    p = rounded(baselines.smart_persistence(A.sky(spark, d), 4)).select("site_id", F.col("time_idx").alias("issue_idx"), "horizon", F.col("forecast").alias("smart"))
    j = f.join(p, ["site_id", "issue_idx", "horizon"])
    scored = rounded(j.groupBy("horizon").agg(*metrics.summary("actual", "point", "smart"), F.avg("legacy_persistence").alias("legacy_mean")), places=9)
    io.write_new(scored.withColumn("provenance", F.lit(digest)), destination, source)
    return spark.read.parquet(destination)


@query("WITH j AS (SELECT a.horizon, a.actual, a.point, b.scratch, a.smart FROM (" + DAY + ") a JOIN forecasts b USING (site_id, issue_idx, time_idx, horizon, fold)) SELECT 'weather' AS model, horizon, " + _summary("point") + " FROM j GROUP BY horizon UNION ALL SELECT 'baseline', horizon, " + _summary("scratch") + " FROM j GROUP BY horizon", ("forecasts",))
def M09_weather_ablation(spark, d):
    keys = ["site_id", "issue_idx", "time_idx", "horizon", "fold"]
    f = A.forecasts(spark, d)
    day = _day(spark, d).select(*keys, "actual", "smart", F.col("point").alias("weather"))
    j = day.join(f.select(*keys, F.col("scratch").alias("baseline")), keys)
    return rounded(metrics.point_metrics(j, ["horizon"], "actual", ["weather", "baseline"], "smart"), places=9)


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time_idx) AS k, count(*) OVER (PARTITION BY site_id) AS n, lag(cf, 1) OVER (PARTITION BY site_id ORDER BY time_idx) AS y1, lag(cs, 1) OVER (PARTITION BY site_id ORDER BY time_idx) AS c1, lag(cf, 96) OVER (PARTITION BY site_id ORDER BY time_idx) AS plan FROM sky),
s AS (SELECT CASE WHEN k <= floor(n * 0.6e0) THEN 'train' WHEN k <= floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'validation' ELSE 'test' END AS split, cf AS actual, plan, CASE WHEN c1 <> 0 AND y1 IS NOT NULL THEN greatest(y1 / c1 * cs, 0e0) END AS smart FROM k)
SELECT split, """ + _summary("plan") + " FROM s WHERE actual IS NOT NULL AND plan IS NOT NULL AND smart IS NOT NULL GROUP BY split", ("sky",))
def M13_plan_comparison(spark, d):
    s = windows.chronological_split(A.sky(spark, d), ["site_id"], "time_idx", 0.6, 0.2)
    s = windows.by_places(s, ["site_id"], "time_idx", lambda w: {"plan": F.lag("cf", 96).over(w), "smart": windows.clear_sky_persistence("cf", "cs", 1, ["site_id"], "time_idx", w=w)}, back=96)
    return rounded(metrics.point_metrics(s, ["split"], "cf", ["plan"], "smart").drop("model"), places=9)


SCALED = [f"greatest(least(plan * {0.6 + 0.8 * q:.3f}e0, 1e0), 0e0)" for q in QUANTILES]
LOSS = [f"avg(greatest({q}e0 * (actual - {x}), ({q}e0 - 1e0) * (actual - {x})))" for q, x in zip(QUANTILES, SCALED)]


@query("""
WITH k AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time_idx) AS k, count(*) OVER (PARTITION BY site_id) AS n, lag(cf, 96) OVER (PARTITION BY site_id ORDER BY time_idx) AS plan FROM sky),
s AS (SELECT CASE WHEN k <= floor(n * 0.6e0) THEN 'train' WHEN k <= floor(n * 0.6e0) + floor(n * 0.2e0) THEN 'validation' ELSE 'test' END AS split, cf AS actual, plan FROM k)
SELECT split, count(*) AS count, """ + ", ".join(f"round({x}, 9) AS {quantile_name(q)}" for q, x in zip(QUANTILES, LOSS)) + ", round((" + " + ".join(LOSS) + ") / 7e0, 9) AS pinball FROM s WHERE actual IS NOT NULL AND plan IS NOT NULL GROUP BY split", ("sky",))
def M13_plan_quantile_loss(spark, d):
    """The comparison's quantile loss: of a band about the plan, each quantile's and the mean, by split."""
    s = windows.chronological_split(A.sky(spark, d), ["site_id"], "time_idx", 0.6, 0.2)
    s = windows.lagged(s, ["cf"], 96, ["site_id"], "time_idx").withColumn("plan", F.col("cf_lag_96")).where("cf IS NOT NULL AND plan IS NOT NULL")
    s = s.withColumns({quantile_name(q): fx.clip(F.col("plan") * float(f"{0.6 + 0.8 * q:.3f}"), 0, 1) for q in QUANTILES})
    each = [F.avg(fx.pinball(q, quantile_name(q), "cf")).alias(quantile_name(q)) for q in QUANTILES]
    return rounded(s.groupBy("split").agg(F.count("*").alias("count"), *each, metrics.mean_pinball("cf").alias("pinball")), places=9)


LONG_PLAN = "p AS (SELECT site_id, time_idx, cf AS actual, cs, lag(cf, 96) OVER (PARTITION BY site_id ORDER BY time_idx) AS plan FROM sky), r AS (SELECT *, abs(plan - lag(plan) OVER (PARTITION BY site_id ORDER BY time_idx)) AS ramp FROM p WHERE actual IS NOT NULL AND plan IS NOT NULL)"


@query(f"WITH {LONG_PLAN} SELECT site_id, count(*) AS count, round(avg(plan), 9) AS mean, round(stddev_pop(plan), 9) AS std, round(avg(plan - actual), 9) AS bias_mean, round(corr(actual, plan), 9) AS corr, round(avg(ramp), 9) AS ramp_mean, round(avg((plan > 1e-6)::INT) FILTER (cs <= 1), 9) AS night_positive_share, round(avg((actual BETWEEN plan * 0.9e0 AND plan * 1.1e0)::INT), 9) AS coverage, round(avg(plan * 1.1e0 - plan * 0.9e0), 9) AS width FROM r GROUP BY site_id", ("sky",))
def M13_plan_diagnostics(spark, d):
    """Diagnostics of the plan, and of an interval of a tenth about it, beside the comparison."""
    s = windows.by_places(A.sky(spark, d), ["site_id"], "time_idx", lambda w: {"plan": F.lag("cf", 96).over(w)}, back=96).where("cf IS NOT NULL AND plan IS NOT NULL")
    s = s.withColumns({"low": F.col("plan") * 0.9, "high": F.col("plan") * 1.1})
    out = metrics.diagnostics(s, ["site_id"], "time_idx", "cf", "plan", "cs").select("site_id", "count", "mean", "std", "bias_mean", "corr", "ramp_mean", "night_positive_share")
    return rounded(out.join(s.groupBy("site_id").agg(*metrics.interval_diagnostics("cf", "low", "high")), "site_id"), places=9)


@query("SELECT fold, count(*) AS count, round(avg((point - actual) * (point - actual)), 9) AS mse, round(avg(abs(point - actual)), 9) AS mae, round((" + " + ".join(f"avg(greatest({q}e0 * (actual - {quantile_name(q)}), ({q}e0 - 1e0) * (actual - {quantile_name(q)})))" for q in QUANTILES) + ") / 7e0, 9) AS pinball, round(avg(0.75e0 * abs(point - actual) + 0.25e0 * (point - actual) * (point - actual)), 9) AS mae_heavy FROM (" + DAY + ") GROUP BY ROLLUP (fold)", ("forecasts",))
def X05_custom_aggregates(spark, d):
    """Summary, pinball and a point loss as aggregates of one pass."""
    loss = F.avg(fx.point_loss("mae_heavy", "point", "actual")).alias("mae_heavy")
    rows = _day(spark, d).rollup("fold").agg(F.count("*").alias("count"), metrics.mse("actual", "point").alias("mse"), metrics.mae("actual", "point").alias("mae"), metrics.mean_pinball("actual").alias("pinball"), loss)
    return rounded(rows, places=9)


@query("""
WITH s AS (SELECT date_trunc('month', min(ts))::DATE AS lo, (date_trunc('month', max(ts)) + INTERVAL 1 MONTH)::DATE AS hi FROM events),
m AS (SELECT i AS fold, (lo + i * INTERVAL 1 MONTH)::DATE AS m, hi FROM s, range(0, 600) t(i) WHERE lo + i * INTERVAL 1 MONTH < hi),
f AS (SELECT * FROM m WHERE (m + INTERVAL 3 MONTH)::DATE <= hi),
u AS (SELECT user_id, min(epoch_us(ts) // 86400000000) AS lo, max(epoch_us(ts) // 86400000000) + 1 AS hi FROM events GROUP BY user_id),
c AS (SELECT user_id, unnest(range(lo, hi, 7)) AS lo, hi FROM u)
SELECT 'fold' AS kind, f.fold::VARCHAR || '-' || p.part AS name, (epoch_us((f.m + p.a * INTERVAL 1 MONTH)::TIMESTAMP) // 86400000000)::BIGINT AS lo, (epoch_us((f.m + p.b * INTERVAL 1 MONTH)::TIMESTAMP) // 86400000000)::BIGINT AS hi FROM f, (VALUES ('train', 0, 1), ('validation', 1, 2), ('test', 2, 3)) p (part, a, b)
UNION ALL SELECT 'chunk', user_id::VARCHAR, lo, least(lo + 7, hi) FROM c
""")
def X06_table_generators(spark, d):
    """Folds over the events' months, and weekly chunks of each user's days."""
    e = A.table(spark, d, "events")
    ends = e.agg(F.date_trunc("month", F.min("ts")).cast("date").alias("lo"), F.last_day(F.max("ts")).alias("hi")).first()
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    folds = forecast.rolling_folds(spark, str(ends.lo), str(ends.hi), 1)
    folds = folds.select(F.lit("fold").alias("kind"), F.concat_ws("-", F.col("fold").cast("string"), "part").alias("name"), day("start").alias("lo"), day("end").alias("hi"))
    days = e.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.floor(F.min(F.unix_micros("ts")) / 86_400_000_000).cast("long").alias("lo"), (F.floor(F.max(F.unix_micros("ts")) / 86_400_000_000) + 1).cast("long").alias("hi"))
    return folds.unionByName(catalog.chunks(days, ["name"], 7).withColumn("kind", F.lit("chunk")))


@query("WITH b AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) SELECT row_number() OVER (ORDER BY status) + 1 AS k, '| ' || status || ' | ' || n || ' |' AS line FROM b UNION ALL SELECT 0, '| status | n |' UNION ALL SELECT 1, '| --- | --- |'")
def M14_markdown(spark, d):
    small = A.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return forecast.markdown(small, ["status", "n"], "status")


@query("SELECT time_idx, site_id FROM (SELECT *, xor(time_idx * 2654435761, 12345) % 1000 AS h FROM pv) WHERE h < 100", ("pv",))
def L05_hashed_sample(spark, d):
    h = F.expr("(time_idx * 2654435761L ^ 12345L) % 1000")
    return A.pv(spark, d).where(h < 100).select("time_idx", "site_id")


@query("""
WITH p AS (SELECT *, row_number() OVER (ORDER BY site_id, time_idx) - 1 AS place FROM pv)
SELECT r.draw, p.site_id, p.time_idx, p.energy FROM (SELECT d AS draw, (d * 7919 + d * d % 104729) % (SELECT count(*) FROM pv) AS place FROM range(0, 10000) t(d)) r JOIN p USING (place)
""", ("pv",))
def L05_sample_with_replacement(spark, d):
    """10,000 draws by a formula that SQL has as well; `choose` is left out for draws by a hash."""
    return windows.sample_with_replacement(A.pv(spark, d), ["site_id", "time_idx"], 10_000, choose=F.expr("(draw * 7919 + draw * draw % 104729) % k"))
