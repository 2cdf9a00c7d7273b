"""Queries on manifests, event logs, coverage, inventories, sinks and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import catalog, checks, grid, joins, windows
from ..session import settled, shared_folder
from ..sources import files, io
from . import adapters as A
from .production import CANONICAL, _canonical, rounded
from .registry import query

MERGED = """
p AS (SELECT grp, lo, hi, max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM coverage WHERE lo < hi),
i AS (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY lo, hi) AS island FROM p),
merged AS (SELECT grp, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY grp, island)
"""


@query(f"WITH {MERGED} SELECT * FROM merged", ("coverage",))
def W13_merge_intervals(spark, d):
    return windows.merge_intervals(A.coverage(spark, d), ["grp"])


@query(f"WITH {MERGED} SELECT grp, coalesce(max(hi) FILTER (lo <= 9500 AND hi > 9500), 9500) AS \"end\" FROM merged GROUP BY grp", ("coverage",))
def W14_coverage_end(spark, d):
    return windows.coverage_end(A.coverage(spark, d), ["grp"], 9500)


@query("WITH e AS (SELECT grp, lo AS t, 1 AS d FROM coverage WHERE lo < hi UNION ALL SELECT grp, hi, -1 FROM coverage WHERE lo < hi), s AS (SELECT grp, t, sum(d) AS d FROM e GROUP BY ALL), r AS (SELECT grp, sum(d) OVER (PARTITION BY grp ORDER BY t) AS o FROM s) SELECT grp, max(o)::BIGINT AS most FROM r GROUP BY grp", ("coverage",))
def W15_max_concurrency(spark, d):
    return windows.max_concurrency(A.coverage(spark, d), ["grp"])


CHUNKED = "r AS (SELECT grp, min(lo) AS a, max(hi) AS b FROM coverage GROUP BY grp), chunk AS (SELECT grp, lo, least(lo + 7, b) AS hi FROM (SELECT grp, b, unnest(range(a, b, 7)) AS lo FROM r))"


def _chunks(spark, d):
    r = A.coverage(spark, d).groupBy("grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return catalog.chunks(r, ["grp"], 7)


@query(f"WITH {CHUNKED} SELECT * FROM chunk", ("coverage",))
def F14_chunks(spark, d):
    return _chunks(spark, d)


@query(f"WITH {CHUNKED}, {MERGED} SELECT c.* FROM chunk c WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.grp = c.grp AND m.lo <= c.lo AND c.hi <= m.hi)", ("coverage",))
def J14_uncovered_chunks(spark, d):
    return joins.covered(_chunks(spark, d), windows.merge_intervals(A.coverage(spark, d), ["grp"]), "grp", "left_anti")


@query(f"""
WITH {CHUNKED}, {MERGED}, inside AS (SELECT c.* FROM chunk c WHERE EXISTS (SELECT 1 FROM merged m WHERE m.grp = c.grp AND m.lo <= c.lo AND c.hi <= m.hi)),
slots AS (SELECT grp, unnest(range(lo * 4, hi * 4)) AS slot FROM inside), seen AS (SELECT DISTINCT grp, lo * 4 AS slot FROM coverage WHERE interval_id % 2 = 0)
SELECT grp, (SELECT count(*) FROM chunk c WHERE c.grp = g.grp) AS chunks, (SELECT count(*) FROM inside c WHERE c.grp = g.grp) AS covered, (SELECT count(*) FROM chunk c WHERE c.grp = g.grp) - (SELECT count(*) FROM inside c WHERE c.grp = g.grp) AS remaining,
  (SELECT count(*) FROM slots s WHERE s.grp = g.grp AND s.slot NOT IN (SELECT slot FROM seen WHERE seen.grp = g.grp)) AS missing_slots FROM (SELECT DISTINCT grp FROM chunk) g
""", ("coverage",))
def A25_discovery_stats(spark, d):
    c = A.coverage(spark, d)
    products = c.where("interval_id % 2 = 0").select("grp", (F.col("lo") * 4).alias("slot"))
    return catalog.discovery_stats(_chunks(spark, d), windows.merge_intervals(c, ["grp"]), products, "grp", 4, "slot")


@query("""
WITH e AS (SELECT unnest(range(min(time_idx), max(time_idx) + 1)) AS slot FROM pv), o AS (SELECT user_id, epoch_us(ts) // 900000000 AS slot FROM events WHERE event_type = 'click')
SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM e WHERE slot IN (SELECT slot FROM o)) AS observed, (SELECT count(*) FROM e WHERE slot NOT IN (SELECT slot FROM o)) AS missing,
  (SELECT count(*) FROM (SELECT user_id FROM o GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM (SELECT slot FROM o GROUP BY 1 HAVING count(*) > 1)) AS repeated_slots
""", ("pv",))
def A24_J15_coverage_report(spark, d):
    ends = A.pv(spark, d).agg(F.min("time_idx").alias("lo"), F.max("time_idx").alias("hi"))
    expected = ends.select(F.explode(F.sequence("lo", "hi")).alias("slot"))
    observed = A.table(spark, d, "events").where("event_type = 'click'").select("user_id", fx.slot_index("ts").alias("slot"))
    return catalog.coverage_report(observed, expected, "user_id", "slot")


@query("SELECT user_id % 10 AS grp, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY ROLLUP (user_id % 10)")
def A26_status_counts(spark, d):
    return catalog.status_counts(A.table(spark, d, "events").withColumn("grp", F.col("user_id") % 10), ["grp"], "event_type", ["click", "error"])


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (value <> 0) AS non_zero, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def A13_data_quality(spark, d):
    e = A.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum((F.col("value") != 0).cast("long")).alias("non_zero"), F.min("value").alias("least"), F.max("value").alias("most"))


def _manifest(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_mktsegment").alias("kind"))


@query("""
WITH l AS (SELECT product_id, arg_max(status, seq) AS status, arg_max(happened, seq) AS happened, count(*) AS events FROM products GROUP BY product_id)
SELECT c_custkey AS product_id, c_mktsegment AS kind, coalesce(l.status, 'discovered') AS status, coalesce(l.happened, 0) AS happened, coalesce(events, 0) AS events FROM customer LEFT JOIN l ON l.product_id = c_custkey
""", ("products",))
def S17_T02_replay_log(spark, d):
    return catalog.replay(_manifest(spark, d), A.products(spark, d), "product_id", "seq", ["status", "happened"], {"status": "discovered", "happened": 0})


OUTCOME = "CASE status WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'empty' ELSE 'error' END"


@query(f"""
WITH o AS (SELECT product_id, {OUTCOME} AS r, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS n FROM products), e AS (SELECT product_id, min(n) FILTER (r = 'ok' OR (r = 'empty' AND n > 1)) AS done, max(n) AS n FROM o GROUP BY product_id)
SELECT e.product_id, CASE WHEN done IS NULL THEN 'failed' WHEN o.r = 'ok' THEN 'processed' ELSE 'unavailable_source' END AS status, coalesce(done, e.n) AS attempts FROM e LEFT JOIN o ON o.product_id = e.product_id AND o.n = e.done
""", ("products",))
def T03_lifecycle_batch(spark, d):
    o = A.products(spark, d).withColumn("outcome", F.when(F.col("status") == "purchase", "ok").when(F.col("status") == "error", "empty").otherwise("error"))
    return catalog.lifecycle(o, "product_id", "seq", "outcome")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def S14_compact_parts(spark, d):
    folder = shared_folder(spark, "parts")
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for k in range(3):
        io.append_part(o.where(F.col("o_orderkey") % 3 == k), folder, str(k), "o_custkey", "o_orderkey")
    return catalog.compact(io.read_parts(spark, folder).drop("chunk_id"), "o_custkey", "o_orderkey")


@query("SELECT k::VARCHAR AS chunk, count(DISTINCT o_custkey) AS rows, 'read' AS state FROM (SELECT o_orderkey % 3 AS k, o_custkey FROM orders) GROUP BY k UNION ALL SELECT 'broken', 0, 'unreadable'")
def S14_unreadable_parts(spark, d):
    """Parts of orders, and one that isn't Parquet: it is skipped, and reported."""
    folder = shared_folder(spark, "parts")
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    for k in range(3):
        io.append_part(o.where(F.col("o_orderkey") % 3 == k), folder, str(k), "o_custkey", "o_orderkey")
    o.limit(1).select(F.col("o_orderkey").cast("string")).coalesce(1).write.text(f"{folder}/chunk_id=broken", lineSep="\n")
    files.rename_suffix(spark, f"{folder}/chunk_id=broken", ".txt", ".parquet")
    report = io.part_report(spark, folder).where("state <> 'empty'").withColumn("chunk", F.regexp_extract("path", "chunk_id=([^/]+)", 1))
    return report.groupBy("chunk", "state").agg(F.sum("rows").alias("rows")).select("chunk", "rows", "state")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def S15_purge(spark, d):
    gone = A.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.purge(A.table(spark, d, "orders"), gone, "o_custkey").select("o_orderkey")


@query("SELECT c_custkey AS product_id, c_mktsegment AS kind, true AS same FROM customer")
def S16_manifest_json(spark, d):
    """The manifest as JSON, and the Parquet view made of it; `same` says that both have the row alike."""
    folder = shared_folder(spark, "manifest")
    io.write_manifest(_manifest(spark, d), folder)
    json, view = io.read_manifest(spark, folder, "product_id long, kind string")
    both = json.join(view.withColumnRenamed("kind", "viewed"), "product_id", "full_outer")
    return both.select("product_id", "kind", F.col("kind").eqNullSafe(F.col("viewed")).alias("same"))


@query(CANONICAL + "SELECT site_id, count(*) AS rows, count(capacity_factor) AS observed, true AS as_listed FROM c GROUP BY site_id", ("pv_user",))
def S06_M15_canonical_roundtrip(spark, d):
    from ..operators.grid import manifest

    folder, c = shared_folder(spark, "canonical"), _canonical(spark, d)
    io.write_canonical(c, manifest(c), folder)
    data, listed = io.read_canonical(spark, folder)
    site = F.col("site_id").cast("long").alias("site_id")
    found = data.groupBy(site).agg(F.count("*").alias("rows"), F.count("capacity_factor").alias("observed"))
    listed = listed.where("site_id IS NOT NULL").select(site, F.struct("rows", "observed").alias("listed"))
    same = F.struct("rows", "observed").eqNullSafe(F.struct("listed.rows", "listed.observed"))
    return found.join(listed, "site_id", "full_outer").select("site_id", "rows", "observed", same.alias("as_listed"))


@query("SELECT site_id, count(*) AS rows, round(sum(energy), 4) AS energy FROM pv GROUP BY site_id", ("pv",))
def S13_site_shards(spark, d):
    folder = shared_folder(spark, "shards")
    io.write_shards(A.pv(spark, d), folder)
    return spark.read.parquet(folder).groupBy("site_id").agg(F.count("*").alias("rows"), F.round(F.sum("energy"), 4).alias("energy"))


@query("SELECT product_id % 7 AS day, count(*) AS patches, sum(len(pixels))::BIGINT AS pixels FROM patch GROUP BY 1", ("patch",))
def S12_patch_sink(spark, d):
    folder = shared_folder(spark, "patches")
    p = A.patch(spark, d).select("pixels", F.struct("product_id", "site_id").alias("metadata"), (F.col("product_id") % 7).alias("day"))
    io.write_patches(p, folder)
    return spark.read.parquet(folder).groupBy(F.col("day").cast("long").alias("day")).agg(F.count("*").alias("patches"), F.sum(F.size("pixels")).alias("pixels"))


@query("SELECT site_id, issue_idx, horizon, fold, point FROM forecasts", ("forecasts",))
def S18_predictions_csv(spark, d):
    folder = shared_folder(spark, "predictions")
    io.write_predictions(A.forecasts(spark, d).select("site_id", "issue_idx", "horizon", "point", "fold"), folder)
    return io.read_predictions(spark, folder, "site_id string, issue_idx long, horizon long, point double, fold long")


METRIC_FILES = "SELECT fold, count(*) AS count, round(avg((point - actual) * (point - actual)), 9) AS mse, round(avg(abs(point - actual)), 9) AS mae FROM forecasts WHERE elev > 0 AND actual IS NOT NULL"


@query(f"{METRIC_FILES} GROUP BY ROLLUP (fold)", ("forecasts",))
def S18_metric_files(spark, d):
    """Metrics of each fold through CSV, and pooled ones (fold NULL) through JSON."""
    from ..operators import metrics

    folder = shared_folder(spark, "metrics")
    day = metrics.daylight(A.forecasts(spark, d), "elev", "actual", ["point"])
    table = day.rollup("fold").agg(F.count("*").alias("count"), F.round(metrics.mse("actual", "point"), 9).alias("mse"), F.round(metrics.mae("actual", "point"), 9).alias("mae"))
    io.write_metrics(table, folder, "fold")
    return io.read_metrics(spark, folder, "fold long, count long, mse double, mae double")


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, octet_length(encode(text)) AS length FROM documents")
def S19_content_hash(spark, d):
    content = F.encode("text", "UTF-8")
    files = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"), F.length(content).alias("length"))
    return catalog.content_hash(files)


def _digest(rows: str, by: str) -> str:
    """SQL of a group's digest over lines h."""
    return f"SELECT {by}, sha256(string_agg(d, chr(10) ORDER BY k)) AS digest FROM (SELECT {by}, substr(h, 1, 3) AS k, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM ({rows}) GROUP BY ALL) GROUP BY {by}"


@query(_digest("SELECT o_orderstatus, sha256(o_orderkey::VARCHAR || '|' || o_custkey::VARCHAR || '|' || o_orderpriority) AS h FROM orders", "o_orderstatus"))
def S20_inventory_hash(spark, d):
    return catalog.inventory_hash(A.table(spark, d, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || c_nationkey || '}') AS fingerprint FROM customer""")
def S21_fingerprint(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", catalog.fingerprint(["c_nationkey", "c_mktsegment", "c_custkey"]).alias("fingerprint"))


def _backup(spark, d):
    c = A.table(spark, d, "customer")
    e = c.where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"), F.sha2("c_name", 256).alias("digest"))
    k = c.where("c_custkey % 10 <> 4").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 == 5, "x").otherwise(F.sha2("c_name", 256)).alias("digest"))
    return catalog.verify_backup(e, k, "id", "digest")


@query("SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 3 THEN 'unexpected' WHEN 4 THEN 'missing' WHEN 5 THEN 'mismatch' ELSE 'ok' END AS state FROM customer")
def S22_verify_backup(spark, d):
    return _backup(spark, d)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 NOT IN (3, 4, 5) AND c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 1")
def S22_deletable(spark, d):
    p = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "processed").otherwise("failed").alias("status"), (F.col("c_nationkey") % 2 == 0).alias("deleted"))
    return catalog.deletable(p, _backup(spark, d), "id").select("id")


@query("WITH c AS (SELECT unnest([0, 1, 2, 3]) AS c, pixels FROM patch), x AS (SELECT c, unnest(pixels[c * 16 + 1 : c * 16 + 16]) AS v FROM c) SELECT c::BIGINT AS channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM x GROUP BY c", ("patch",))
def S24_stats_sink(spark, d):
    from ..operators.satellite import channel_stats

    folder = shared_folder(spark, "stats")
    io.write_stats(channel_stats(A.patch(spark, d), 4, 16), folder, "v1")
    return rounded(io.read_stats(spark, folder, "v1", 4).select("channel", "mean", "scale"))


# --- validators ------------------------------------------------------------------


@query("SELECT rule, n FROM (UNPIVOT (SELECT count(*) FILTER (NOT epoch_us(o_orderdate) > 800000000000000 + o_custkey * 1000000000) AS after_issue, count(*) FILTER (NOT epoch_us(o_orderdate) >= 800000000000000 + o_custkey * 1000000000) AS lead, count(*) FILTER (epoch_us(o_orderdate) % 900000000 <> 0) AS on_grid FROM orders) ON after_issue, lead, on_grid INTO NAME rule VALUE n)")
def V01_window_rules(spark, d):
    o = A.table(spark, d, "orders").withColumn("issue", F.timestamp_micros(F.lit(800000000000000) + F.col("o_custkey") * 1000000000))
    return checks.violation_counts(o, checks.window_rules("issue", "o_orderdate"))


@query("SELECT rule, n FROM (UNPIVOT (SELECT count(*) FILTER (NOT step >= 6) AS released, count(*) FILTER (NOT step >= 2) AS cutoff FROM nwp) ON released, cutoff INTO NAME rule VALUE n)", ("nwp",))
def V02_operational_rules(spark, d):
    hour = 3_600_000_000
    n = A.nwp(spark, d).select(F.timestamp_micros(F.col("issue") * hour).alias("issue"), F.timestamp_micros((F.col("issue") + F.col("step")) * hour).alias("target"))
    return checks.violation_counts(n, checks.operational_rules("issue", "target", "target"))


@query("SELECT 'both' AS flags, avg((event_type = 'click')::INT) AS a, avg((event_type = 'view')::INT) AS b, avg((event_type = 'click')::INT) > 0 AND avg((event_type = 'view')::INT) > 0 AS usable FROM events UNION ALL SELECT 'one', avg((event_type = 'click')::INT), avg((event_type = 'none')::INT), avg((event_type = 'click')::INT) > 0 AND avg((event_type = 'none')::INT) > 0 FROM events")
def V03_usable_weather(spark, d):
    """With two flags that are up at times, and with one that never is."""
    flag = lambda kind, name: (F.col("event_type") == kind).cast("double").alias(name)
    e = A.table(spark, d, "events")
    pairs = [checks.usable_weather(e.select(flag("click", "a"), flag(k, "b")), ["a", "b"]).withColumn("flags", F.lit(n)) for n, k in (("both", "view"), ("one", "none"))]
    return pairs[0].unionByName(pairs[1])


@query("SELECT 'duplicate_id' AS problem, l_orderkey::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'shared_time', epoch_us(l_shipdate)::VARCHAR, count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_shipdate HAVING count(DISTINCT l_orderkey) > 1")
def V04_manifest_problems(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", F.unix_micros("l_shipdate").alias("sensed"))
    return checks.manifest_problems(li, "l_orderkey", "sensed")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def V10_reusable_metadata(spark, d):
    c = A.table(spark, d, "customer")
    files = c.select("c_custkey", F.col("c_name").alias("path"), F.col("c_acctbal").alias("size"), F.col("c_nationkey").alias("mtime"))
    known = c.select(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 4 == 0, -1e9).otherwise(F.col("c_acctbal")).alias("size"), F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("mtime"))
    return checks.reusable(files, known).select("c_custkey")


@query("SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey")
def L01_stable_order(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderdate", "o_orderkey").orderBy("o_orderdate", "o_orderkey")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def L06_limit(spark, d):
    return A.table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


SHEETS = """
WITH o AS (SELECT site_id, CASE WHEN time_idx % 97 <> 5 THEN time_idx * 900000000 + CASE WHEN time_idx % 89 = 3 THEN 420000000 ELSE 0 END END AS us, energy FROM pv),
f AS (SELECT site_id, min(us) AS first FROM o GROUP BY site_id),
r AS (SELECT o.*, CASE WHEN us IS NULL THEN 'malformed_timestamp' WHEN (us - first) % 900000000 <> 0 THEN 'off_grid' END AS reason FROM o JOIN f USING (site_id)),
k AS (SELECT * FROM r WHERE reason IS NULL), g AS (SELECT site_id, unnest(range(min(us), max(us) + 1, 900000000)) AS us FROM k GROUP BY site_id),
c AS (SELECT g.site_id, g.us, k.energy FROM g LEFT JOIN k USING (site_id, us)),
n AS (SELECT site_id, count(*) AS rows, count(energy) AS observed FROM c GROUP BY site_id),
x AS (SELECT site_id, count(*) FILTER (reason = 'malformed_timestamp') AS malformed, count(*) FILTER (reason = 'off_grid') AS off_grid FROM r GROUP BY site_id),
"""


def _production_sheets(spark, d):
    """pv as sheets of local time: the first quarter's layout for even slots, the other one for odd ones."""
    first, t = F.col("time_idx") % 2 == 0, F.col("time_idx")
    local = F.timestamp_micros(t * 900_000_000 + F.when(t % 89 == 3, 420_000_000).otherwise(0) + 7_200_000_000)
    value = F.col("energy").cast("string")
    return A.pv(spark, d).select(
        "site_id", F.when(first, "Q1_24").otherwise("Q2_24").alias("source_sheet"), (t - 1_893_400).alias("source_row"),
        F.when(t % 97 == 5, "bad").when(first, F.date_format(local, "yyyy-MM-dd")).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm:ss")).alias("a"),
        F.when(first, F.date_format(local, "HH.mm.ss")).alias("b"), F.lit(None).cast("string").alias("c"), F.when(first, value).alias("d"),
        F.lit(None).cast("string").alias("e"), F.lit(None).cast("string").alias("f"), F.when(~first, value).alias("g"),
    )


@query(SHEETS + "h AS (" + _digest("SELECT site_id, sha256(us || '|' || coalesce(round(energy * 1000000)::BIGINT::VARCHAR, '')) AS h FROM c", "site_id") + ") SELECT n.*, malformed, off_grid, digest, true AS same FROM n JOIN x USING (site_id) JOIN h USING (site_id)", ("pv",))
def M15_production_dataset(spark, d):
    """Sheets to the canonical data set: exclusions and digests go into its manifest, and what is read back has the same digests."""
    sites = A.site(spark, d).select("site_id", "capacity_mw")
    series, excluded = grid.production_dataset(_production_sheets(spark, d), sites, "Europe/Helsinki")
    series = settled(series)  # read by the manifest's parts and the writer
    line = lambda df: df.select("site_id", F.unix_micros("ts").alias("us"), F.coalesce(F.round(F.col("energy_mwh") * 1_000_000).cast("long").cast("string"), F.lit("")).alias("e"))
    count = lambda r: F.count(F.when(F.col("reason") == r, 1))
    n = series.groupBy("site_id").agg(F.count("*").alias("rows"), F.count("energy_mwh").alias("observed"))
    x = excluded.groupBy("site_id").agg(count("malformed_timestamp").alias("malformed"), count("off_grid").alias("off_grid"))
    manifest = n.join(x, "site_id", "left").fillna(0, ["malformed", "off_grid"]).join(catalog.inventory_hash(line(series), ["site_id"], ["us", "e"]), "site_id")
    folder = shared_folder(spark, "production")
    io.write_canonical(series, manifest, folder)
    data, stored = io.read_canonical(spark, folder)
    again = catalog.inventory_hash(line(data), ["site_id"], ["us", "e"]).withColumnRenamed("digest", "again")
    return stored.join(again, "site_id").withColumn("same", F.col("digest") == F.col("again")).drop("again")
