"""Streaming queries: each reads a table as a file stream, runs over what there is and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import SLOT_MICROS
from ..session import shared_folder
from ..sources import io
from ..streaming import landing, streams
from . import adapters as A
from .registry import query


def _events(spark, d):
    # a glob, as the table may be a single file, which a file stream takes only so
    return streams.events(spark, f"{d}/events.parque[t]", spark.read.parquet(f"{d}/events.parquet").schema)


def _run(stream, name, mode="append"):
    spark = stream.sparkSession
    return streams.run_available(stream, shared_folder(spark, name), shared_folder(spark, f"{name}-state"), mode)


@query("SELECT event_id, user_id, event_type FROM events")
def T01_ingest_once(spark, d):
    e = streams.ingest_once(_events(spark, d), "event_id", "at")
    return _run(e.select("event_id", "user_id", "event_type"), "ingest")


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'click' THEN 'first' ELSE 'second' END AS run FROM events")
def T01_ingest_across_restarts(spark, d):
    """A run over some events, and one from the start over all of them that knows nothing of the first's checkpoint."""
    folder = shared_folder(spark, "landed")
    write = landing.land_once(folder, "event_id")
    for run, some in (("first", "event_type = 'click'"), ("second", "true")):
        rows = _events(spark, d).where(some).select("event_id", "user_id", "event_type")
        q = rows.writeStream.foreachBatch(lambda b, n, run=run: write(b, n, run)).option("checkpointLocation", shared_folder(spark, f"landed-{run}")).trigger(availableNow=True).start()
        q.awaitTermination()
    return landing.landed(spark, folder).select("event_id", "user_id", "event_type", F.split("batch", "-")[0].alias("run"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def T02_upsert_state(spark, d):
    folder = shared_folder(spark, "upsert")
    rows = _events(spark, d).select("user_id", "event_id", "event_type")
    q = rows.writeStream.foreachBatch(landing.upsert_to(folder, "user_id", "event_id")).option("checkpointLocation", shared_folder(spark, "upsert-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return landing.snapshot(spark, folder, "user_id", "event_id")


@query("""
WITH o AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'empty' ELSE 'error' END AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), e AS (SELECT user_id, min(n) FILTER (r = 'ok' OR (r = 'empty' AND n > 1)) AS done, max(n) AS n FROM o GROUP BY user_id)
SELECT e.user_id, CASE WHEN done IS NULL THEN 'failed' WHEN o.r = 'ok' THEN 'processed' ELSE 'unavailable_source' END AS status, coalesce(done, e.n) AS attempts FROM e LEFT JOIN o ON o.user_id = e.user_id AND o.n = e.done
""")
def T03_lifecycle_stream(spark, d):
    outcome = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "empty").otherwise("error")
    s = streams.lifecycle(_events(spark, d).withColumn("outcome", outcome), "user_id", "event_id", "outcome")
    out = _run(s, "lifecycle", "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("status", "attempts"), "attempts").alias("r")).select("user_id", "r.*")


@query("SELECT event_type AS site_id, epoch_us(ts) // 900000000 AS time_idx, round(sum(value), 6) AS energy, count(*) AS n FROM events GROUP BY ALL")
def T04_tumbling_sums(spark, d):
    s = streams.tumbling_sums(_events(spark, d).select("at", F.col("event_type").alias("site_id"), "value"), "at", "site_id", "value")
    flat = s.select("site_id", (F.unix_micros("window.start") / SLOT_MICROS).cast("long").alias("time_idx"), "energy", "n")
    out = _run(flat, "tumbling", "update")
    return out.groupBy("site_id", "time_idx").agg(F.max_by(F.struct("energy", "n"), "__batch").alias("r")).select("site_id", "time_idx", F.round("r.energy", 6).alias("energy"), "r.n")


@query("""
WITH s AS (SELECT event_id AS slot_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS product_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT slot_id, max(product_id) FILTER (p.t = top) AS product_id FROM (SELECT s.slot_id, p.product_id, p.t, max(p.t) OVER (PARTITION BY s.slot_id) AS top FROM s JOIN p ON p.user_id = s.user_id AND p.t <= s.t AND p.t >= s.t - 21600000000) p GROUP BY slot_id
""")
def T05_causal_alignment(spark, d):
    e = _events(spark, d)
    slots = e.where("event_type = 'view'").select(F.col("event_id").alias("slot_id"), "user_id", F.col("at").alias("slot_at"))
    products = _events(spark, d).where("event_type = 'click'").select(F.col("event_id").alias("product_id"), "user_id", F.col("at").alias("sensed_at"))
    near = streams.causal_candidates(slots, products, "user_id", "slot_at", "sensed_at", "6 hours")
    out = _run(near.select("slot_id", "product_id", "sensed_at"), "causal")
    return out.groupBy("slot_id").agg(F.max(F.struct("sensed_at", "product_id")).alias("r")).select("slot_id", "r.product_id")


@query("SELECT e.event_id, n.issue, n.value FROM events e JOIN nwp n ON n.variable = e.event_type AND n.step = 0 AND epoch_us(e.ts) // 3600000000 BETWEEN n.issue + 6 AND n.issue + 12", ("nwp",))
def T06_live_availability(spark, d):
    runs = A.nwp(spark, d).where("step = 0").select(F.col("variable").alias("event_type"), "issue", "value")
    e = _events(spark, d).select("event_id", "event_type", F.floor(F.unix_micros("at") / 3_600_000_000).cast("long").alias("target"))
    return _run(streams.available_runs(e, runs, "event_type", "target", 6, 12).select("event_id", "issue", "value"), "availability")


def _decode(path: str, content: bytes):
    import pandas as pd

    return pd.DataFrame({"doc_id": [int(path)], "bytes": [len(content)], "lines": [content.count(b"\n") + 1]})


@query("SELECT doc_id, octet_length(encode(text)) AS bytes, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines FROM documents")
def X01_decode_products(spark, d):
    files = A.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return io.decode_products(files, _decode, "doc_id long, bytes long, lines long")


def _transport(request: dict) -> dict:
    return {"site_id": request["site_id"], "run_hour": request["run_hour"], "status": 200 if request["run_hour"] % 12 == 0 else 404}


@query("WITH r AS (SELECT DISTINCT user_id AS site_id, epoch_us(ts) // 3600000000 // 6 * 6 AS run_hour FROM events) SELECT *, CASE WHEN run_hour % 12 = 0 THEN 200 ELSE 404 END::BIGINT AS status FROM r")
def X02_fetch(spark, d):
    run = (F.floor(F.floor(F.unix_micros("ts") / 3_600_000_000) / 6) * 6).cast("long")
    r = A.table(spark, d, "events").select(F.col("user_id").alias("site_id"), run.alias("run_hour")).distinct()
    return io.fetch(r, _transport, "site_id long, run_hour long, status long")
