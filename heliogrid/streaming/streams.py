"""Structured Streaming forms of ingestion, state, tumbling sums and live alignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """A file source over Parquet; each file is read once, also across restarts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def events(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """source with `at`, the wall-clock ts as an instant, by which watermarks go."""
    return source(spark, path, schema, max_files).withColumn("at", F.col("ts").cast("timestamp"))


def ingest_once(stream: DataFrame, key: str, at: str, delay: str = "2 days") -> DataFrame:
    """Each key once; state is kept for as long as late copies may come."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling_sums(stream: DataFrame, at: str, by: str, value: str, delay: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """(by, window, energy, n); rows later than the watermark allows are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.sum(value).alias("energy"), F.count("*").alias("n"))


def available_runs(frame: DataFrame, runs: DataFrame, key: str, target: str, delay: int, horizon: int) -> DataFrame:
    """Stream rows with each static run that is out by their target: issue + delay <= target <= issue + horizon."""
    return frame.join(runs, key).where((F.col(target) >= F.col("issue") + delay) & (F.col(target) <= F.col("issue") + horizon))


def causal_candidates(slots: DataFrame, products: DataFrame, by: str, slot_at: str, sensing: str, tolerance: str, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of slots with the products sensed at or before them, within tolerance; the latest is chosen afterwards."""
    s = slots.withWatermark(slot_at, delay).alias("s")
    p = products.withWatermark(sensing, delay).alias("p")
    near = (F.col(f"p.{sensing}") <= F.col(f"s.{slot_at}")) & (F.col(f"p.{sensing}") >= F.col(f"s.{slot_at}") - F.expr(f"INTERVAL {tolerance}"))
    return s.join(p, (F.col(f"s.{by}") == F.col(f"p.{by}")) & near)


def lifecycle(stream: DataFrame, key: str, order: str, outcome: str, at: str = "at", delay: str = "30 days", retention: str = "90 days", idle: str = "365 days") -> DataFrame:
    """(key, status, attempts) whenever a product's state changes: the batch operator of this name, with the state kept by Spark.

    Outcomes may come `delay` late by their time `at`. A product that has ended is forgotten once the watermark is
    `retention` past its last outcome, any other `idle` past it, so the state is bounded by what happens in these
    times. Until then nothing reopens a product that has ended; a forgotten one begins anew.
    """
    done = ("processed", "unavailable_source")
    kept, waits = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (retention, idle))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, attempts = before = tuple(state.get) if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for result in rows[outcome]:
            if status in done:
                break
            attempts += 1
            status = "processed" if result == "ok" else "unavailable_source" if result == "empty" and attempts > 1 else "failed"
        last = max(int(rows["__ms"].max()), state.getCurrentWatermarkMs())
        state.update((status, attempts))
        state.setTimeoutTimestamp(last + 1 + (kept if status in done else waits))
        if (status, attempts) != before:
            yield pd.DataFrame({key: [k[0]], "status": [status], "attempts": [attempts]})

    known = stream.withWatermark(at, delay).where(F.col(outcome).isin("ok", "empty", "error")).select(key, order, outcome, at, F.unix_millis(at).alias("__ms"))
    return known.groupBy(key).applyInPandasWithState(step, f"{key} long, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a query over what there is, to Parquet, and reads the result."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda b, n: b.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/micro_batch={n}")).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.parquet(path)
