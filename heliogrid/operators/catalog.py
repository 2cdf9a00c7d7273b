"""Product manifests, event logs, coverage and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("processed", "unavailable_source")


def replay(manifest: DataFrame, events: DataFrame, key: str, order: str, fields: list[str], defaults: dict) -> DataFrame:
    """manifest with each product's latest event's fields, else its defaults. Events of unknown products are ignored."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("r"), F.count("*").alias("events"))
    out = manifest.join(last, key, "left")
    return out.select(*manifest.columns, *[F.coalesce(F.col(f"r.{f}"), F.lit(defaults.get(f))).alias(f) for f in fields], F.coalesce("events", F.lit(0)).alias("events"))


def lifecycle(outcomes: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """(key, status, attempts) after outcomes `ok`, `empty` or `error` in order.

    ok ends as processed; empty ends as unavailable_source if there was an attempt
    before, else it failed and is tried again; error failed. Nothing follows an end.
    """
    w = Window.partitionBy(key).orderBy(order)
    o = outcomes.where(F.col(outcome).isin("ok", "empty", "error")).withColumn("__n", F.row_number().over(w))
    ends = (F.col(outcome) == "ok") | ((F.col(outcome) == "empty") & (F.col("__n") > 1))
    o = o.withColumn("__end", ends).withColumn("__ended", F.max(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    status = F.when(F.col(outcome) == "ok", "processed").when(F.col("__end"), "unavailable_source").otherwise("failed")
    live = o.where(F.coalesce("__ended", F.lit(0)) == 0).withColumn("__status", status)
    return live.groupBy(key).agg(F.max_by("__status", "__n").alias("status"), F.max("__n").cast("long").alias("attempts"))


def compact(parts: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order, from appended parts."""
    names = [c for c in parts.columns if c != key]
    return parts.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def purge(features: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return features.join(ids.select(key).distinct(), key, "left_anti")


def coverage_report(observed: DataFrame, expected: DataFrame, key: str, slot: str) -> DataFrame:
    """One row: expected and observed slots, those missing, keys and slots that repeat. One aggregate over slots, one over keys."""
    e, o = expected.select(slot).distinct().withColumn("__e", F.lit(1)), observed.groupBy(slot).agg(F.count("*").alias("__n"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    wanted, seen = F.col("__e").isNotNull(), F.col("__n").isNotNull()
    slots = e.join(o, slot, "full_outer").agg(n(wanted, "expected"), n(wanted & seen, "observed"), n(wanted & ~seen, "missing"), n(F.col("__n") > 1, "repeated_slots"))
    keys = observed.groupBy(key).agg(F.count("*").alias("__n")).agg(n(F.col("__n") > 1, "repeated_ids"))
    return slots.crossJoin(F.broadcast(keys)).select("expected", "observed", "missing", "repeated_ids", "repeated_slots")


def chunks(ranges: DataFrame, by: list[str], step: int) -> DataFrame:
    """(by, lo, hi): [lo, hi) of each range in pieces of step, the last one shorter."""
    r = ranges.where("lo < hi").withColumn("__lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(step).cast("long"))))
    return r.select(*by, F.col("__lo").alias("lo"), F.least(F.col("__lo") + step, F.col("hi")).alias("hi"))


def discovery_stats(chunk_table: DataFrame, merged: DataFrame, products: DataFrame, by: str, slots_per_unit: int, slot: str) -> DataFrame:
    """(by, chunks, covered, remaining, missing_slots): covered chunks, and slots within them that no product is nearest to."""
    from .joins import covered

    inside = covered(chunk_table, merged, by)
    totals = chunk_table.groupBy(by).agg(F.count("*").alias("chunks"))
    done = inside.groupBy(by).agg(F.count("*").alias("covered"))
    slots = inside.select(by, F.explode(F.sequence(F.col("lo") * slots_per_unit, F.col("hi") * slots_per_unit - 1)).alias(slot))
    missing = slots.join(products.select(by, slot).distinct(), [by, slot], "left_anti").groupBy(by).agg(F.count("*").alias("missing_slots"))
    out = totals.join(done, by, "left").join(missing, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(by, "chunks", zero("covered"), (F.col("chunks") - F.coalesce("covered", F.lit(0))).alias("remaining"), zero("missing_slots"))


def status_counts(records: DataFrame, by: list[str], status: str, known: list[str]) -> DataFrame:
    """Rows of each status as a column, by group and overall."""
    return records.rollup(*by).agg(F.count("*").alias("total"), *[F.sum((F.col(status) == s).cast("long")).alias(s) for s in known])


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the key-sorted JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def inventory_hash(files: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, digest) over one line for each file, whatever their order.

    Lines are hashed, dealt over 4096 buckets by the first three digits of their digest, and each bucket's
    sorted digests are hashed; the group's digest is that of its buckets' in order. A list thus holds a
    4096th of a group, or 4096 digests.
    """
    line = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
    rows = files.select(*by, line.alias("__line")).withColumn("__bucket", F.substring("__line", 1, 3))
    buckets = rows.groupBy(*by, "__bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("__digest"))
    listed = F.array_sort(F.collect_list(F.struct("__bucket", "__digest")))
    return buckets.groupBy(*by).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["__digest"]), "\n"), 256).alias("digest"))


def content_hash(files: DataFrame) -> DataFrame:
    """(path, sha256, length) of a binaryFile table."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").cast("long").alias("length"))


def verify_backup(expected: DataFrame, copied: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): ok, mismatch, missing (not copied) or unexpected."""
    e, c = expected.select(key, F.col(digest).alias("__e")), copied.select(key, F.col(digest).alias("__c"))
    state = F.when(F.col("__c").isNull(), "missing").when(F.col("__e").isNull(), "unexpected").when(F.col("__e") == F.col("__c"), "ok").otherwise("mismatch")
    return e.join(c, key, "full_outer").select(key, state.alias("state"))


def deletable(products: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Processed products, not deleted yet, whose backup is verified. Nothing is deleted here."""
    good = verified.where("state = 'ok'").select(key)
    return products.where("status = 'processed' AND NOT deleted").join(good, key, "left_semi")
