"""Mixing of sources to target weights by the cube method of balanced sampling.

Every document of a source has the same expected number of copies. Its whole
part is taken outright; the fraction is an inclusion probability that the flight
phase moves through the null space of two constraints (the number of documents
and the number of words) until it is 0 or 1 for all but two documents a block.
What is left of the blocks is blocked again, level by level, until one small
landing problem a source remains.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK, binaries, settle, slices, word_bounds

EPS = 1e-9


def count_words(text: bytes | None) -> int:
    """Words, in pieces of bounded size: a word counts where it starts."""
    if not text:
        return 0
    raw, total = np.frombuffer(text, np.uint8), 0
    for at in range(0, len(raw), BLOCK):
        starts, ends = word_bounds(raw[max(at - 1, 0) : at + BLOCK])
        total += len(starts) - bool(at and len(starts) and starts[0] == 0)
    return total


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size)."""

    def run(batches):
        for batch in slices(batches, 2048):
            n = pa.array([count_words(t) for t in binaries(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["id", "source", "size"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, source string, size long")


def numbered(rows: DataFrame, seed: int, chunk: int = 4096) -> DataFrame:
    """rows (id, source, size) with h, a hash that also tells equal rows apart, the same on every run.

    Equal rows are counted and dealt out again by number, `chunk` of them at a
    time, so that no task has all of a row that repeats without end.
    """
    n = settle(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    parts = n.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))))
    if not n.where(F.col("n") > chunk).isEmpty():
        parts = parts.repartition("id", "size", "part")
    first = F.col("part") * chunk
    k = F.explode(F.sequence(first, F.least(first + chunk, F.col("n")) - 1))
    return parts.withColumn("k", k).select("id", "source", "size", F.xxhash64("id", "size", "k", F.lit(seed)).alias("h"))


def by_source(rows: DataFrame, table: DataFrame, max_rows: int, salts: int = 32) -> DataFrame:
    """rows (source, h, ...) with the columns of table (one row a source, nulls included; settled).
    table is broadcast if counted at max_rows or fewer; else each source is dealt over `salts` keys."""
    own = table.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if own.count() <= max_rows:
        return rows.join(F.broadcast(own), same).drop("__source")
    own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(own, same & (F.pmod("h", F.lit(salts)) == F.col("__salt"))).drop("__source", "__salt")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank`, from 0, by code point with null last; no global window."""
    dealt = sources.withColumn("__null", F.col("source").isNull()).repartitionByRange("__null", "source").withColumn("__part", F.spark_partition_id())
    dealt = settle(dealt)
    before, offsets = 0, []
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition
        offsets.append((r["__part"], before))
        before += r["count"]
    if not offsets:
        return sources.withColumn("rank", F.lit(0))
    shifts = dealt.sparkSession.createDataFrame(offsets, "__part int, __before long")
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__null", "source")) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(shifts), "__part").withColumn("rank", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before", "__null")


def targets(totals: DataFrame, weights: list[float], share: float, limit: float) -> DataFrame:
    """totals (source, source_size, ...) with `target`: shares by weight, held at
    limit times the source's size, with the excess shared again until none is above."""
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = settle(ranked(totals).withColumn("__w", cycle).drop("rank"))
    cap = F.col("source_size") * F.lit(float(limit))
    whole = share * float(t.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        held = F.lit(level) * F.col("__w") > cap
        r = t.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("__w"))), F.sum(held.cast("long"))).first()
        new = (whole - (r[0] or 0.0)) / r[1] if r[1] else level
        if new <= level:
            break
        level = new
    return t.withColumn("target", F.least(F.lit(level) * F.col("__w"), cap)).drop("__w")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p to 0 or 1 but for two units at most; keeps sum(p) and sum(p * size)."""
    p = p.astype(float).tolist()
    size = size.tolist()
    draws = iter(rng.random(2 * len(p) + 8))
    live, following = [], 0
    while True:
        while len(live) < 3 and following < len(p):
            if EPS < p[following] < 1 - EPS:
                live.append(following)
            following += 1
        if len(live) < 2 or len(live) == 2 and size[live[0]] != size[live[1]]:
            break
        if len(live) == 3:
            a, b, c = (size[i] for i in live)
            u = [c - b, a - c, b - a]
            if not any(u):
                u = [1, -1, 0]
        else:
            u = [1, -1]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(live, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(live, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(live, u):
            p[i] += step * x
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
        live = [i for i in live if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Ends the few open units by the choice that is nearest in words, then in documents."""
    open_at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    best, choice = None, np.zeros(len(open_at))
    for code in range(1 << len(open_at)):
        pick = np.array([(code >> b) & 1 for b in range(len(open_at))], float)
        miss = (abs(float(((pick - p[open_at]) * size[open_at]).sum())), abs(float((pick - p[open_at]).sum())))
        if best is None or miss < best:
            best, choice = miss, pick
    out = p.copy()
    out[open_at] = choice
    return np.round(out)


def _balance(seed: int, level: int, last: bool):
    """What a block of one source goes through."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id", "size"], kind="stable")
        name = pdf["source"].iloc[0]
        key = zlib.crc32(name.encode()) if isinstance(name, str) else 1 << 33
        rng = np.random.default_rng([seed, level, key, int(pdf["__block"].iloc[0])])
        size, p = pdf["size"].to_numpy(), pdf["p"].to_numpy()
        p = flight(size, p, rng)
        return pdf.assign(p=land(size, p) if last else p).drop(columns="__block")

    return run


def cube(rows: DataFrame, block: int, seed: int, max_rows: int) -> DataFrame:
    """rows (id, source, size, h, p, ...) with p moved to 0 or 1, balanced within each source."""
    done, level = [], 0
    while True:
        counts = rows.groupBy("source").agg(F.count("*").alias("__n"))
        counts = settle(counts.select("source", F.ceil(F.col("__n") / block).alias("__blocks")))
        last = (counts.agg(F.max("__blocks")).first()[0] or 1) <= 1
        blocked = by_source(rows, counts, max_rows)
        blocked = blocked.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed + level), "h"), F.col("__blocks"))).drop("__blocks")
        moved = settle(blocked.groupBy("source", "__block").applyInPandas(_balance(seed, level, last), rows.schema))
        if last:
            done.append(moved)
            break
        still = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        done.append(moved.where(~still))
        rows, level = moved.where(still), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    block: int = 4096,
    seed: int = 7,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row of docs.

    size is the text's number of words (0 for null, empty and blank texts). The
    sources, by code point with null last, have `weights` in turn and share
    `share` times all sizes; a target stops at `limit` times its source's size
    and the excess goes to the others. taken is size times the copies that the
    mix takes: the whole part of target / source_size, and one more for the
    documents that the cube method selects. No document is taken more than
    ceil(limit) times. Rows that repeat are documents of their own, null ids too;
    the result is the same on every run and for every partitioning. Texts of any
    length count as a whole. A source of no words has the target 0 and nothing is
    taken of it. An empty table gives no rows; other columns are not read.
    """
    s = settle(numbered(sizes(docs, id_col, text_col, source_col), seed))
    totals = targets(s.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, limit)
    totals = settle(totals.select("source", "source_size", "target"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = by_source(s, totals, max_sources)
    rows = rows.withColumn("copies", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("copies"), F.lit(0.0)))
    rows = settle(rows)
    sure = F.col("p") <= EPS
    picked = rows.where(sure).withColumn("p", F.lit(0.0)).unionByName(cube(rows.where(~sure), block, seed, max_sources))
    taken = (F.col("size") * (F.col("copies") + F.col("p").cast("long"))).cast("long")
    return picked.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))
