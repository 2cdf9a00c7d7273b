"""What several operators of this subpackage share.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. All of those bytes are below 0x80, so working on UTF-8 bytes gives
the same words as working on characters.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of a text that are hashed at once; it bounds the memory of a long text.
BLOCK = 1 << 18


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = splitmix(11, 256)[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK + 1024)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _blocks(raw: np.ndarray, gap: np.ndarray):
    """Cuts between words, so that no word is divided."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            gaps = np.flatnonzero(gap[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(raw) and not gap[raw[end]]:
                    end += 1
        yield at, raw[at:end]
        at = end


def word_bounds(raw: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of a byte array."""
    space = np.ones(len(raw) + 2, bool)
    gap.take(raw, out=space[1:-1])
    cut = np.flatnonzero(space[1:] != space[:-1])
    return cut[::2], cut[1::2]


def word_hashes(text: bytes | None, bounds: bool = False, gap: np.ndarray = _SPACE):
    """A 64-bit hash of each word in order; with bounds also the byte offsets.

    gap: by byte, whether it stands between words.
    """
    if not text:
        empty = np.zeros(0, U64)
        return (empty, np.zeros(0, np.int64), np.zeros(0, np.int64)) if bounds else empty
    raw = np.frombuffer(text, np.uint8)
    out, starts, ends = [], [], []
    with np.errstate(over="ignore"):
        for at, part in _blocks(raw, gap):
            s, e = word_bounds(part, gap)
            if not len(s):
                continue
            power, inverse = _powers(len(part))
            total = np.zeros(len(part) + 1, U64)
            value = _BYTE_VALUE.take(part)
            value *= power
            np.cumsum(value, out=total[1:])
            out.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64)))
            if bounds:
                starts.append(s + at)
                ends.append(e + at)
    joined = np.concatenate(out) if out else np.zeros(0, U64)
    if not bounds:
        return joined
    none = np.zeros(0, np.int64)
    return joined, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


_PLACE = splitmix(23, 64) | U64(1)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words (at most 64), in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.full(n, U64(k))
        for j in range(k):
            total += words[j : j + n] * _PLACE[j]
        return mix(total)


def stretches(words: np.ndarray, k: int) -> np.ndarray:
    """Like grams for runs of any length k, at a cost that doesn't grow with k: a rolling hash."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        power, inverse = _powers(len(words))
        total = np.zeros(len(words) + 1, U64)
        np.cumsum(words * power, out=total[1:])
        return mix((total[k:] - total[:n]) * inverse[:n] + U64(k))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted set of k-word shingles; fewer words make one shingle."""
    if 0 < len(words) < k:
        return grams(words, len(words))
    return np.unique(grams(words, k))


def binaries(column: pa.Array) -> list:
    """The UTF-8 bytes (or None) of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches, rows: int = 512):
    """Arrow batches of few rows, which bounds what is held in Python at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ensure_checkpoint(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is set, a local one in local mode and an error elsewhere."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        where = sc.getCheckpointDir()
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for large ones of few columns that are read more than once."""
    path = f"{ensure_checkpoint(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def restrict(df: DataFrame, keys: DataFrame, on: list[str], max_rows: int = 1_000_000) -> DataFrame:
    """The rows of df whose `on` is among keys (distinct, settled).

    keys are broadcast if counted at max_rows or fewer, else both are shuffled.
    """
    small = keys.count() <= max_rows
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def with_texts(pairs: DataFrame, texts: DataFrame, per_task: int = 512, max_rows: int = 1_000_000) -> DataFrame:
    """(a, b, ta, tb): pairs (a, b) of ids with both texts, from texts (id, text); the greatest
    text, if an id repeats.

    Only texts of ids in pairs are shuffled. An id that is a in many pairs (the
    head of a star) is dealt over a key for each per_task of them, with a copy of
    its text for each, so that no task gets all of its pairs; b is in few pairs.
    """
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    texts = restrict(texts, ids, ["id"], max_rows).groupBy("id").agg(F.max("text").alias("text"))
    hubs = settle(pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("deal")).where("deal > 1"))
    hubs = F.broadcast(hubs) if hubs.count() <= max_rows else hubs
    one = F.coalesce("deal", F.lit(1))
    dealt = pairs.join(hubs, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), one)).drop("deal")
    heads = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(hubs, "a", "left")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), one - 1))).drop("deal")
    joined = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(heads, ["a", "salt"])
    return joined.select("a", "b", "ta", "tb")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each connected component.

    edges: (a, b) longs. Alternates the large-star and small-star steps, each a
    grouped minimum joined back to the edges, until nothing changes; the number
    of rounds grows with the logarithm of the longest path. Nulls and loops are
    left out. Only nodes of some edge are returned.
    """

    def hooked(e: DataFrame, larger_only: bool) -> DataFrame:
        both = e if larger_only else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = both.join(least, "a")
        if larger_only:
            out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        else:
            out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a != b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = settle(e)
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = settle(hooked(hooked(e, False), True))
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
