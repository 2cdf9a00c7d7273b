"""Landing rows once over batches, restarts and new checkpoints, and keeping the latest row of each key.

Both keep what earlier batches wrote in tiers of segments (sources.files.Tiers),
so neither reads all of them for a new batch.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import compact
from ..session import settled
from ..sources import files

#: Bits of a Bloom filter for each key, and hashes set for it: 3 of 1000 other keys pass.
BITS_PER_KEY, HASHES = 12, 8
#: Rows of a batch's keys up to which they are broadcast.
MAX_BROADCAST = 1_000_000


def _bits(h: np.ndarray, n: int) -> np.ndarray:
    """The places of hashes in a filter for n keys: a matrix with HASHES columns."""
    h = h.view(np.uint64)
    with np.errstate(over="ignore"):
        step = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
        return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(_size(n) * 8)


def _size(n: int) -> int:
    return max(8, -(-n * BITS_PER_KEY // 8))


def bloom(h: np.ndarray) -> bytes:
    """A Bloom filter of 64-bit hashes."""
    out = np.zeros(_size(len(h)) * 8, np.uint8)
    out[_bits(h, len(h)).ravel()] = 1
    return np.packbits(out, bitorder="little").tobytes()


def passes(content: bytes, n: int, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter of n keys may hold."""
    at = _bits(h, n)
    raw = np.frombuffer(content, np.uint8)
    return ((raw[at // np.uint64(8)] >> (at % np.uint64(8)).astype(np.uint8)) & 1).all(axis=1)


class KeyIndex:
    """The keys that have landed: segments of key files of at most about keys_per_file keys each.

    A segment deals its keys over `parts` by hash; each part is a file sorted by
    key, with a row in the segment's index: number of keys, least and greatest
    key, and a Bloom filter. A lookup reads the bounds first, then the filters of
    parts that they leave, and the key files only of parts that the filters leave.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, keys_per_file: int = 1_000_000, fanout: int = 8):
        self.spark, self.key, self.keys_per_file = spark, key, keys_per_file
        self.tiers = files.Tiers(spark, path, fanout)

    def _write(self, keys: DataFrame, folder: str) -> dict:
        """keys (key, h) as a segment; returns its facts."""
        key, n = self.key, keys.count()
        parts = max(1, -(-n // self.keys_per_file))
        dealt = keys.select(key, "h").withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
        dealt.repartition(parts, "part").sortWithinPartitions("part", key).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/keys")

        def summary(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [len(pdf)], "lo": [pdf[key].min()], "hi": [pdf[key].max()], "bloom": [bloom(pdf["h"].to_numpy(np.int64))]})

        kind = keys.schema[key].dataType.simpleString()
        written = self.spark.read.schema(dealt.schema).parquet(f"{folder}/keys") if n else dealt
        # a part has about keys_per_file hashes, whatever the keys
        written.groupBy("part").applyInPandas(summary, f"part int, n long, lo {kind}, hi {kind}, bloom binary").write.mode("overwrite").parquet(f"{folder}/index")
        return {"parts": parts, "keys": n}

    def _keys(self, names: list[str], schema) -> DataFrame:
        read = [self.spark.read.schema(schema).parquet(f"{self.tiers.folder(x)}/keys") for x in names]
        return reduce(DataFrame.unionByName, read)

    def add(self, keys: DataFrame, batch: str, **facts) -> None:
        """Lists the keys (key, h) of a batch; those of an earlier run of the batch are replaced."""
        self.tiers.add(batch, lambda folder: {**self._write(keys, folder), **facts})

    def merge(self, but: str, schema) -> list[str]:
        """Merges full levels of segments; that of the batch under way stays alone, so that it can be replaced."""
        return self.tiers.merge(lambda names, folder: self._write(self._keys(names, schema), folder), but)

    def parts_for(self, keys: DataFrame, but: str | None = None) -> list[tuple[str, int]]:
        """(segment, part) of the key files that may hold one of keys (key, h), those of batch `but` left out."""
        live = [x for x in self.tiers.live() if x["keys"] and (but is None or x.get("batch") != but)]
        if not live:
            return []
        index = [self.spark.read.parquet(f"{self.tiers.folder(x['name'])}/index").select(F.lit(x["name"]).alias("segment"), F.lit(x["parts"]).alias("parts"), "*") for x in live]
        index = reduce(DataFrame.unionByName, index)
        segments = F.array(*[F.struct(F.lit(x["name"]).alias("segment"), F.lit(x["parts"]).alias("of")) for x in live])
        asked = keys.withColumn("s", F.explode(segments)).select(F.col(self.key).alias("__key"), "h", "s.segment", F.pmod("h", F.col("s.of")).cast("int").alias("part"))
        bounds = index.select("segment", "part", "lo", "hi")  # without filters; a row for each key file
        near = asked.join(bounds, ["segment", "part"]).where("__key >= lo AND __key <= hi").select("segment", "part", "h")
        near = settled(near)
        n = near.count()
        if not n:
            return []
        touched = near.select("segment", "part").distinct()
        salts = -(-n // self.keys_per_file)  # so that no task tests many more keys than a file has

        def test(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            hit = len(left) and len(right) and passes(right["bloom"].iloc[0], int(right["n"].iloc[0]), left["h"].to_numpy(np.int64)).any()
            return left[["segment", "part"]].iloc[:1] if hit else pd.DataFrame({"segment": pd.Series([], dtype=str), "part": pd.Series([], dtype="int32")})

        some = index.join(F.broadcast(touched) if touched.count() <= MAX_BROADCAST else touched, ["segment", "part"], "left_semi").select("segment", "part", "n", "bloom")
        some, near = some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), near.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)).cast("int"))
        found = near.groupBy("segment", "part", "salt").cogroup(some.groupBy("segment", "part", "salt")).applyInPandas(test, "segment string, part int")
        return sorted((r.segment, r.part) for r in found.distinct().collect())  # key files, of keys_per_file keys each

    def unknown(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """keys (key, h, ...) that no segment has."""
        parts = self.parts_for(keys.select(self.key, "h"), but)
        if not parts:
            return keys
        paths = [f"{self.tiers.folder(s)}/keys/part={p}" for s, p in parts]
        known = self.spark.read.schema(keys.select(self.key, "h").schema).parquet(*paths).select(self.key)
        return keys.join(known, self.key, "left_anti")


def land_once(path: str, key: str, keys_per_file: int = 1_000_000, fanout: int = 8):
    """For foreachBatch: lands rows of keys that no other batch has landed, whatever the time between, also under
    a new checkpoint; `landed` reads them. A batch that runs again replaces what it wrote.

    Of rows of one key in a batch one lands; rows without a key don't. What is read of earlier batches is their
    keys' bounds and Bloom filters, and the key files that these leave (KeyIndex). Rows are written aside, their
    keys are listed together with that place, and the rows are then moved: a run that breaks off before the list
    is switched has landed nothing, one that breaks off after it is completed by the next reader or writer.
    One writer at a time.
    """

    def write(batch: DataFrame, number: int, run: str = "0") -> None:
        spark, name, aside = batch.sparkSession, f"{run}-{number}", uuid.uuid4().hex
        index = KeyIndex(spark, f"{path}/index", key, keys_per_file, fanout)
        _complete(spark, path)
        fresh = settled(batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("h", F.xxhash64(key)))
        index.merge(name, fresh.select(key, "h").schema)
        fresh = settled(index.unknown(fresh, but=name))
        fresh.drop("h").write.parquet(f"{path}/aside/{aside}")
        index.add(fresh.select(key, "h"), name, aside=aside)
        _complete(spark, path)

    return write


def _complete(spark: SparkSession, path: str) -> None:
    """Moves the rows of batches whose keys are listed into place, if a run broke off before that."""
    waiting = files.names(spark, f"{path}/aside")
    for x in files.Tiers(spark, f"{path}/index").live() if waiting else []:
        if x.get("aside") in waiting:
            files.move(spark, f"{path}/aside/{x['aside']}", f"{path}/rows/batch={x['batch']}")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """What has landed, with `batch`, the run and number of the batch that brought it."""
    _complete(spark, path)
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def upsert_to(path: str, key: str, order: str, fanout: int = 8):
    """For foreachBatch: keeps the latest row of each key; read by `snapshot`. A batch is a segment of its own, named
    by run and number, so that one that runs again replaces itself; full levels of segments are merged to one."""

    def write(batch: DataFrame, number: int, run: str = "0") -> None:
        spark = batch.sparkSession
        tiers = files.Tiers(spark, path, fanout)

        def put(rows: DataFrame, folder: str) -> dict:
            compact(rows, key, order).write.parquet(folder)
            return {}

        tiers.add(f"{run}-{number}", lambda folder: put(batch, folder))
        tiers.merge(lambda names, folder: put(spark.read.parquet(*[tiers.folder(x) for x in names]), folder))

    return write


def snapshot(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """The latest row of each key, from the live segments: at most `fanout` a level, not one a batch."""
    tiers = files.Tiers(spark, path)
    return compact(spark.read.parquet(*[tiers.folder(x["name"]) for x in tiers.live()]), key, order)
