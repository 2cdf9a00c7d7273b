"""Benchmark decontamination by greedy string tiling.

Tiles are the longest runs of words that text and item share, marked greedily
and without overlap, so that a passage whose parts were reordered is still
covered. Runs are grown from shared k-word seeds, found by rolling hashes; an
item of fewer words is a seed as a whole.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, binaries, grams, settle, slices, word_hashes


def common_runs(i: np.ndarray, j: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the maximal runs made of seeds at (i, j)."""
    if not len(i):
        return []
    place = (j - i) * (i.max() + np.int64(2)) + i  # by diagonal, then by i; consecutive along a run only
    order = np.argsort(place)
    i, j, place = i[order], j[order], place[order]
    cut = np.flatnonzero(place[1:] - place[:-1] != 1) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(i)]]) - 1
    return list(zip(i[first].tolist(), j[first].tolist(), (i[last] - i[first] + k).tolist()))


def tile(runs: list[tuple[int, int, int]], n_item: int, n_text: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of at least k words: the longest first, then by place in item and text."""
    item, text = np.zeros(n_item + 1, bool), np.zeros(n_text + 1, bool)
    heap = [(-n, i, j) for i, j, n in runs]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        marked = item[i : i + n] | text[j : j + n]
        if not marked.any():
            item[i : i + n] = text[j : j + n] = True
            tiles.append((i, j, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for s, e in zip(free[::2].tolist(), free[1::2].tolist()):
            if e - s >= k:
                heapq.heappush(heap, (s - e, i + s, j + s))
    return tiles


def runs_of_places(places: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the maximal runs, from (place in item, its sorted
    places in the text) by place in item.

    Each place continues the runs of the one before it on the same diagonals, so
    only open runs are held, not every pair of places: a text of one word over and
    over has as many runs as diagonals.
    """
    out, last, diagonals, starts = [], -2, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def close(d, s, end):
        out.extend(zip(s.tolist(), (s + d).tolist(), (end - s + k).tolist()))

    for i, at in places:
        now = at.astype(np.int64) - i
        fresh = np.full(len(now), i, np.int64)
        if i == last + 1 and len(diagonals):
            where = np.searchsorted(diagonals, now)
            where[where == len(diagonals)] = 0
            goes_on = diagonals[where] == now
            fresh[goes_on] = starts[where[goes_on]]
            ended = np.ones(len(diagonals), bool)
            ended[where[goes_on]] = False
            close(diagonals[ended], starts[ended], last)
        else:
            close(diagonals, starts, last)
        last, diagonals, starts = i, now, fresh
    close(diagonals, starts, last)
    return out


class Items:
    """The items of a benchmark that is broadcast: their words and a sorted table of their seeds."""

    def __init__(self, rows: list[tuple[object, bytes | None]], k: int):
        self.k, self.ids, self.words = k, [], []
        self.short = np.zeros(k, bool)  # lengths of items with fewer than k words
        keys, owner, place = [], [], []
        for item_id, text in rows:
            words = word_hashes(text)
            if not len(words):
                continue
            seeds = grams(words, min(k, len(words)))
            if len(words) < k:
                self.short[len(words)] = True
            keys.append(seeds)
            owner.append(np.full(len(seeds), len(self.ids)))
            place.append(np.arange(len(seeds)))
            self.ids.append(item_id)
            self.words.append(len(words))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, int)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True

    def _met(self, words: np.ndarray, n: int):
        """(item, place in item, its places in the text) for shared seeds of n words."""
        seeds = grams(words, n)
        at = np.flatnonzero(self.maybe[(seeds >> U64(44)).astype(np.int64)])
        found, low = np.unique(seeds[at], return_inverse=True)
        if not len(found):
            return
        order = np.argsort(low, kind="stable")
        at, ends = at[order], np.concatenate([[0], np.cumsum(np.bincount(low))])
        first, last = (np.searchsorted(self.keys, found, side) for side in ("left", "right"))
        for f in np.flatnonzero(last > first).tolist():
            for x in range(first[f], last[f]):
                yield int(self.owner[x]), int(self.place[x]), at[ends[f] : ends[f + 1]]

    def tiles(self, words: np.ndarray):
        """(item, its tiles) for the items that share a seed with the text."""
        by: dict[int, list] = {}
        for item, i, at in self._met(words, self.k):
            by.setdefault(item, []).append((i, at))
        for item in sorted(by):
            runs = runs_of_places(sorted(by[item], key=lambda p: p[0]), self.k)
            yield item, tile(runs, self.words[item], len(words), self.k)
        for n in np.flatnonzero(self.short).tolist():
            for item, _, at in self._met(words, n):
                if self.words[item] == n:
                    yield item, [(0, int(at[0]), n)]

    def covered(self, text: bytes | None, min_coverage: float):
        """(item id, coverage, tiles, longest tile, first word of it) of the items that the text holds."""
        for item, tiles in self.tiles(word_hashes(text)):
            coverage = sum(n for _, _, n in tiles) / self.words[item]
            if coverage >= min_coverage:
                yield self.ids[item], coverage, len(tiles), max(n for _, _, n in tiles), tiles[0][1]


class SeedFilter:
    """Which seeds some item may have: a Bloom filter of a fixed size, put together by Spark."""

    BITS = 1 << 27
    SHIFTS = (0, 27, 37)

    def __init__(self, seeds: DataFrame):
        """seeds: (seed long). At most BITS / 64 rows (32 MB) come to the driver, whatever the benchmark."""
        at = F.explode(F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND(F.lit(self.BITS - 1)) for s in self.SHIFTS]))
        bits = F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))"))
        rows = seeds.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(bits.alias("bits")).toArrow()
        self.words = np.zeros(self.BITS >> 6, U64)
        self.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(U64)

    def places(self, seeds: np.ndarray) -> np.ndarray:
        """The places of the seeds that may be an item's."""
        hit = np.arange(len(seeds))
        for s in self.SHIFTS:
            at = (seeds[hit] >> U64(s)) & U64(self.BITS - 1)
            hit = hit[(self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1]
        return hit


#: A text's or an item's seeds: the distinct ones with how often they stand there, and all with their places, by seed.
SEEDS = "id long, size long, k long, seeds array<long>, times array<long>, found binary, place binary"


def _seed_rows(batches, seeds_of):
    """SEEDS batches of (id, text) batches; seeds_of gives (k, seeds, places) of a text's words."""
    kinds = (*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 2)
    for batch in slices(batches):
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
            words = word_hashes(text)
            k, seeds, place = seeds_of(words)
            if len(seeds):
                order = np.argsort(seeds, kind="stable")  # the places of a seed stay in order
                each, times = np.unique(seeds, return_counts=True)
                rows.append((i, len(words), k, each.view(np.int64), times, seeds[order].tobytes(), place[order].astype(np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["id", "size", "k", "seeds", "times", "found", "place"])


def tiles_of_seeds(item: tuple[np.ndarray, np.ndarray], text: tuple[np.ndarray, np.ndarray], size: int, k: int) -> list[tuple[int, int, int]]:
    """The tiles of an item of `size` words in a text, from (seeds, places) of both, sorted by seed."""
    first, last = (np.searchsorted(text[0], item[0], side) for side in ("left", "right"))
    met = np.flatnonzero(last > first)
    met = met[np.argsort(item[1][met], kind="stable")]
    places = [(int(item[1][m]), text[1][first[m] : last[m]]) for m in met.tolist()]
    return tile(runs_of_places(places, k), size, int(text[1].max(initial=0)) + k, k)


def seed_join(texts: DataFrame, bench: DataFrame, k: int, min_coverage: float, salts: int = 16) -> DataFrame:
    """(id, item, coverage, n_tiles, longest, at_word) of texts and bench, both (id, text), joined on seeds.

    Of a text the seeds that a Bloom filter of the benchmark's lets through are kept. Tiles of k words or more
    that cover c words of an item hold c / k of its seeds at least, so it is enough to look up all but c / k - 1
    of those that texts have at all: the ones in the fewest texts, so that a phrase of many items and many texts
    pairs none of them. A pair that shares such a seed is tiled from the seeds of both. The keys of both
    joins are dealt over `salts` by text, for seeds and items that very many texts hold.
    """

    def of_items(batches):
        def seeds_of(words):
            n = max(min(k, len(words)), 1)
            seeds = grams(words, n)
            return n, seeds, np.arange(len(seeds))

        return _seed_rows(batches, seeds_of)

    items = settle(bench.mapInArrow(of_items, SEEDS).withColumn("item", F.monotonically_increasing_id()))
    of_item = items.select("item", "size", "k", F.inline(F.arrays_zip("seeds", "times"))).withColumnRenamed("seeds", "seed")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # k of them at most
    known = texts.sparkSession.sparkContext.broadcast(SeedFilter(of_item.select("seed")))

    def of_texts(batches):
        def seeds_of(words):
            found, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for n in lengths:
                seeds = grams(words, n)
                place.append(known.value.places(seeds))
                found.append(seeds[place[-1]])
            return k, np.concatenate(found), np.concatenate(place)

        return _seed_rows(batches, seeds_of)

    held = settle(texts.mapInArrow(of_texts, SEEDS).withColumn("text", F.monotonically_increasing_id()))
    of_text = held.select("text", F.explode("seeds").alias("seed"))

    of_one = Window.partitionBy("item")  # an item's seeds
    least = F.greatest(F.ceil(F.ceil(F.col("size") * F.lit(float(min_coverage)) - 1e-9) / F.col("k")), F.lit(1))
    present = of_item.join(of_text.groupBy("seed").agg(F.count("*").alias("texts")), "seed")
    present = present.withColumns({"all": F.sum("times").over(of_one), "upto": F.sum("times").over(of_one.orderBy("texts", "seed").rowsBetween(Window.unboundedPreceding, 0))})
    looked_up = present.where((F.col("all") >= least) & (F.col("upto") - F.col("times") <= F.col("all") - least)).select("item", "seed")

    each_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    own_salt = F.pmod("text", F.lit(salts).cast("long"))
    pairs = looked_up.withColumn("salt", each_salt).join(of_text.withColumn("salt", own_salt), ["seed", "salt"]).select("text", "item").distinct()
    with_items = pairs.withColumn("salt", own_salt).join(items.select("item", F.col("id").alias("item_id"), "size", "k", F.col("found").alias("item_found"), F.col("place").alias("item_place"), each_salt.alias("salt")), ["item", "salt"])
    both = with_items.join(held.select("text", "id", "found", "place"), "text").select("id", "item_id", "size", "k", "item_found", "item_place", "found", "place")

    def tiled(batches):
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches):
            rows = []
            for i, item, size, n, *seeds in zip(*[c.to_pylist() for c in batch.columns]):
                item_found, item_place, found, place = (np.frombuffer(b, t) for b, t in zip(seeds, (U64, np.int64) * 2))
                tiles = tiles_of_seeds((item_found, item_place), (found, place), size, n)
                coverage = sum(t[2] for t in tiles) / size
                if tiles and coverage >= min_coverage:
                    rows.append((i, item, coverage, len(tiles), max(t[2] for t in tiles), tiles[0][1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["id", "item", "coverage", "n_tiles", "longest", "at_word"])

    return both.mapInArrow(tiled, "id long, item long, coverage double, n_tiles long, longest long, at_word long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    min_coverage: float = 0.5,
    block_words: int = 1_000_000,
) -> DataFrame:
    """(id_col, item_col, coverage, n_tiles, longest, at_word): texts that hold benchmark items.

    A row for each text and item of which tiles of k words or more cover at least
    min_coverage of the item's words; an item of fewer than k words has to be in
    the text as a whole. Null, empty and blank items and texts match nothing.
    Texts of any length count as a whole. Of equally long tiles the first in the
    item, then in the text, is taken. Repeated rows on either side give repeated
    results, null ids go through, and so do empty tables (no rows); other columns
    are not read.

    A benchmark of up to block_words words (a broadcast of some 30 MB at most) goes to
    the tasks whole and meets the texts where they are read. A larger one meets them in
    a shuffle on seeds (seed_join). The result is the same.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t <> ''")
    words = bench.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0  # words are two bytes or longer, with the gap
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = [id_col, item_col, "coverage", "n_tiles", "longest", "at_word"]
    if words > block_words:
        return seed_join(texts, bench, k, min_coverage).toDF(*names)
    rows = sorted(((r.i, r.t.encode()) for r in bench.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared = spark.sparkContext.broadcast(Items(rows, k))

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        for batch in slices(batches):
            found = [[] for _ in range(6)]
            for i, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                for hit in shared.value.covered(text, min_coverage):
                    for column, value in zip(found, (i, *hit)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], ["id", "item", "coverage", "n_tiles", "longest", "at_word"])

    return texts.mapInArrow(run, "id long, item long, coverage double, n_tiles long, longest long, at_word long").toDF(*names)
