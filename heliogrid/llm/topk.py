"""Exact top-k inner products by a Voronoi join.

With one more component, sqrt(M^2 - |x|^2) for data (M: the greatest norm) and 0
for queries, the squared distance of q and x is |q|^2 + M^2 - 2 <q, x>: the
highest inner products are the nearest neighbours. Pivots cut queries and data
into Voronoi cells. The k + 1 vectors nearest to each pivot are a cell's summary;
from all summaries each query has k scores that its answer can't fall below, and
so a radius. Of a group of query cells these radii give, for each data cell, the
range of distances to its pivot within which vectors may be needed (the triangle
inequality), or none (the plane between two pivots). Only those vectors are
copied to the group, where blocks of queries and data are multiplied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, slices
from .embeddings import choose_pivots
from .integers import exact_products, integer_vectors, unpacked

LOWEST = np.iinfo(np.int64).min


class Space:
    """The pivots in the space with one more component; distances are doubles, used with a margin."""

    def __init__(self, pivots: np.ndarray, top2: float):
        self.pivots, self.top2 = pivots.astype(float), top2
        self.norm2 = (self.pivots**2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(top2 - self.norm2, 0))
        d2 = self.norm2[:, None] + self.norm2 - 2 * self.pivots @ self.pivots.T + (self.extra[:, None] - self.extra) ** 2
        self.apart = np.sqrt(np.maximum(d2, 0))

    def of_data(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of data rows to the pivots."""
        x = x.astype(float)
        n2 = (x**2).sum(axis=1)
        extra = np.sqrt(np.maximum(self.top2 - n2, 0))
        return np.maximum(n2[:, None] + self.norm2 - 2 * x @ self.pivots.T + (extra[:, None] - self.extra) ** 2, 0)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        return np.maximum((q**2).sum(axis=1)[:, None] + self.top2 - 2 * q @ self.pivots.T, 0)

    def radius(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance of a score of `least`; without one, no limit."""
        q = q.astype(float)
        d2 = (q**2).sum(axis=1) + self.top2 - 2 * least.astype(float)
        return np.where(least == LOWEST, np.inf, np.sqrt(np.maximum(d2, 0)))

    def margin(self, q: np.ndarray) -> np.ndarray:
        """More than rounding can make of a distance."""
        return 1e-6 * (1 + np.sqrt(self.top2) + np.sqrt((q.astype(float) ** 2).sum(axis=1)))


def chain(apart: np.ndarray) -> list[int]:
    """All pivots, each next to the nearest one not yet taken."""
    out, left = [0], set(range(1, len(apart)))
    while left:
        out.append(min(left, key=lambda j: (apart[out[-1], j], j)))
        left.remove(out[-1])
    return out


def needed(space: Space, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi) by query and data cell: which distances to the cell's pivot its needed vectors have; lo > hi if none."""
    d2 = space.of_queries(q)
    d, r = np.sqrt(d2), (space.radius(q, least) + space.margin(q))[:, None]
    home = d2.argmin(axis=1)
    own = d2[np.arange(len(q)), home][:, None]
    # a vector of a cell is at least this far from a query beyond the plane between the cell's pivot and the query's
    beyond = d2 - own > 2 * r * space.apart[home] + 1e-9 * (d2 + own)
    return np.where(beyond, np.inf, d - r), np.where(beyond, -np.inf, d + r)


def best_of(scores: np.ndarray, ids: np.ndarray, least: int, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores at or above least, ties to the smaller id, without place `own` (-1: none)."""
    found = np.flatnonzero(scores >= least)
    found = found[found != own]
    if len(found) > k:
        cut = np.partition(scores[found], len(found) - k)[len(found) - k]
        found = found[scores[found] >= cut]
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


def _join(rows: DataFrame, dims: int, k: int, max_pivots: int, sample_rows: int, query_block: int, block: int, max_groups: int) -> DataFrame:
    """(row, query_id, vec_id, score): candidates that hold the k best of each query, of rows (id, flag, vec) of one length."""
    spark = rows.sparkSession
    sc = spark.sparkContext

    def norms(batches):
        for batch in slices(batches, 4096):
            x = unpacked(batch.column(0).to_pylist(), dims).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([(x**2).sum(axis=1).max(initial=0)], pa.float64())], ["n", "top2"])

    total = rows.select("vec").mapInArrow(norms, "n long, top2 double").agg(F.sum("n").alias("n"), F.max("top2").alias("top2")).first()
    picked = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample_rows).select("vec").collect()
    sample = unpacked([bytes(r.vec) for r in picked], dims)
    chosen = choose_pivots(np.column_stack([sample, np.sqrt(np.maximum(total.top2 - (sample.astype(float) ** 2).sum(axis=1), 0))]), int(np.clip(np.sqrt(total.n) / 2, 1, max_pivots)))
    space = sc.broadcast(Space(chosen[:, :dims], total.top2))

    def place(batches):
        for batch in slices(batches, 4096):
            d2 = space.value.of_data(unpacked(batch.column(2).to_pylist(), dims))
            cell = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(d2[np.arange(len(cell)), cell]))], ["id", "flag", "vec", "cell", "distance"])

    placed = rows.select("id", "flag", "vec").mapInArrow(place, "id long, flag boolean, vec binary, cell int, distance double")
    placed = settle(placed.withColumn("row", F.monotonically_increasing_id()))  # names a row from here on

    nearest = Window.partitionBy("cell").orderBy("distance", "row")
    summary = placed.select("cell", "distance", "row", "vec").withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    summary = sorted((r.row, bytes(r.vec)) for r in summary.select("row", "vec").collect())  # k + 1 for each pivot
    summary = sc.broadcast((np.array([r for r, _ in summary]), unpacked([v for _, v in summary], dims)))

    def ask(batches):
        """Each query's cell, and the least score that one of its k best can have."""
        held, vectors = summary.value
        for batch in slices(batches, 512):
            q = unpacked(batch.column(2).to_pylist(), dims)
            scores = exact_products(q, vectors)
            at = np.minimum(np.searchsorted(held, np.asarray(batch.column(0))), len(held) - 1)
            own = np.flatnonzero(held[at] == np.asarray(batch.column(0)))
            scores[own, at[own]] = LOWEST
            least = np.partition(scores, -k, axis=1)[:, -k] if len(held) >= k else np.full(len(q), LOWEST)
            cell = space.value.of_queries(q).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64()), pa.array(cell, pa.int32())], ["row", "id", "vec", "least", "cell"])

    asked = settle(placed.where("flag").select("row", "id", "vec").mapInArrow(ask, "row long, id long, vec binary, least long, cell int"))
    by_cell = {r.cell: r["count"] for r in asked.groupBy("cell").count().collect()}  # at most a row a pivot
    n_queries = sum(by_cell.values())
    group_of, n_groups, seen = np.zeros(len(chosen), np.int64), int(np.clip(np.ceil(n_queries / query_block), 1, max_groups)), 0
    for cell in chain(space.value.apart):
        group_of[cell] = min(n_groups - 1, seen * n_groups // max(1, n_queries))
        seen += by_cell.get(cell, 0)

    def bound(batches):
        """For each group and data cell, the range of distances that a query of the group needs."""
        lows = np.full((n_groups, len(group_of)), np.inf)
        highs = -lows
        for batch in slices(batches, 1024):
            lo, hi = needed(space.value, unpacked(batch.column(0).to_pylist(), dims), np.asarray(batch.column(1)))
            group = group_of[np.asarray(batch.column(2))]
            np.minimum.at(lows, group, lo)
            np.maximum.at(highs, group, hi)
        group, cell = np.nonzero(lows <= highs)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(cell, pa.int32()), pa.array(lows[group, cell]), pa.array(highs[group, cell])], ["group", "cell", "lo", "hi"])

    ranges = asked.select("vec", "least", "cell").mapInArrow(bound, "group int, cell int, lo double, hi double").groupBy("group", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lows = np.full((n_groups, len(group_of)), np.inf)
    highs = -lows
    for r in ranges.collect():  # groups x pivots at most
        lows[r.group, r.cell], highs[r.group, r.cell] = r.lo, r.hi
    shared = sc.broadcast((lows, highs))

    def meets(cell: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lows, highs = shared.value
        return np.nonzero((lows[:, cell] <= distance) & (distance <= highs[:, cell]))

    def tally(batches):
        n = np.zeros(n_groups, np.int64)
        for batch in slices(batches, 4096):
            n += np.bincount(meets(np.asarray(batch.column(0)), np.asarray(batch.column(1)))[0], minlength=n_groups)
        yield pa.RecordBatch.from_arrays([pa.array(range(n_groups), pa.int32()), pa.array(n)], ["group", "n"])

    def send(batches):
        for batch in slices(batches, 2048):
            group, row = meets(np.asarray(batch.column(3)), np.asarray(batch.column(4)))
            part = batch.select(["row", "id", "vec"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group, pa.int32())], ["row", "id", "vec", "group"])

    counts = {r.group: r.n for r in placed.select("cell", "distance").mapInArrow(tally, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
    per_task = [int(np.clip(counts[g] / (4 * sc.defaultParallelism), 1024, block)) for g in range(n_groups)]
    asks = [sum(n for c, n in by_cell.items() if group_of[c] == g) for g in range(n_groups)]
    # each block of a group's queries meets each block of its data in a task of its own
    deals = spark.createDataFrame([(g, max(1, -(-asks[g] // query_block)), max(1, -(-counts[g] // per_task[g]))) for g in range(n_groups)], "group int, q_blocks int, blocks int")
    mine = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = placed.select("row", "id", "vec", "cell", "distance").mapInArrow(send, "row long, id long, vec binary, group int").join(F.broadcast(deals), "group")
    data = data.select("group", every("q_blocks").alias("i"), mine("blocks").alias("j"), "row", "id", "vec", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("least"))
    groups = F.array(*[F.lit(int(g)) for g in group_of])
    queries = asked.withColumn("group", groups[F.col("cell")]).join(F.broadcast(deals), "group")
    queries = queries.select("group", mine("q_blocks").alias("i"), every("blocks").alias("j"), "row", "id", "vec", F.lit(True).alias("asks"), "least")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        x_rows, x_ids, data = x["row"].to_numpy(np.int64), x["id"].to_numpy(np.int64), unpacked(x["vec"].tolist(), dims)
        place = {r: at for at, r in enumerate(x_rows.tolist())}
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        least = q["least"].to_numpy(np.int64)
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            scores = exact_products(unpacked(part["vec"].tolist(), dims), data)
            for line, row, i, lowest in zip(scores, part["row"].tolist(), part["id"].tolist(), least[at : at + 256].tolist()):
                found = best_of(line, x_ids, lowest, place.get(row, -1), k)
                for column, value in zip(out, (np.full(len(found), row), np.full(len(found), i), x_ids[found], line[found])):
                    column.append(value)
        return pd.DataFrame(dict(zip(("row", "query_id", "vec_id", "score"), map(np.concatenate, out))))

    return queries.unionByName(data).groupBy("group", "i", "j").applyInPandas(solve, "row long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    max_pivots: int = 512,
    sample_rows: int = 4096,
    query_block: int = 2048,
    block: int = 32_768,
    max_groups: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors for which the boolean column `query`
    is true, the k other rows of the highest inner product of floor(scale * x), all if there are fewer.

    Ties go to the smaller id. Vectors that are null or empty or hold null or
    non-finite components, and rows with a null id, are neither queries nor
    candidates. Vectors of different lengths aren't compared. Rows that repeat are
    rows of their own: each is asked for, and is a candidate for the others, also
    those of its id. A null `query` is false. Components beyond 2**53 count as
    2**53, scores beyond a long as the largest or smallest long. An empty table
    gives no rows; other columns are not read.

    Pivots, summaries and ranges are bounded by the parameters, whatever the
    table's size; they decide what is copied, not the result. Cells of any size are
    dealt in blocks of `block` vectors and query_block queries.
    """
    rows = integer_vectors(vectors, id_col, vector_col, scale, query)
    parts = None
    for r in rows.groupBy("dims").count().collect():  # a row for each vector length
        part = _join(rows.where(F.col("dims") == r.dims), r.dims, k, max_pivots, sample_rows, query_block, block, max_groups).withColumn("dims", F.lit(r.dims))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("dims", "row").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL for queries of ids divisible by 100, by all pairs with them.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
