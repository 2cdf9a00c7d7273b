"""Near-duplicate vectors by an exact metric range join.

Unit vectors at a cosine of c are at a Euclidean distance of sqrt(2 - 2c), so
cosine >= threshold is a range query of radius r in a metric space. Pivots cut
the space into cells; the triangle inequality says which vectors of other cells
can have a partner in a cell and must be copied there; cells then join alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle, slices


def _units(column: pa.Array) -> list[bytes | None]:
    """The vectors of a list column scaled to length 1 in double precision; None where that can't be."""
    column = column.cast(pa.large_list(pa.float64()))
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    starts = column.offsets.to_numpy()[:-1]
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
    out: list[bytes | None] = [None] * len(column)
    for dims in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dims)
        x = flat[starts[rows][:, None] + np.arange(dims)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        x = x[good] / top[good][:, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for row, unit in zip(rows[good].tolist(), x):
            out[row] = unit.tobytes()
    return out


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dims, key, key2, unit): unit is null where nothing can link; the keys name equal unit vectors."""

    def run(batches):
        for batch in slices(batches, 4096):
            raw = _units(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([0 if u is None else len(u) // 8 for u in raw], pa.int32()), pa.array(raw, pa.binary())], ["id", "dims", "unit"])

    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "id long, dims int, unit binary").withColumn("key", F.xxhash64("unit")).withColumn("key2", F.xxhash64(F.lit(7), "unit"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n rows of the sample, each the farthest from those before it."""
    chosen, nearest = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)):
        at = int(nearest.argmax())
        if nearest[at] <= 0:
            break
        chosen.append(at)
        nearest = np.minimum(nearest, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen]


def _links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    product = x @ y.T
    hits = product >= threshold
    # rounding of the sums and of the scaling decides nothing: these pairs are summed exactly and divided by their lengths
    for i, j in zip(*np.nonzero(np.abs(product - threshold) < 1e-12)):
        a, b = x[i], y[j]
        hits[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
    return hits


def _settle_labels(hits: np.ndarray, left: np.ndarray, right: np.ndarray, changes: set) -> None:
    """Spreads the smaller label over the links of a tile until nothing changes there.

    changes gets (label before, label after), so that what earlier tiles had
    joined under a label stays joined.
    """
    rows, cols = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    hits, none = hits[np.ix_(rows, cols)], np.iinfo(np.int64).max
    before = np.concatenate([left[rows], right[cols]])
    while True:
        low = np.where(hits, right[cols][None, :], none).min(axis=1)
        new_left = np.minimum(left[rows], low)
        new_right = np.minimum(right[cols], np.where(hits, new_left[:, None], none).min(axis=0))
        same = (new_left == left[rows]).all() and (new_right == right[cols]).all()
        left[rows], right[cols] = new_left, new_right
        if same:
            break
    after = np.concatenate([left[rows], right[cols]])
    changes.update(zip(before[before != after].tolist(), after[before != after].tolist()))


def range_join(classes: DataFrame, dims: int, threshold: float, n_pivots: int, sample_rows: int, block: int) -> DataFrame:
    """(id, links, root) of classes (id, unit, copies) of one dimension: partial counts
    of linked vectors, and (id, 0, root) for pairs that links join."""
    spark = classes.sparkSession
    # distances are compared with a margin for rounding; the cosine itself decides
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    sample = classes.orderBy(F.xxhash64("id")).limit(sample_rows).select("unit").collect()
    pivots = choose_pivots(np.array([np.frombuffer(s.unit) for s in sample]), n_pivots)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    shared = spark.sparkContext.broadcast((pivots, apart))

    def homes(batches):
        pivots, _ = shared.value
        for batch in slices(batches, 4096):
            x = np.array([np.frombuffer(u) for u in batch.column(1).to_pylist()])
            d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
            home = d2.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(np.sqrt(d2[np.arange(len(x)), home]))], ["id", "unit", "copies", "home", "distance"])

    placed = settle(classes.select("id", "unit", "copies").mapInArrow(homes, "id long, unit binary, copies long, home int, distance double"))
    reach = np.full(len(pivots), -1.0)
    for row in placed.groupBy("home").agg(F.max("distance").alias("r")).collect():
        reach[row.home] = row.r
    reach = spark.sparkContext.broadcast(reach)

    def copies(batches):
        """Own rows, and copies in the cells of a lower number that may hold a partner:
        no farther from the cell's pivot than its reach and r, and no farther than r
        beyond the plane between the two pivots."""
        pivots, apart = shared.value
        for batch in slices(batches, 2048):
            home = np.asarray(batch.column(3))
            x = np.array([np.frombuffer(u) for u in batch.column(1).to_pylist()])
            d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
            own = d2[np.arange(len(x)), home][:, None]
            near = (np.sqrt(d2) <= reach.value[None, :] + r) & (d2 - own <= 2 * r * apart[home] + 1e-9)
            near &= np.arange(len(pivots))[None, :] < home[:, None]
            near[np.arange(len(x)), home] = True
            row, cell = np.nonzero(near)
            part = batch.select(["id", "unit", "copies"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(cell == home[row])], ["id", "unit", "copies", "cell", "own"])

    dealt = placed.mapInArrow(copies, "id long, unit binary, copies long, cell int, own boolean")
    number = lambda own: F.ceil(F.count(F.when(F.col("own") == own, 1)) / block).cast("int")
    counts = settle(dealt.groupBy("cell").agg(number(True).alias("blocks"), number(False).alias("deal")))  # a row for each pivot
    dealt = dealt.join(F.broadcast(counts), "cell")
    # own rows are in `blocks` blocks, copies in `deal`; every two blocks of which one is own meet in a task
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    guest = -1 - F.pmod(F.xxhash64(F.lit(3), "id"), F.greatest("deal", F.lit(1))).cast("int")
    meeting = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    side = lambda x: F.when(F.col("mine") == x, 0).when(F.col("mine") < x, 1).otherwise(2)
    own = F.transform(blocks, lambda x: meeting(F.least("mine", x), F.greatest("mine", x), side(x)))
    host = F.transform(F.when(F.col("deal") > 0, F.sequence(-F.col("deal"), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda x: meeting(F.col("mine"), x, F.lit(1)))
    visit = F.transform(blocks, lambda x: meeting(x, F.col("guest"), F.lit(2)))
    dealt = dealt.withColumns({"mine": mine, "guest": guest}).withColumn("r", F.explode(F.when(F.col("own"), F.concat(own, host)).otherwise(visit)))
    dealt = dealt.select("id", "unit", "copies", "cell", "r.*")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "id"])
        side = pdf["side"].to_numpy()
        ids, n = pdf["id"].to_numpy(np.int64), pdf["copies"].to_numpy(np.int64)
        links, root, changes = np.zeros(len(ids), np.int64), ids.copy(), set()
        within = side[0] == 0
        cut = len(ids) if within else int(np.searchsorted(side, 2))
        if cut == len(ids) and not within or cut == 0:
            return pd.DataFrame({"id": ids[:0], "links": links[:0], "root": root[:0]})
        x = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(ids), dims)
        step = 1024
        for a in range(0, cut, step):
            b_end = min(a + step, cut)
            for c in range(a if within else cut, len(ids), step):
                d = min(c + step, len(ids))
                hits = _links(x[a:b_end], x[c:d], threshold)
                if within and a == c:
                    np.fill_diagonal(hits, False)
                if not hits.any():
                    continue
                links[a:b_end] += hits @ n[c:d]
                if not (within and a == c):
                    links[c:d] += hits.T @ n[a:b_end]
                _settle_labels(hits, root[a:b_end], root[c:d], changes)
        some = links > 0
        joined = np.array(sorted(changes), np.int64).reshape(-1, 2)
        return pd.DataFrame({"id": np.concatenate([ids[some], joined[:, 0]]), "links": np.concatenate([links[some], 0 * joined[:, 0]]), "root": np.concatenate([ids[some], joined[:, 1]])})

    return dealt.groupBy("cell", "i", "j").applyInPandas(join, "id long, links long, root long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    max_pivots: int = 2048,
    rows_per_pivot: int = 4096,
    sample_rows: int = 4096,
    block: int = 16_384,
    block_bytes: int = 1 << 25,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of vectors.

    n_links counts the other rows at a cosine of at least threshold, component_id
    is the smallest id that links reach, kept says that it is the row's own. Null,
    empty and zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths never link. Equal vectors are one class
    and count by their number. Rows with a null id get null and false, and count
    for no other row. Rows that repeat an id count as others. An empty table gives
    no rows; other columns are not read. The cosine is the product of vectors scaled
    to length 1 in double precision; of pairs within 1e-12 of the threshold it is summed
    without rounding and divided by the lengths, so what is left is the rounding of
    the scaled components.

    Pivots are chosen from a bounded sample; any pivots give the same result. There is
    one for rows_per_pivot rows, and from a million rows on sqrt(rows) / 4 of them, up
    to max_pivots (a table of 32 MB of distances between them).
    Cells of any size are joined in blocks of about `block` rows, or as many as are
    block_bytes; a row is shipped once for each pair of blocks that it is in.
    """
    v = settle(unit_vectors(vectors, id_col, vector_col))
    good = v.where("unit is not null and id is not null")
    classes = settle(good.groupBy("dims", "key", "key2").agg(F.min("id").alias("id"), F.first("unit").alias("unit"), F.count("*").alias("copies")))
    parts = None
    for row in classes.groupBy("dims").count().collect():  # a row for each vector length
        n = int(np.clip(min(row["count"] // rows_per_pivot, math.isqrt(row["count"]) // 4), 2, max_pivots))
        held = max(1, min(block, block_bytes // (8 * row.dims)))
        part = range_join(classes.where(F.col("dims") == row.dims), row.dims, threshold, n, max(sample_rows, 4 * n), held)
        parts = part if parts is None else parts.unionByName(part)
    one = F.when(F.col("id").isNotNull(), F.lit(0).cast("long"))
    if parts is None:
        return v.select(F.col("id").alias(id_col), one.alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    parts = settle(parts)
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(parts.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = classes.join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    found = found.select("dims", "key", "key2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    out = v.join(found, ["dims", "key", "key2"], "left")
    usable = F.col("unit").isNotNull() & F.col("id").isNotNull()
    out = out.select(F.col("id").alias(id_col), F.when(usable, F.col("n")).otherwise(one).alias("n_links"), F.when(usable, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


#: The same in SQL at a threshold of 0.95, by all pairs; for small tables.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95e0),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""
