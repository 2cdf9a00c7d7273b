"""Centroid clustering, with the nearest centroid found by a progressive Walsh-Hadamard search.

The Walsh-Hadamard transform of integers is of integers, and squared distances of
transforms are those of the vectors times the number of components. Coefficients
are taken in the order of their sign changes, coarse ones first. After 1, 2, 4, ...
of them a pair of vector and centroid has a partial sum; what the rest can add
lies between the squares of the difference and of the sum of the norms of the
two tails. A centroid that is strictly worse than another one on these bounds
goes; those that are left get all coefficients, so their distances are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices
from .integers import LONGEST, integer_vectors, packed, unpacked


def walsh(dims: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < dims:
        h = np.block([[h, h], [h, -h]])
    if len(h) != dims:
        raise ValueError(f"{dims} components: a Walsh-Hadamard transform takes a power of two")
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def levels(dims: int) -> list[tuple[int, int]]:
    """Stretches of coefficients that are accumulated together: 1, 1, 2, 4, ... of them."""
    ends = [1 << b for b in range(dims.bit_length())]
    return list(zip([0, *ends[:-1]], ends))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(place of the nearest centroid, the smaller one of equals; dims times the squared distance;
    coefficients compared) of rows of coefficients x. Exact: in int64 if that holds all sums, else
    in integers of any size."""
    dims = x.shape[1]
    if len(x) and max(int(np.abs(x).max()), int(np.abs(centroids).max())) >= 1 << 31 - (dims.bit_length() + 1) // 2:
        x, centroids = x.astype(object), centroids.astype(object)
    total = np.zeros((len(x), len(centroids)), x.dtype)
    alive, compared = np.ones(total.shape, bool), 0
    tail = [np.sqrt((v.astype(float) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]) for v in (x, centroids)]  # norms from each coefficient on
    for begin, end in levels(dims):
        for c in range(len(centroids)):
            rows = np.flatnonzero(alive[:, c])
            total[rows, c] += ((x[rows, begin:end] - centroids[c, begin:end]) ** 2).sum(axis=1)
            compared += len(rows) * (end - begin)
        if end < dims:
            mine, theirs, sums = tail[0][:, end, None], tail[1][None, :, end], total.astype(float)
            low, high = sums + (mine - theirs) ** 2, np.where(alive, sums + (mine + theirs) ** 2, np.inf)
            alive &= low * (1 - 1e-9) <= high.min(axis=1, initial=np.inf)[:, None] * (1 + 1e-9)
    worst = total.max(initial=0) + 1
    at = np.where(alive, total, worst).argmin(axis=1)
    return at, total[np.arange(len(x)), at], compared


def _sums(coefficients: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """{(cluster, place): sum of that coefficient}, and the cluster's size at place -1."""
    dims = centroids.shape[1]
    shared = coefficients.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        sums, sizes = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in slices(batches, 4096):
            x = unpacked(batch.column(0).to_pylist(), dims)
            at, _, _ = nearest(x, shared.value)
            sizes += np.bincount(at, minlength=len(sizes))
            for c in np.unique(at).tolist():
                part = x[at == c]
                sums[c] += part.astype(object).sum(axis=0) if np.abs(part).max() >= 1 << 50 else part.sum(axis=0).astype(object)
        held = np.flatnonzero(sizes).tolist()
        keys = [(c, place) for c in held for place in range(-1, dims)]
        values = [Decimal(int(sizes[c] if place < 0 else sums[c, place])) for c, place in keys]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["cluster", "place", "total"])

    parts = coefficients.select("vec").mapInArrow(run, "cluster int, place int, total decimal(38,0)")
    return {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}  # clusters x dims


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(id_col, cluster, distance, cluster_size, cluster_inertia, inertia, centroid) of the vectors of exactly `dims` components.

    Components become floor(scale * x). The k vectors with the smallest sha256 of
    `seed:id` are the first centroids; in each round every vector goes to the
    nearest one (squared Euclidean distance, ties to the smaller number) and
    centroids become their vectors' componentwise floor(sum / count), exactly;
    empty ones stay. distance is that to the final centroid, centroid its
    components. Rounds end early where nothing changes, as no later one would
    change anything.

    Vectors that are null, of another length or hold null or non-finite components
    and rows with a null id have no row. Rows that repeat are vectors of their own;
    of those with equal hashes the smaller vectors start first. Fewer than k vectors
    make as many centroids; an empty table gives no rows. Components beyond 2**53
    count as 2**53; distances and sums beyond a long become the largest long. Other
    columns are not read.

    A round is one pass with a row of sums a cluster, coefficient and task; only
    k x dims sums reach the driver.
    """
    h = walsh(dims)
    spark = vectors.sparkSession

    def transform(batches):
        for batch in slices(batches, 4096):
            x = unpacked(batch.column(1).to_pylist(), dims)
            exact = np.abs(x).max(initial=0) * dims < 1 << 53  # then doubles hold every sum
            x = (x.astype(float) @ h.T.astype(float)).astype(np.int64) if exact else x @ h.T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed(x), pa.binary())], ["id", "vec"])

    kept = integer_vectors(vectors, id_col, vector_col, scale).where(F.col("dims") == dims).select("id", "vec")
    coefficients = settle(kept.mapInArrow(transform, "id long, vec binary"))
    first = coefficients.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "id", "vec").limit(k).collect()
    back = lambda sums: [[sum(int(a) * int(b) for a, b in zip(s, column)) // dims for column in h.T] for s in sums]  # noqa: E731  h is its own inverse, times dims
    names = [id_col, "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid"]
    if not first:
        return spark.createDataFrame([], f"`{id_col}` long, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = unpacked([bytes(r.vec) for r in first], dims)
    for _ in range(rounds):
        sums = _sums(coefficients, centroids)
        after = centroids.copy()
        for c in range(len(centroids)):
            if n := sums.get((c, -1)):
                mean = np.array([s // n for s in back([[sums[c, p] for p in range(dims)]])[0]], np.int64)
                after[c] = h @ mean
        if (after == centroids).all():
            break
        centroids = after
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in slices(batches, 4096):
            at, total, _ = nearest(unpacked(batch.column(1).to_pylist(), dims), shared.value)
            distance = [min(int(d) // dims, LONGEST) for d in total.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    found = settle(coefficients.mapInArrow(assign, "id long, cluster int, distance long"))
    each = found.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    inertia = min(LONGEST, sum(int(r.inertia) for r in each))
    lines = [(r.cluster, r.n, min(LONGEST, int(r.inertia)), inertia, c) for r in each for c in back([centroids[r.cluster].tolist()])]
    known = spark.createDataFrame(lines, "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(known), "cluster").select(F.col("id").alias(id_col), *names[1:])


def _oracle(k: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """SQL of the same: each round is two common table expressions."""
    apart = "list_sum(list_transform(list_zip(v.e, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "SELECT v.vec_id, v.e, arg_min(c.cluster, ({apart}, c.cluster)) AS cluster, min({apart}) AS distance FROM v JOIN {c} c ON true GROUP BY v.vec_id, v.e".replace("{apart}", apart)
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, e AS c FROM v QUALIFY cluster < {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        summed = f"SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY cluster, i"
        floored = "(CASE WHEN s >= 0 THEN s // n ELSE -((-s + n - 1) // n) END)"
        parts.append(f"m{r} AS MATERIALIZED (SELECT cluster, list({floored}::HUGEINT ORDER BY i) AS c FROM ({summed}) GROUP BY cluster)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.cluster = c.cluster)")
    parts.append(f"a AS MATERIALIZED ({near.format(c=f'c{rounds}')})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, a.cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,"
        f" sha256(array_to_string(list_transform(c.c, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.cluster = a.cluster"
    )


ORACLE = _oracle()
