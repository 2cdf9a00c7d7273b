"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives its minimum and its maximum, so a
signature of n values costs n/2 hash evaluations. Bands of the signature propose
pairs; a proposed pair is linked only if its full shingle sets agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binaries, components, mix, settle, shingles, slices, splitmix, with_texts, word_hashes


def plan_bands(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows a band, up to 6, for which at most 128 values
    miss a pair at the threshold with a probability of no more than `miss`."""
    for rows in range(6, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if bands * rows <= 128:
            return bands + (bands * rows) % 2, rows
    raise ValueError(f"threshold {threshold} is too low for 128 values")


def minmax(shingle_set: np.ndarray, n_values: int) -> np.ndarray:
    """Minima of n/2 permutations, followed by their maxima."""
    half = (n_values + 1) // 2
    mul, add = splitmix(101, half) | U64(1), splitmix(202, half)
    low, high = np.full(half, np.iinfo(U64).max, U64), np.zeros(half, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingle_set), 1024):
            seen = shingle_set[at : at + 1024, None] * mul + add
            np.minimum(low, seen.min(axis=0), out=low)
            np.maximum(high, seen.max(axis=0), out=high)
    return np.concatenate([low, high])[:n_values]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, d1, d2, bands, parity): d1 and d2 are a 128-bit digest of the shingle
    set; parity has a bit for each of 1024 bins, set if the bin's number of shingles is odd."""
    schema = "id long, n_shingles long, d1 long, d2 long, bands array<long>, parity array<long>"
    weights, places = splitmix(303, rows), splitmix(404, bands)

    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), binaries(batch.column(1))):
                found = shingles(word_hashes(text), k)
                with np.errstate(over="ignore"):
                    d1 = int(mix(found + U64(1)).sum(dtype=U64).view(np.int64))
                    d2 = int(mix(found ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).view(np.int64))
                    if len(found):
                        values = minmax(found, bands * rows)
                        keys = mix((mix(values).reshape(bands, rows) * (weights | U64(1))).sum(axis=1, dtype=U64) + places)
                        odd = np.bincount((found >> U64(54)).astype(np.int64), minlength=1024) & 1
                        band_list, parity = keys.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
                    else:
                        band_list, parity = None, None
                for values_out, value in zip(out, (i, len(found), d1, d2, band_list, parity)):
                    values_out.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["id", "n_shingles", "d1", "d2", "bands", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def possible(x: str, y: str, percent: int):
    """Whether the sizes and parities of x and y leave a similarity of percent possible.

    Sets differ in at least as many shingles as their parities differ in bits, so
    no pair at or above the threshold is lost.
    """
    bits = sum((F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(1, 16)), F.bit_count(F.col(f"{x}.parity")[0].bitwiseXOR(F.col(f"{y}.parity")[0])))
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * bits <= (100 - percent) * (n + m))


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""

    def run(batches):
        kept_id, kept = None, None
        for batch in slices(batches, 256):
            good = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2)), binaries(batch.column(3))):
                if kept_id != a:
                    kept_id, kept = a, shingles(word_hashes(ta), k)
                other = shingles(word_hashes(tb), k)
                both = len(np.intersect1d(kept, other, assume_unique=True))
                if both and 100 * both >= percent * (len(kept) + len(other) - both):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in good], pa.int64()) for j in (0, 1)], ["a", "b"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return with_texts(pairs, texts).mapInArrow(run, "a long, b long")


def meetings(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Two sides of rows (band, rep, ...) that meet on (band, i, j): a band of n rows is dealt in
    ceil(n / block) blocks, and every two of its blocks meet under a key of their own, so that no
    task gets more than two blocks of a band. A row is sent about n / block / 2 times to either side."""
    n = rows.groupBy("band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    own = F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = rows.join(n, "band", "left").withColumn("own", own).withColumn("last", F.coalesce("blocks", F.lit(1)) - 1).drop("blocks")
    left = dealt.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", "last")))
    right = dealt.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own")))
    return left.drop("own", "last"), right.drop("own", "last")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_percent: int = 80, k: int = 5, miss: float = 1e-6, block: int = 8192) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Two texts are linked if 100 * |A & B| >= threshold_percent * |A | B| on their
    sets of k-word shingles. component_id is the smallest id reachable by links,
    kept says that it is the row's own. A text of fewer than k words is one
    shingle; null, empty and blank texts have no shingle and link with nothing.
    Rows with a null id get a null component and kept is false; rows that repeat
    an id count as one document (the greatest text, if they differ, for links).
    Texts of any length count with their full sets. An empty table gives no rows;
    other columns are not read.

    Texts with equal sets are one class from the start, so a class of any size
    costs one row. In a bucket, each class is first proposed to the one that shares
    buckets with most others (a star, not all pairs). What then is in a bucket but
    in no common component is proposed pairwise, if sizes and parities leave a link
    possible; a large bucket is dealt over many tasks in blocks of about `block`
    classes. Both filters are exact; only bands can miss a pair, at the threshold
    with a probability of at most `miss`.
    """
    bands, rows = plan_bands(threshold_percent / 100, miss)
    sig = settle(signatures(docs, id_col, text_col, k, bands, rows))
    named = sig.where("n_shingles > 0 and id is not null")
    classes = settle(named.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min_by("parity", "id").alias("parity")))
    sets = classes.select("rep", "n_shingles", "parity")
    buckets = classes.select("rep", F.explode("bands").alias("band"))
    counts = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = settle(buckets.join(counts, "band"))  # of what shares no bucket nothing remains
    known = shared.groupBy("rep").agg(F.sum("n").alias("known"))
    heads = shared.join(known, "rep").groupBy("band").agg(F.max_by("rep", F.struct("known", -F.col("rep"))).alias("a"))
    star = shared.join(heads, "band").where("rep != a").select("a", F.col("rep").alias("b")).distinct()

    def kept(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.rep")).join(sets.alias("y"), F.col("b") == F.col("y.rep"))
        return both.where(possible("x", "y", threshold_percent)).select("a", "b")

    star = settle(kept(star))
    comp = components(verify(star, docs, id_col, text_col, k, threshold_percent))

    labelled = shared.join(comp, shared.rep == comp.node, "left").select("band", "rep", F.coalesce("component", "rep").alias("comp"))
    split = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band")
    open_rows = settle(labelled.join(split, "band").join(sets, "rep"))
    x, y = (side.alias(name) for side, name in zip(meetings(open_rows, block), "xy"))
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.rep") < F.col("y.rep"))
    rest = x.join(y, met & once & (F.col("x.comp") != F.col("y.comp")) & possible("x", "y", threshold_percent))
    rest = rest.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    rest = settle(rest.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = verify(rest, docs, id_col, text_col, k, threshold_percent)
        ends = more
        for end in ("a", "b"):  # only components that new links join are gone over again
            ends = ends.join(comp, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("component", end)).drop("node", "component")
        merged = settle(components(ends).select(F.col("node").alias("component"), F.col("component").alias("least")))
        own = comp.join(merged, "component", "left").select("node", F.coalesce("least", "component").alias("component"))
        alone = merged.join(comp, F.col("node") == merged.component, "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
        comp = settle(own.unionByName(alone))

    reps = classes.join(comp, classes.rep == comp.node, "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = sig.join(reps.withColumnRenamed("n_shingles", "m"), (sig.d1 == reps.d1) & (sig.d2 == reps.d2) & (sig.n_shingles == F.col("m")), "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


#: The same in SQL at 85 %, by a join of all shingles; for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * n >= 85 * (total - n)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, component AS component_id, component = doc_id AS kept FROM s JOIN c ON node = doc_id
"""
