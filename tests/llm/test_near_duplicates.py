import math
import re

import numpy as np
import pytest

from heliogrid.llm import embeddings, minhash, queries


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts, percent, union):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    u = union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                u.join(a, b)
    return {i: (len(sets[i]), u.find(i)) for i in ids}


def test_op6_against_all_pairs(spark, sf, texts, union):
    rows = queries.op6_minhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, 85, union)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_edits_of_one_text(spark, union):
    """A hub, texts that only chain, and texts just below the threshold."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = {100: " ".join(base)}
    for i in range(60):
        w = list(base)
        for at in rng.choice(150, rng.integers(1, 6), replace=False):
            w[at] = f"e{i}_{at}"
        texts[i] = " ".join(w)
    texts |= {200: None, 201: "", 202: " \n\t", 203: "one two", 204: "One TWO", 205: "one two three", 206: "long " * 60000}
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in texts.items()], "doc_id long, text string, component_id string, id int")
    for percent, block in ((80, 256), (85, 256), (85, 4)):  # buckets at once, and in many blocks
        rows = minhash.near_duplicates(df, threshold_percent=percent, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(texts, percent, union)


def test_blocks_of_a_bucket_meet_once(spark):
    rows = spark.createDataFrame([(b, r) for b, n in ((1, 1), (2, 30), (3, 5)) for r in range(n)], "band long, rep long")
    x, y = minhash.meetings(rows, 4)
    x, y = x.toDF("band", "a", "i", "j"), y.toDF("band", "b", "j", "i")
    got = sorted((r.band, *sorted((r.a, r.b))) for r in x.join(y, ["band", "i", "j"]).where("i < j or a < b").collect())
    assert got == [(b, p, q) for b, n in ((1, 1), (2, 30), (3, 5)) for p in range(n) for q in range(p + 1, n)]


def test_a_band_of_many_classes_makes_few_rows(spark):
    import inspect

    block = inspect.signature(minhash.near_duplicates).parameters["block"].default
    for side in minhash.meetings(spark.range(20_000).selectExpr("1L as band", "id as rep"), block):
        assert side.count() <= 3 * 20_000


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (0, "a b c d e f")], "doc_id long, text string")
    rows = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id is not None] == [(0, 0, True), (1, 0, False), (1, 0, False)]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.9])
def test_bands_miss_less_than_asked(threshold):
    bands, rows = minhash.plan_bands(threshold)
    assert (1 - threshold**rows) ** bands <= 1e-6 and bands * rows <= 130


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(x[:900]), np.unique(x[100:])
    same = (minhash.minmax(a, 512) == minhash.minmax(b, 512)).mean()
    assert abs(same - 0.8) < 0.08


def cosines(vectors, threshold, union):
    good = {}
    for i, v in vectors.items():
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    u, n = union(vectors), {i: 0 for i in vectors}
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                u.join(a, b)
                n[a] += 1
                n[b] += 1
    return {i: (n[i], u.find(i)) for i in vectors}


def test_op1_against_all_pairs(spark, union, sf):
    rng = np.random.default_rng(1)
    vectors = {}
    for c in range(6):
        centre = rng.standard_normal(16)
        for k in range(40):
            vectors[len(vectors)] = (centre + rng.standard_normal(16) * rng.uniform(0, 0.45)).tolist()
    chain = [[math.cos(t), math.sin(t)] for t in np.arange(0, 3, 0.2)]
    vectors |= {1000 + k: v for k, v in enumerate(chain)}
    vectors |= {2000: None, 2001: [], 2002: [0.0] * 16, 2003: [None] * 16, 2004: [float("nan")] * 16, 2005: [float("inf")] + [0.0] * 15}
    vectors |= {3000 + k: vectors[0] for k in range(30)} | {3100: [2 * x for x in vectors[1]], 3101: [1.0] + [None] * 15}
    df = spark.createDataFrame([(i, v, "a") for i, v in vectors.items()], "vec_id long, embedding array<double>, unit string")
    for block, pivots in ((4096, 4096), (16, 8)):  # whole cells, and cells in many blocks
        rows = embeddings.near_duplicates(df, block=block, rows_per_pivot=pivots).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == cosines(vectors, 0.95, union)
        assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_op1_pairs_at_the_threshold():
    """Pairs whose cosine is the threshold up to rounding are decided on an exact sum, whatever the order of the components."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact = lambda a, b: math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))
    for a, b in zip(x[:20], x[20:]):
        c = exact(a, b)
        for threshold in (np.nextafter(c, -1), c, np.nextafter(c, 1)):
            got = [bool(embeddings._links(a[p][None], b[p][None], threshold)[0, 0]) for p in (rng.permutation(64) for _ in range(4))]
            assert got == [c >= threshold] * 4


def test_op1_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [0.99, 0.01]), (3, None), (None, None)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, None, None, False), (None, None, None, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op1_query(spark, sf, union):
    rows = {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_embedding_near_dedup(spark, sf).collect()}
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert rows == cosines(vectors, 0.95, union)


def test_texts_of_hubs(spark):
    """Every pair once with both texts, however the pairs of a hub are dealt."""
    from heliogrid.llm.common import with_texts

    pairs = [(0, k) for k in range(1, 40)] + [(50, 51), (1, 50)]
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(60)] + [(3, "t3"), (3, "a")], "id long, text string")
    for per_task, max_rows in ((512, 1_000_000), (5, 1_000_000), (5, 0)):
        rows = with_texts(spark.createDataFrame(pairs, "a long, b long"), texts, per_task, max_rows).collect()
        assert sorted(map(tuple, rows)) == sorted((a, b, f"t{a}", f"t{b}") for a, b in pairs)
