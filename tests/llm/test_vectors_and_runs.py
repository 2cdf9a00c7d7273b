"""Top-k search, clustering and periodic runs against plain forms."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from heliogrid.llm import clusters, integers, periodic, queries, topk


def plain_ints(x, scale=1024):
    return [int(np.floor(scale * float(v))) for v in x]


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x)


# --- exact top-k ---------------------------------------------------------------


def plain_top_k(rows, is_query, k):
    out = []
    held = [(n, i, plain_ints(x)) for n, (i, x) in enumerate(rows) if i is not None and usable(x)]
    for n, i, q in held:
        if not is_query(i):
            continue
        scores = [(-min(max(sum(a * b for a, b in zip(q, x)), -(2**63)), 2**63 - 1), j) for m, j, x in held if m != n and len(x) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}")


def test_top_k_equals_all_pairs_with_ties_copies_and_clusters(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16))
    rows = [(i, (centre[i % 6] * (1 + i % 3) + rng.normal(scale=0.05, size=16)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third are equal: ties by id
    found = topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=5, query_block=16, block=64, max_groups=4)
    assert sorted(map(tuple, found.collect())) == plain_top_k(rows, lambda i: i % 10 == 0, 5)


@pytest.mark.parametrize("settings_", [{}, {"max_pivots": 1}, {"query_block": 3, "max_groups": 8, "sample_rows": 20}])
def test_top_k_of_odd_rows(spark, settings_):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (10, [0.5, -3.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 0.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 4.0])]
    rows += [(10, [0.5, -3.0]), (10, [4.0, 4.0]), (30, [0.0, 0.0]), (7, [1e200, 1.0]), (40, [-1e200, 2.0]), (50, [-1e200, -1e200])]
    found = topk.top_k(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=4, **settings_)
    top = float(integers.MOST) / 1024
    clipped = [(i, [min(max(v, -top), top) for v in x] if usable(x) else x) for i, x in rows]
    assert sorted(map(tuple, found.collect())) == plain_top_k(clipped, lambda i: i % 10 == 0, 4)


def test_top_k_of_no_rows_no_queries_and_clashing_names(spark):
    none = vectors(spark, [])
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).collect() == []
    some = vectors(spark, [(1, [1.0]), (2, [2.0])])
    assert topk.top_k(some, F.col("vec_id") == 9).collect() == []
    assert topk.top_k(some, F.lit(None).cast("boolean")).collect() == []
    clash = some.withColumns({n: F.lit("x") for n in ("row", "cell", "rank", "score", "dims", "flag", "id", "vec")})
    assert sorted(map(tuple, topk.top_k(clash, F.col("vec_id") == 1).collect())) == [(1, 1, 2, 1024 * 2048)]


def test_clusters_are_pruned_and_lose_nothing():
    """Ranges leave out cells of other clusters, and never one of the k best."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(8, 12)) * 4000
    x = np.rint(np.repeat(centre, 50, axis=0) + rng.normal(scale=20, size=(400, 12))).astype(np.int64)
    top2 = float((x.astype(float) ** 2).sum(axis=1).max())
    space = topk.Space(x[::50], top2)
    d = np.sqrt(space.of_data(x))
    cell, distance = d.argmin(axis=1), d.min(axis=1)
    scores = integers.exact_products(x, x)
    least = np.partition(scores, -6, axis=1)[:, -6]
    lo, hi = topk.needed(space, x, least)
    wanted = (lo[:, cell] <= distance) & (distance <= hi[:, cell])
    assert (wanted | (scores < least[:, None])).all()
    assert wanted.mean() < 0.5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**53), 2**53), min_size=3, max_size=3), max_size=8))
def test_integers_pack_and_multiply_exactly(rows):
    x = np.array(rows, np.int64).reshape(-1, 3)
    assert integers.unpacked(integers.packed(x), 3).tolist() == x.tolist()
    plain = [[min(max(sum(a * b for a, b in zip(p, q)), -(2**63)), 2**63 - 1) for q in rows] for p in rows]
    assert integers.exact_products(x, x).tolist() == plain


# --- clustering ----------------------------------------------------------------


def plain_cluster(rows, k, dims, rounds):
    held = [(i, plain_ints(x)) for i, x in rows if i is not None and x is not None and len(x) == dims and usable(x)]
    first = sorted(held, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())[:k]
    centroids = [list(x) for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in held]
        for c in range(len(centroids)):
            if own := [x for (_, x), n in zip(held, at) if n == c]:
                centroids[c] = [sum(v) // len(own) for v in zip(*own)]
    out = [(i, *near(x)[::-1]) for i, x in held]
    sums = {c: sum(d for _, n, d in out if n == c) for c in range(len(centroids))}
    return sorted((i, c, d, sums[c], sum(sums.values()), centroids[c]) for i, c, d in out)


def test_clusters_equal_a_plain_loop(spark):
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 5)).tolist()) for i in range(300)] + [(500 + i, [0.5] * 16) for i in range(150)]
    rows += [(900, None), (901, [1.0] * 15), (902, [float("nan")] + [1.0] * 15), (903, [None] + [1.0] * 15), (None, [1.0] * 16), (904, [])]
    found = clusters.cluster(vectors(spark, rows).withColumn("cluster", F.lit("x")), k=8, dims=16, rounds=10)
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in found.collect())
    assert got == plain_cluster(rows, 8, 16, 10)


def test_clusters_of_few_rows_equal_rows_and_none(spark):
    assert clusters.cluster(vectors(spark, []), dims=4).collect() == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (1, [1.0, 2.0, 3.0, 4.0]), (2, [-7.0, 0.0, 1e4, 0.0])]
    got = clusters.cluster(vectors(spark, rows), dims=4, k=8).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in sorted(got)] == [(i, c, d) for i, c, d, *_ in plain_cluster(rows, 8, 4, 10)]
    with pytest.raises(ValueError):
        clusters.cluster(vectors(spark, rows), dims=3)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 40, 1000, 1 << 29, 1 << 52]), st.sampled_from([1, 4, 64]))
def test_the_progressive_search_finds_the_nearest(seed, size, dims):
    rng = np.random.default_rng(seed)
    x, c = (rng.integers(-size, size + 1, (n, dims)) for n in (40, 6))
    c[3] = c[1]  # a tie
    h = clusters.walsh(dims)
    at, total, _ = clusters.nearest(x @ h.T, c @ h.T)
    plain = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)), n) for n, q in enumerate(c)) for p in x]
    assert [(int(d) // dims, int(n)) for d, n in zip(total, at)] == plain


def test_the_progressive_search_skips_most_of_far_centroids():
    rng = np.random.default_rng(2)
    c = rng.integers(-1000, 1000, (8, 1)) + rng.integers(-20, 20, (8, 64))
    x = c[rng.integers(0, 8, 500)] + rng.integers(-5, 5, (500, 64))
    h = clusters.walsh(64)
    _, _, compared = clusters.nearest(x @ h.T, c @ h.T)
    assert compared < 0.4 * 500 * 8 * 64


def test_walsh_rows_go_from_coarse_to_fine():
    h = clusters.walsh(16)
    assert (h @ h.T == 16 * np.eye(16, dtype=int)).all()
    assert (np.diff(h, axis=1) != 0).sum(axis=1).tolist() == list(range(16))


# --- periodic runs -------------------------------------------------------------


def plain_runs(w, min_words=24, min_periods=3):
    """Every lag's maximal stretches, of equal ones that of the smallest lag."""
    found = {}
    for lag in range(1, len(w) // min_periods + 1):
        i = lag
        while i < len(w):
            if w[i] != w[i - lag]:
                i += 1
                continue
            begin = i
            while i < len(w) and w[i] == w[i - lag]:
                i += 1
            length = i - begin + lag
            if length >= max(min_words, min_periods * lag):
                found.setdefault((begin - lag, length), lag)
    return sorted(((s, n, lag) for (s, n), lag in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rng):
    """Words with runs within runs, next to each other and with breaks."""
    out = []
    for _ in range(rng.randint(1, 6)):
        base = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            base = base * rng.randint(1, 4) + [rng.randint(0, 3)]
        part = base * rng.randint(1, 9)
        out += part[: rng.randint(1, len(part))]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = 99
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_runs_equal_all_lags(seed):
    w = repeating(random.Random(seed))
    assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_runs_of_two_words(w):
    assert periodic.runs(np.array(w, np.int64)) == plain_runs(w)


def test_a_very_long_text_of_one_word_takes_no_square():
    assert periodic.runs(np.zeros(2_000_000, np.int64)) == [(0, 2_000_000, 1)]
    ids = np.tile(np.arange(1000), 600)
    assert periodic.runs(ids) == [(0, 600_000, 1000)]


def test_short_limits_are_refused():
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(30, np.int64), min_words=10)


def test_periodic_runs_of_odd_rows(spark):
    text = "begin " + "a b c " * 10 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (None, text), (5, "x " * 24), (6, "x " * 23), (7, "É é " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("runs", "n_words", "strongest")})
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs).collect()}
    run = ((1, 30, 3),)
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 32, run, "begin a b c end"), (None, 32, run, "begin a b c end"),
        (5, 24, ((0, 24, 1),), "x"), (6, 23, (), " ".join("x" * 23)), (7, 40, ((0, 40, 2),), "É é"),
    }
    assert periodic.periodic_runs(docs).count() == len(rows)
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_invalid_utf8_is_kept(spark):
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF2062') as string) as text")
    (row,) = periodic.periodic_runs(docs).selectExpr("n_words", "hex(cast(collapsed as binary)) as h").collect()
    assert (row.n_words, row.h) == (2, "61FF2062")


def test_the_strongest_run_is_exact():
    assert periodic.strongest([(9, 31, 10), (4, 62, 20), (0, 30, 10)]) == (4, 62, 20)
    assert periodic.strongest([]) is None


def test_op12_plants_and_digests(spark, tmp_path):
    """The query's columns, from a plain reading of its definition."""
    import zlib

    words = lambda n: [f"w{k}" for k in range(n)]
    rows = [(i, " ".join(words(3 + 41 * i % 700)), "en", "s", 1) for i in range(120)] + [(200, None, "en", "s", 1), (201, "", None, None, None), (None, "a " * 30, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, text, *_ in rows:
        w = (text or "").split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = plain_runs(w)
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = periodic.strongest(found) or (None, None, None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.add((i, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(1 for r in got if r[1]) >= 5
