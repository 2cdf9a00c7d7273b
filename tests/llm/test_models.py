"""The two text models against plain forms of what they compute."""

import math
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from heliogrid.llm import langid, quality


def plain_ftrl(rows, classes, dims, epochs, batch, alpha, beta, l1, l2, seed):
    """One coordinate at a time, with dictionaries."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        v = z[i, c]
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            grads, before = defaultdict(float), {}
            for k in order[start : start + batch]:
                found, values, y = rows[k]
                x = {dims: 1.0, **dict(zip(map(int, found), map(float, values)))}
                s = [sum(v * weight(i, c) for i, v in x.items()) for c in range(classes)]
                e = [math.exp(v - max(s)) for v in s]
                for i, v in x.items():
                    for c in range(classes):
                        before[i, c] = weight(i, c)
                        grads[i, c] += v * (e[c] / sum(e) - (c == y))
            for key, g in grads.items():
                step = (math.sqrt(n[key] + g * g) - math.sqrt(n[key])) / alpha
                z[key] += g - step * before[key]
                n[key] += g * g
    return np.array([[weight(i, c) for c in range(classes)] for i in range(dims + 1)])


@pytest.mark.parametrize("batch", [1, 4])
def test_training_equals_a_plain_ftrl(batch):
    rng = np.random.default_rng(batch)
    rows = []
    for _ in range(30):
        found = np.sort(rng.choice(20, rng.integers(1, 8), replace=False))
        rows.append((found, rng.uniform(0.1, 1, len(found)), int(rng.integers(0, 3))))
    a = dict(classes=3, dims=20, epochs=2, batch=batch, alpha=0.5, beta=1.0, l1=0.05, l2=1e-3, seed=9)
    w, b = langid.train(rows, **a)
    plain = plain_ftrl(rows, **a)
    assert np.allclose(w, plain[:-1], atol=1e-12) and np.allclose(b, plain[-1], atol=1e-12)
    assert (w == 0).any() and (w != 0).any()  # elastic net keeps some at zero


def test_identification_equals_a_plain_tfidf(spark):
    """Scores of the Spark job from its own model, by dictionaries of hashed n-grams over whole texts."""
    words = {"aa": "lorem ipsum dolor sit", "bb": "kuu pitk\u00e4 y\u00f6 on", "cc": "der hund l\u00e4uft weit"}
    rng = np.random.default_rng(1)
    text = lambda k: " ".join(rng.choice(words[k].split(), 12))
    train = [(i, text(k), k) for i, k in enumerate(sorted(words) * 20)]
    rows = spark.createDataFrame(train, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(500 + i, text(k)) for i, k in enumerate(sorted(words) * 3)] + [(600, "y\u00f6 hund"), (600, "y\u00f6 hund"), (601, None), (602, "12 3"), (None, "der hund")], "doc_id long, text string")
    model = langid.fit(rows.withColumnRenamed("doc_id", "id"), 800, 10, 2, 8)
    df = defaultdict(int)
    for _, t, _ in train:
        for bucket in langid.counts(t, 10)[0].tolist():
            df[bucket] += 1
    got = langid.identify(docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit(9)}), rows, bits=10, epochs=2).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        t = texts[r.doc_id]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        found, n = langid.counts(t, 10)
        v = [(1 + math.log(k)) * (math.log((1 + len(train)) / (1 + df[i])) + 1) for i, k in zip(found.tolist(), n.tolist())]
        length = math.sqrt(sum(x * x for x in v))
        s = [sum(x / length * model["w"][i][c] for i, x in zip(found.tolist(), v)) + model["b"][c] for c in range(3)]
        e = [math.exp(x - max(s)) for x in s]
        assert r.lang_pred == model["langs"][int(np.argmax(s))] and r.score == pytest.approx(max(e) / sum(e), abs=1e-6)


def test_language_of_invalid_utf8_and_of_equal_scores(spark):
    rows = spark.createDataFrame([(1, "ab", "x"), (2, "ab", "w")], "doc_id long, text string, lang string")
    docs = spark.sql("select 1L as doc_id, cast(unhex('61FF62') as string) as text union all select 2L, 'zzz'")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, rows).collect()}
    assert set(got) == {1, 2} and set(got.values()) <= {"w", "x"}
    one = langid.identify(docs, rows.where("lang = 'x'")).collect()
    assert {r.lang_pred for r in one} == {"x"}


def plain_difference(text, dictionaries):
    """Each piece compressed on its own, by plain calls."""
    sizes = []
    for content in dictionaries:
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == bytes.fromhex("37a430ec") else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdCompressionDict(content, dict_type=kind)
        total = 0
        for part in quality.counted(text):
            for at in range(0, len(part), quality.PIECE):
                c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
                total += len(c.compress(part[at : at + quality.PIECE]))
        sizes.append(total)
    return (sizes[1] - sizes[0]) / sum(sizes)


def test_scores_equal_plain_zstandard_calls(spark):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(f"{a} reads the long book of {b}" for a, b in zip(rng.choice(["anna", "ben", "carl"], 9), rng.choice(["rivers", "stars", "roads"], 9)))
    bad = lambda: " ".join(rng.choice(["click", "buy", "now", "win", "$$$", "free"], 70))
    texts = [(i, good() if i % 2 else bad()) for i in range(400)]
    docs = spark.createDataFrame([*texts, texts[3], (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(3, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, "doc_id", "text", "quality", 3000, 65536, 40_000)
    shift, slope = model["weights"]
    by, got = dict(texts), quality.score_quality(docs.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == 403
    for r in got:
        d = plain_difference(by[r.doc_id].encode(), model["dictionaries"]) if by.get(r.doc_id) else 0.0
        assert r.score == pytest.approx(1 / (1 + math.exp(-(shift + slope * d))), abs=1e-9)
    held = [(r.score >= 0.3, r.doc_id % 2 == 1) for r in got if 300 <= r.doc_id < 400]
    assert np.mean([a == b for a, b in held]) > 0.95  # the cut at 0.3 parts the two


def test_calibration_equals_a_plain_search():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.02, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.4 + 90 * x)))).astype(float)
    shift, slope = quality.calibrate(x, y)
    loss = lambda a, b: np.logaddexp(0, -(2 * y - 1) * (a + b * x)).sum()
    best = loss(shift, slope)
    assert all(loss(shift + da, slope + db) >= best - 1e-2 for da in (-0.2, 0, 0.2) for db in (-15, 0, 15))
