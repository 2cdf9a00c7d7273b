import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliogrid.llm import common, mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÄß \n\t\x0b\x1f\xa0é", max_size=60))
def test_words_are_those_of_the_pattern(text):
    h, s, e = common.word_hashes(text.encode(), True)
    raw = text.encode()
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), raw[a:b].decode()) for a, b in zip(s, e)]
    assert found == words(text)
    by_word = {}
    for w, x in zip(found, h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    assert mixing.count_words(text.encode()) == len(found)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("alpha beta " * 400 + "x" * 500 + " gamma").encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "BLOCK", 64)
    monkeypatch.setattr(mixing, "BLOCK", 64)
    assert (common.word_hashes(text) == whole).all()
    assert mixing.count_words(text) == len(whole) == 802


def test_shingles_of_short_texts():
    assert len(common.shingles(common.word_hashes(b""))) == 0
    a, b = (common.shingles(common.word_hashes(t)) for t in (b"one two", b"ONE  two"))
    assert len(a) == 1 and (a == b).all()
    assert len(np.intersect1d(a, common.shingles(common.word_hashes(b"one two three")))) == 0


def test_stretches_name_runs_of_words():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 400).astype(np.uint64) + np.uint64(1 << 40)
    for k in (1, 4, 90):
        h, names = common.stretches(w, k), {}
        assert len(h) == 400 - k + 1
        for i, x in enumerate(h.tolist()):
            assert names.setdefault(x, tuple(w[i : i + k])) == tuple(w[i : i + k])
        assert len(names) == len(set(names.values()))
    assert len(common.stretches(w[:3], 4)) == 0


@pytest.mark.parametrize("edges, expected", [([], {}), ([(1, 2), (2, 3), (9, 8), (8, 8)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(k, k + 1) for k in range(30)], {k: 0 for k in range(31)})])
def test_components(spark, edges, expected):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in common.components(df).collect()} == expected
