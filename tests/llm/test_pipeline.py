import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest

from heliogrid.llm import quality

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def grams(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


def test_quality_stage_keeps_the_scores_above_the_limit(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 != 0")
    scores = {r.doc_id: r.score for r in quality.score_quality(small, labels).collect()}
    kept = {r.doc_id for r in cp.quality_classifier(spark, small, SMALL).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}


def test_line_stage_by_brute_force(spark, small):
    rows = small.collect()
    pages, n = Counter(r.source for r in rows), defaultdict(Counter)
    trim = lambda line: line.strip(" \t\r")
    for r in rows:
        n[r.source].update({trim(x) for x in (r.text or "").split("\n")} - {""})
    want = {}
    for r in rows:
        own = (r.text or "").split("\n")
        kept = [x for x in own if not trim(x) or not (n[r.source][trim(x)] >= 3 and n[r.source][trim(x)] > 0.05 * pages[r.source])]
        kept = kept if any(trim(x) for x in kept) else own
        text = None if r.text is None else "\n".join(kept)
        want[r.doc_id] = (text, r.n_chars if text == r.text else len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, small, SMALL).collect()} == want


def test_near_duplicate_stage_by_all_pairs(spark, small, union):
    sets = {r.doc_id: grams(r.text) for r in small.collect()}
    u, ids = union(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                u.join(a, b)
    assert {r.doc_id for r in cp.near_dedup(spark, small, SMALL).collect()} == {i for i in ids if u.find(i) == i}


def test_decontamination_stage_by_plain_search(spark, small):
    """Held against exact runs: what holds half of an item in one run goes, what shares no five words with any stays."""
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in cp.benchmark_decontamination(spark, small, SMALL).collect()}
    for r in small.collect():
        own, w = grams(r.text), " ".join(words(r.text))
        if any(f" {' '.join(p[k : k + -(-len(p) // 2)])} " in f" {w} " for p in items for k in range(len(p) // 2 + 1)):
            assert r.doc_id not in kept
        elif not any(own & grams(" ".join(p)) for p in items):
            assert r.doc_id in kept


def test_mixing_stage_totals(spark, small):
    rows, source = cp.source_mixing(spark, small, SMALL).collect(), {r.doc_id: r.source for r in small.collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert len(rows) == len(source) and all(abs(taken[s] - target[s]) <= largest[s] for s in target)


def test_stages(spark, tmp_path):
    """Each stage on all that its predecessor kept, with decisions that take effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    counts, columns = [docs.count()], docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
        counts.append(docs.count())
        if name != "mixing sources":
            assert docs.columns == columns
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] == counts[5]
    leaks = cp.decontaminate.contaminated(spark.read.parquet(str(tmp_path / "3")), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert leaks.count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good)


def test_near_dedup_stage_cases(spark):
    rows = [(2, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (3, None, None, None, None), (4, None, None, None, None), (None, "a b c d e f g", "en", "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == [1, 3, 4, None]
    assert cp.near_dedup(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_take_clashing_columns(spark, stage):
    clash = "score long, n_lines string, n_dropped string, kept string, component_id string, coverage string, size string, taken string, id string, h string, bands string, source_size string"
    rows = [(i, f"w{i} " * 9, "en", "s", 20, *[None] * 12) for i in (1, 2, 2, 3)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    out = stage(spark, docs, SF)
    assert out.count() <= 4 and (stage is cp.source_mixing or out.columns == docs.columns)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_take_empty_tables_and_nulls(spark, stage):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (3, "word " * 60000, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert stage(spark, docs, SF).count() <= 3
