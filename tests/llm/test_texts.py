import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from heliogrid.llm import decontaminate, langid, lines, mixing, pii, quality, queries, substrings, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    columns = list(rel.columns)
    got = queries.QUERIES[name](spark, sf).select(columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rel.fetchall()))


def test_line_dedup_cases(spark):
    rows = [(i, f"Menu \nbody {i}\n\n menu", "en", "a", 1) for i in range(20)]
    rows += [(100 + i, "Menu", "en", "a", 1) for i in range(5)]  # nothing but boilerplate
    rows += [(200, None, "en", "a", 1), (201, "", "en", "a", 1), (202, "Menu\nx", "en", None, 1), (203, "Menu\ny", "en", None, 1), (204, "z\n" * 50000, "en", "b", 1)]
    rows += [(300, "once\nall", "en", "c", 1)] * 4  # repeated rows are pages
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("old")).withColumn("n_dropped", F.lit("old"))
    for keep in (False, True):
        got = {r.doc_id: r for r in lines.drop_boilerplate(df, keep_pages=keep).collect()}
        assert got[3].text == "body 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)  # the blank line stays
        assert (got[100].text, got[100].n_dropped) == (("Menu", 0) if keep else ("", 1))
        assert (got[300].text, got[300].n_dropped) == (("once\nall", 0) if keep else ("", 2))
        assert got[200].text is None and got[200].n_lines == 0 and got[201].text == ""
        assert got[202].text == "Menu\nx"  # two pages are too few
        assert got[204].n_lines == 50001 and got[204].n_dropped == 0


def test_line_dedup_without_broadcast(spark):
    df = spark.createDataFrame([(i, f"Menu\nbody {i}", "en", "a", 1) for i in range(30)] + [(99, "Menu\nx", "en", None, 1)], DOCS)
    a, b = (sorted(map(tuple, lines.drop_boilerplate(df, broadcast_lines=n, max_hosts=n).collect())) for n in (500_000, -1))
    assert a == b and [r[1] for r in a if r[0] == 5] == ["body 5"]
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_language_of_held_out_rows(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_cases(spark):
    rows = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    train = spark.createDataFrame([(2 * i, t, lang) for i, t, lang in rows] + [(None, "x", "fr"), (7, None, "fr"), (8, "x", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, "der hund", 1), (2, None, 1), (3, "", 1), (4, "12 !?", 1), (5, "the dog " * 50000, 1), (None, "the", 1)], "doc_id long, text string, score int")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, train).collect()}
    assert got == {1: "de", 2: "und", 3: "und", 4: "und", 5: "en", None: "en"}
    assert {r.lang_pred for r in langid.identify(docs, train.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), train).count() == 0


def test_ngrams_of_pieces(monkeypatch):
    text = "Straße übers Meer " * 20
    whole = langid.counts(text, 15)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert all((a == b).all() for a, b in zip(whole, langid.counts(text, 15)))


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    s = rng.standard_normal((4000, 3))
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(4 * s, y) - 4) < 0.6


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i} x\r\n", f"<p>{i % 7}</p>" if i % 3 else None, "q") for i in range(60)] + [(60, None, "é" * 300000, "q"), (None, "u", "<p>1</p>", "q"), (59, "again", "<p>3</p>", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    folder = str(tmp_path / "w")
    index = warc.write_bundles(df, folder, frame_bytes=500, bundle_bytes=2000)
    rows = warc.read_records(index, folder, with_payload=True).collect()
    last = {}
    for i, _, html, _ in pages:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", -1))
    assert len(rows) == len(pages)
    want = {i: html or "" for i, _, html, _ in pages}
    for r in rows:
        body = want[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        top = last[want[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    files = list((tmp_path / "w").iterdir())
    assert len(files) > 3
    assert [(r.record_type, r.refers_to) for r in rows if r.page_id == 59] == [("response", None)] * 2  # the largest id, twice
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read() for f in files)
    assert whole.count(b"WARC/1.1\r\n") == len(pages)  # a plain reader can read the bundles too
    assert warc.read_records(warc.write_bundles(df.limit(0), folder), folder).count() == 0


def brute_pii(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        q = [int(c) for c in d[::-1]]
        if 16 <= len(d) <= 19 and (sum(q[::2]) + sum(sum(divmod(2 * v, 10)) for v in q[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns(texts):
    rng = random.Random(1)
    random_texts = ["".join(rng.choice("a1.2@-+ 3(_9é") for _ in range(rng.randint(0, 70))) for _ in range(4000)]
    for t in [*texts.values(), *random_texts, "4539 1488 0343 6467", "١@a.b", "a@b.c_d@e.f", "000255.1.1.1 1.2.3.4.5.6.7.8"]:
        assert pii.base_spans(t or "") == brute_pii(t or "")
    assert pii.base_spans("1" * 300000 + "@" + "a" * 300000) == []


def test_op5_query(spark, sf, texts):
    for r in queries.op5_pii(spark, sf).collect():
        base = brute_pii(texts[r.doc_id] or "")
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, *_ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest() and r.spans.startswith(named)


def term_list(t):
    return [(m[0].lower() if m[0].isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), m[0]), *m.span(), m[0]) for m in re.finditer("[0-9A-Za-z\u0080-\U0010ffff]+", t)]


def class_of(word):
    digits = [c.isascii() and c.isdigit() for c in word]
    return "number" if all(digits) else "code" if any(digits) else "name" if "A" <= word[0] <= "Z" else "word"


def brute_disclosure(all_texts, window, min_texts):
    """PMI / IC by counting over the distinct texts."""
    distinct = set(all_texts)
    both, of_entity, of_term = Counter(), Counter(), Counter()
    for t in (x or "" for x in distinct):
        base = brute_pii(t)
        free = [x for x in term_list(t) if not any(s < x[2] and x[1] < e for _, s, e in base)]
        of_term.update({x[0] for x in term_list(t)} | {("class", class_of(x[3])) for x in term_list(t)})
        near = defaultdict(set)
        for kind, s, e in base:
            value = (kind, t[s:e].lower() if kind < 2 else re.sub("[^0-9]", "", t[s:e]))
            at = sum(x[1] < s for x in free)
            around = free[max(0, at - window) : at + window]
            near[value] |= {x[0] for x in around} | {("class", class_of(x[3])) for x in around}
        for value, found in near.items():
            of_entity[value] += 1
            both.update((value, x) for x in found)
    n, best = len(distinct), {}
    for (value, term), k in both.items():
        if k >= min_texts and of_entity[value] < n:
            d = math.log2(n * k / (of_term[term] * of_entity[value])) / math.log2(n / of_entity[value])
            best[term] = max(d, best.get(term, d))
    return best


def hold_against_brute_force(rows, got, best, generalise_at):
    """How many terms were generalised and removed, each asserted."""
    by, some = dict(rows), Counter()
    assert len(got) == len(rows)
    for r in got:
        t = by[r.doc_id] or ""
        base = brute_pii(t)
        want = {"generalised": [], "removed": []}
        for word, s, e, raw in term_list(t):
            d = best.get(word, -9)
            if d >= generalise_at - 1e-12 and not any(a < e and s < b for _, a, b in base):
                gone = d >= 0.99 or best.get(("class", class_of(raw)), -9) >= generalise_at
                want["removed" if gone else "generalised"].append(f"{'removed' if gone else 'generalised'}:{s}:{e}")
        spans = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base] + want["generalised"] + want["removed"]
        assert r.spans == ",".join(spans) and (r.n_generalised, r.n_removed) == tuple(map(len, want.values()))
        some.update({k: len(v) for k, v in want.items()})
    return some


def test_op5_disclosure_against_brute_force(spark, texts):
    """Which terms are generalised and removed, over sf0.001 with planted people, broadcast and shuffled."""
    rng = random.Random(3)
    rows = list(texts.items())
    for k in range(12):
        for j in range(3):
            rows.append((10_000 + 3 * k + j, f"Zorro{k} of vega{k} wrote p{k}@x.org on {rng.randrange(10**6)} in room {900 + k} {rows[j + 7][1]}"))
    rows += [(20_000, "late came zorro3 alone"), (20_001, rows[-2][1]), (20_002, None), (None, rows[-3][1])]
    best = brute_disclosure([t for _, t in rows], 10, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for max_rows in (500_000, 0):
        some = hold_against_brute_force(rows, pii.sanitise(df, window=10, min_texts=2, generalise_at=0.95, max_rows=max_rows).collect(), best, 0.95)
        assert some["removed"] > 30


@pytest.mark.parametrize("generalise_at", [0.9, 0.8])
def test_op5_disclosure_on_the_table_as_it_is(spark, texts, generalise_at):
    """Nothing planted, whole texts: terms of entities that one text has."""
    rows = list(texts.items())
    best = brute_disclosure([t for _, t in rows], 10**9, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = hold_against_brute_force(rows, pii.sanitise(df, generalise_at=generalise_at).collect(), best, generalise_at)
    assert some["removed"] > 0 and (generalise_at > 0.86 or some["generalised"] > 0)


def test_op5_reads_invalid_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('C3A9FF20') || cast('a@b.org now' as binary) as string) as text")
    (row,) = pii.sanitise(df).collect()
    assert row.n_email == 1 and row.spans.startswith("email:3:10") and "[EMAIL]" in row.sanitised


def test_op5_cases(spark):
    rows = [(i, f"über Zorro Vega writes zv@x.org today number {i}", 1) for i in range(6)]
    rows += [(100 + i, f"Quiet today the number {i} writes nothing", 1) for i in range(60)] + [(300, "a Vega of 1", 1)]
    rows += [(200, "später kam Zorro allein, Vega", 1), (201, None, 1), (202, "", 1), (203, "zv@x.org " * 30000, 1), (None, "kam Zorro", 1), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.sanitise(df, generalise_at=0.8).collect()}
    assert got[0].spans.startswith("email:23:31") and "Zorro" not in got[200].sanitised and "[NAME]" in got[200].sanitised
    assert "today" in got[0].sanitised and "[EMAIL]" in got[0].sanitised and got[100].spans == ""
    assert got[201].spans == "" and got[201].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].spans
    assert pii.sanitise(df.limit(0)).count() == 0


def test_op7_finds_planted_passages(spark):
    rng = random.Random(2)
    text = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    passage, fuzzy = text(70, "p"), text(80, "f")
    edited = [w if k % 15 else "edit" for k, w in enumerate(fuzzy)]
    same = " ".join(text(90, "s"))
    docs = {1: text(100, "a") + passage + text(50, "b"), 2: passage + text(30, "c"), 3: text(40, "d") + fuzzy, 4: edited + text(60, "e"), 5: text(300, "g"), 6: text(60, "h") + passage[:30], 9: text(20, "i") + passage}
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(7, same), (8, same), (8, same), (10, None), (11, ""), (12, "la " * 50000), (None, same)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, seed int")
    found = substrings.repeated_passages(df).collect()
    links = {frozenset((r.doc_id, r.partner_id)) for r in found}
    assert {x for pair in links for x in pair} == {1, 2, 3, 4, 7, 8, 9}
    assert frozenset((3, 4)) in links and frozenset((7, 8)) in links and len([p for p in links if p <= {1, 2, 9}]) >= 2
    for r in found:
        if {r.doc_id, r.partner_id} <= {1, 2, 9}:
            place = {1: (100, 170), 2: (0, 70), 9: (20, 90)}
            assert (r.start_word, r.end_word) == place[r.doc_id] and (r.partner_start, r.partner_end) == place[r.partner_id] and r.identity == 1
    assert substrings.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("query_sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op7_against_a_brute_force_index(spark, union, query_sf):
    """Every document that shares a run of 50 words with a different text has a row, and passages connect
    (at least 99 % of) all pairs that share one, in groups of every size."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{query_sf}/documents.parquet").collect()}
    holders, first = defaultdict(set), {}
    for i, t in sorted(texts.items()):
        if t and t not in first:
            first[t] = i
            w = words(t)
            for run in {tuple(w[k : k + 50]) for k in range(len(w) - 49)}:
                holders[run].add(i)
    rows = queries.op7_substring_dedup(spark, query_sf).collect()
    u = union(set(texts))
    for r in rows:
        u.join(r.doc_id, r.partner_id)
    shared = {tuple(sorted(ids)) for ids in holders.values() if len(ids) > 1}
    seen = {x for r in rows for x in (r.doc_id, r.partner_id)}
    assert shared and {x for ids in shared for x in ids} <= seen
    pairs = {(a, b) for ids in shared for k, b in enumerate(ids) for a in ids[:k]}
    assert sum(u.find(a) == u.find(b) for a, b in pairs) >= 0.99 * len(pairs)
    for r in rows:  # every row is a passage: so many words match in order
        a, b = words(texts[r.doc_id])[r.start_word : r.end_word], words(texts[r.partner_id])[r.partner_start : r.partner_end]
        assert max(len(a), len(b)) >= 50 and r.n_matched >= 0.8 * max(len(a), len(b)) and len(Counter(a) & Counter(b)) > 0
        assert sum((Counter(a) & Counter(b)).values()) >= r.n_matched


def test_op7_rows_that_repeat_an_id(spark):
    """Each text of an id counts; equal rows count once."""
    rng = random.Random(12)
    p, a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(70)] for x in "pab")
    df = spark.createDataFrame([(1, " ".join(a + p)), (1, "zzz " + " ".join(a[:9])), (2, " ".join(p + b)), (2, " ".join(p + b))], "doc_id long, text string")
    got = substrings.repeated_passages(df).collect()
    assert [{r.doc_id, r.partner_id} for r in got] == [{1, 2}] and got[0].n_matched == 70


def test_op7_fuzzy_recall(spark):
    """Passages of 80 words with replaced words at random places, one pair of texts each; measured, not exact."""
    rng = random.Random(21)
    rows, fresh = [], lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for k in range(60):
        passage = fresh(80)
        edited = list(passage)
        for at in rng.sample(range(80), 6):
            edited[at] = "edit"
        rows += [(2 * k, " ".join(fresh(30) + passage + fresh(20))), (2 * k + 1, " ".join(fresh(10) + edited + fresh(40)))]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    links = {frozenset((r.doc_id, r.partner_id)) for r in got}
    assert sum(frozenset((2 * k, 2 * k + 1)) in links for k in range(60)) >= 54 and all(min(x) // 2 == max(x) // 2 for x in links)


def test_chains_are_best():
    """Against the plain quadratic recurrence."""
    rng = random.Random(5)
    for _ in range(200):
        runs = sorted({(rng.randrange(40), rng.randrange(40), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))})
        best = {}
        for i, j, n in runs:
            ahead = [best[u] - substrings.GAP_COST * (i - u[0] - u[2] + j - u[1] - u[2]) for u in best if u[0] + u[2] <= i and u[1] + u[2] <= j]
            best[i, j, n] = n + max([0, *ahead])
        chain = substrings.chains(runs)[0]
        score = sum(n for _, _, n in chain) - sum(substrings.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(chain, chain[1:]))
        assert score == pytest.approx(max(best.values()))


def numbered(rng, n):
    return np.array([rng.randrange(2**63) for _ in range(n)], np.uint64)


def test_parts_of_a_chain_of_low_identity():
    """Two exact passages with other words between them, in both texts."""
    rng = random.Random(7)
    for size, gap in ((60, 36), (60, 57), (100, 60), (100, 95)):
        p, q = numbered(rng, size), numbered(rng, size)
        a, b = (np.concatenate([numbered(rng, lead), p, numbered(rng, gap), q]) for lead in (5, 30))
        got = sorted(substrings.passages(a, b, 4, 50, 0.8))
        assert got == [(5, 5 + size, 30, 30 + size, size, 1.0), (5 + size + gap, 5 + 2 * size + gap, 30 + size + gap, 30 + 2 * size + gap, size, 1.0)]
    a, b = (np.concatenate([p, numbered(rng, 20), q]) for _ in range(2))
    assert list(substrings.passages(a, b, 4, 50, 0.8)) == [(0, 220, 0, 220, 200, 200 / 220)]



def test_places_of_text_that_repeats():
    """Nine copies of a text, and in one document its first half once more at the front."""
    rng = random.Random(8)
    licence = numbered(rng, 60)
    copies = [np.concatenate([x for _ in range(9) for x in (licence, numbered(rng, 20))]) for _ in range(2)]
    a, b = np.concatenate([licence[:30], numbered(rng, 20), copies[0]]), copies[1]
    found = list(substrings.passages(a, b, 4, 50, 0.8))
    for text, side, start in ((a, 0, 50), (b, 2, 0)):
        held = np.zeros(len(text), bool)
        for f in found:
            held[f[side] : f[side + 1]] = True
        assert all(held[start + 80 * c : start + 80 * c + 60].all() for c in range(9))
    exact = np.concatenate([numbered(rng, 5), np.tile(licence[:3], 2000), licence, licence[:40]])
    found = list(substrings.passages(exact, np.concatenate([np.tile(licence[:3], 900), numbered(rng, 80), licence]), 4, 50, 0.8))
    assert (6005, 6065, 2780, 2840) in [f[:4] for f in found] and len(found) < 10


def test_longest_places_by_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        a, b = (np.array([rng.randrange(3) for _ in range(rng.randrange(1, 30))], np.uint64) for _ in range(2))
        i, j = substrings.longest_places(a, b)
        assert (a[i] == b[j]).all()
        runs = substrings.common_runs(*np.unique(np.stack([i, j]), axis=1), 1) if len(i) else []
        for side, (x, y) in enumerate(((a, b), (b, a))):
            longest = np.zeros(len(x), int)
            for s in range(len(x)):
                for t in range(len(y)):
                    n = 0
                    while s + n < len(x) and t + n < len(y) and x[s + n] == y[t + n]:
                        n += 1
                    longest[s : s + n] = np.maximum(longest[s : s + n], n)
            got = np.zeros(len(x), int)
            for r in runs:
                got[r[side] : r[side] + r[2]] = np.maximum(got[r[side] : r[side] + r[2]], r[2])
            assert (got == longest).all()



def plain_tiles(p, t, k):
    """Greedy string tiling by its definition."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return tiles
        for x in range(n):
            mp[i + x] = mt[j + x] = True
        tiles.append((i, j, n))


def test_tiles_against_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ([rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        items = decontaminate.Items([(0, " ".join(p).encode())], 3)
        got = dict(items.tiles(decontaminate.word_hashes(" ".join(t).encode()))).get(0, [])
        want = plain_tiles(p, t, min(3, len(p)))
        assert got == (want if len(p) >= 3 else want[:1])


def test_tiles_of_a_text_that_repeats_one_word():
    """Memory grows with the number of diagonals, not with text times item."""
    items = decontaminate.Items([(0, b"la " * 400)], 5)
    (item, tiles), = items.tiles(decontaminate.word_hashes(b"la " * 200_000))
    assert item == 0 and tiles == [(0, 0, 400)]


def test_op8_cases(spark, sf, texts):
    bench = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for i, t in texts.items():
        w = words(t)
        for item, p in bench.items():
            size = min(5, len(p))
            if size and {tuple(p[k : k + size]) for k in range(len(p) - size + 1)} & {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}:
                if sum(n for *_, n in plain_tiles(p, w, size)) >= 0.5 * len(p):
                    want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_decontamination(spark, sf).collect()}
    assert got == want and want
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zeta eta theta iota kappa x ALPHA beta gamma delta epsilon", 1), (2, "alpha beta gamma", 1), (3, None, 1), (4, "", 1), (5, "noise " * 50000 + item, 1), (6, "just TWO words here", 1), (6, "just TWO words here", 1), (None, item, 1)], "doc_id long, text string, coverage int")
    for block in (1_000_000, 8):  # at once, and in blocks
        rows = decontaminate.contaminated(docs, b, block_words=block).collect()
        want = [(1, 1, 1.0, 2), (5, 1, 1.0, 1), (1, None, 1.0, 2), (5, None, 1.0, 1), (6, 4, 1.0, 1), (6, 4, 1.0, 1), (None, 1, 1.0, 1), (None, None, 1.0, 1)]
        assert sorted(((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in rows), key=str) == sorted(want, key=str)
    assert decontaminate.contaminated(docs, b.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), b).count()


def test_op8_seed_join_gives_the_same(spark, sf):
    """Random texts of few words, with phrases that most items and texts share, and the given tables: the shuffle on
    seeds against the broadcast benchmark, whatever the coverage asked for."""
    rng = random.Random(6)
    phrase = "all rights are reserved by the owner of this page today"
    word = lambda: rng.choice(["ka", "lo", "mi", "nu", "Pe", "ro"])
    items = [(i, " ".join([phrase] * (i % 3 > 0) + [word() for _ in range(rng.randrange(1, 40))])) for i in range(60)]
    items += [items[3], (None, items[4][1]), (90, "la " * 30), (91, phrase)]
    texts = []
    for i in range(150):
        parts = [phrase] * (i % 2) + [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            own = rng.choice(items)[1].split()
            at = rng.randrange(len(own))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(own[at : at + rng.randrange(1, 30)]))
        texts.append((i, " ".join(parts)))
    texts += [texts[5], (900, "la " * 3000), (901, None), (902, ""), (None, items[0][1])]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for coverage in (0.3, 0.5, 1.0):
        whole, joined = (sorted(map(str, decontaminate.contaminated(d, b, min_coverage=coverage, block_words=n).collect())) for n in (10**6, 0))
        assert whole == joined and whole
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole, joined = (sorted(map(str, decontaminate.contaminated(d, b, block_words=n).collect())) for n in (10**6, 0))
    assert whole == joined and whole


def expected_targets(size, share=1.5):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, held = {}, set()
    while True:
        rest = share * sum(size.values()) - sum(2 * size[s] for s in held)
        total = sum(weight[s] for s in names if s not in held)
        target = {s: 2 * size[s] if s in held else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in held and target[s] > 2 * size[s]}
        if not over:
            return target
        held |= over


def test_op9_targets_and_balance(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    a = queries.op9_source_mixing(spark, sf).collect()
    b = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet").repartition(5)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    size, taken, largest = Counter(), Counter(), Counter()
    for r in a:
        d = docs[r.doc_id]
        assert r["size"] == len(words(d.text)) and 0 <= r.taken <= 2 * r["size"]
        size[d.source] += r["size"]
        taken[d.source] += r.taken
        largest[d.source] = max(largest[d.source], r["size"])
    want = expected_targets(size)
    for r in a:
        s = docs[r.doc_id].source
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)


def test_op9_cases(spark):
    rows = [(i, "w " * (1 + i % 13), "a" if i < 900 else None if i < 960 else "b") for i in range(1000)] + [(2000, None, "c"), (2001, "", "c"), (2002, "x", "b"), (2002, "x", "b"), (None, "y z", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, rank int")
    got = mixing.mix_sources(df, block=64).collect()  # blocks of blocks
    assert len(got) == len(rows)
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r.source_size][0] += r.taken
        per[r.source_size][1] = r.target
    assert all(abs(t - want) <= 13 for t, want in per.values()) and per[0] == [0, 0.0]
    assert sorted(map(tuple, mixing.mix_sources(df, block=64, max_sources=0).collect()), key=str) == sorted(map(tuple, got), key=str)  # salted
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(df.where("source = 'c'")).collect()} == {0}


def test_op9_equal_rows_are_told_apart(spark):
    """Equal rows in many chunks and blocks, and a few others."""
    df = spark.range(9000).selectExpr("cast(null as long) id", "'s' source", "5L size").unionByName(spark.createDataFrame([(1, "t", 2), (1, "t", 2), (1, None, 2)], "id long, source string, size long"))
    got = mixing.numbered(df, 7, chunk=1000).collect()
    assert len(got) == 9003 and len({r.h for r in got if r.id is None}) == 9000
    docs = df.select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(size))").alias("text"), "source")
    rows = [r for r in mixing.mix_sources(docs, block=512).collect() if r.source_size == 45000]
    assert len(rows) == 9000 and abs(sum(r.taken for r in rows) - rows[0].target) <= 5


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 3000), np.full(3000, 0.37)
    q = mixing.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    ones = np.mean([mixing.land(size[:40], mixing.flight(size[:40], p[:40], rng)) for _ in range(600)], axis=0)
    assert abs(ones.mean() - 0.37) < 0.02 and ones.min() > 0.2 and ones.max() < 0.55


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has too few bad labels to learn from
    rows = {r.doc_id: r for r in queries.op10_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out and 0 <= rows[i].score <= 1 and rows[i].predicted == (rows[i].score >= 0.3) for i in held)
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, ("clean words flow here " if i % 2 else "BUY!! NOW!! ") * (3 + i % 5), 7.0) for i in range(80)] + [(100, None, 1.0), (101, "", 1.0), (102, "clean words flow " * 40000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert got[1] > 0.8 > 0.2 > got[2] and got[100] == got[101] and 0 <= got[100] <= 1
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_op7_pairs_of_frequent_seeds(spark, union):
    """Pairs that neither the first nor the last holder of their seeds has a passage with: runs of
    50 words of which many other texts hold 40, and two lines of many texts amid edits."""
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, lines, other = fresh(50), [fresh(24), fresh(24)], fresh(60)
    for every in (2, 40):  # few holders, many holders
        texts = [fresh(20) + p[:40] + fresh(20) for _ in range(every)] + [fresh(20) + p[10:] + fresh(20) for _ in range(every)]
        texts += [fresh(10) + p + fresh(30), fresh(30) + p + fresh(10), fresh(5) + p + fresh(5)]
        texts += [lines[0] + fresh(40) + lines[1] for _ in range(every)]
        texts += [fresh(9) + lines[0] + fresh(3) + lines[1] + fresh(9), fresh(20) + lines[0] + fresh(3) + lines[1] + fresh(20)]
        texts += [fresh(5) + other + fresh(n) for n in (5, 6, 7, 8)]
        rng.shuffle(texts)
        words_ = [np.array([hash(w) for w in t], np.int64).view(np.uint64) for t in texts]
        want = {(i, j) for j in range(len(texts)) for i in range(j) if next(substrings.passages(words_[i], words_[j], 4, 50, 0.8), None)}
        rows = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
        got = {tuple(sorted((r.doc_id, r.partner_id))) for r in rows}
        u, v = union(range(len(texts))), union(range(len(texts)))
        for pairs, to in ((want, u), (got, v)):
            for i, j in pairs:
                to.join(i, j)
        assert len(want) == 10 and got <= want and [u.find(i) for i in range(len(texts))] == [v.find(i) for i in range(len(texts))]
        assert every > 2 or got == want
        assert all(r.class_id == u.find(r.doc_id) for r in rows)


def test_op7_bound_on_covered_words():
    rng = random.Random(33)
    for _ in range(50):
        a, b = ([np.array([rng.randrange(9) for _ in range(rng.randrange(60))], np.uint64) for _ in range(4)] for _ in range(2))
        bound = substrings.covered_words(a, b, 4)
        for i, j in np.ndindex(4, 4):
            seen = {tuple(b[j][y : y + 4]) for y in range(len(b[j]) - 3)}
            assert bound[i, j] >= len({x + z for x in range(len(a[i]) - 3) if tuple(a[i][x : x + 4]) in seen for z in range(4)})


def test_op7_groups_of_a_line_propose_few_pairs():
    """400 texts with the same two lines far apart: their pairs cover enough words for a passage, but in no chain."""
    rng = random.Random(35)
    lines, texts = [numbered(rng, 14) for _ in range(2)], []
    for _ in range(400):
        texts.append(np.concatenate([numbered(rng, 10), lines[0], numbered(rng, 120), lines[1], numbered(rng, 10)]))
    p = numbered(rng, 60)
    for _ in range(3):
        texts.append(np.concatenate([lines[0], numbered(rng, 30), p, numbered(rng, 90), lines[1]]))
    side, component = np.repeat([0, 1], len(texts)), np.tile(np.arange(len(texts)), 2)
    x, y = substrings.possible_pairs(texts * 2, side, component, 4, *substrings.least_cover(4, 50, 0.8))
    pairs = set(zip(x.tolist(), (y - len(texts)).tolist()))
    assert {(i, j) for i in range(400, 403) for j in range(400, 403) if i != j} <= pairs and len(pairs) < 100


def test_op7_bounds_lose_no_passage(monkeypatch):
    """Texts of few words, pieces of others and repeats: no pair with a passage is left out, and no passage."""
    rng = random.Random(36)
    pieces = [numbered(rng, n) for n in (12, 20, 30, 45, 55, 80)] + [np.tile(numbered(rng, n), 40 // n) for n in (1, 2, 7)]
    for _ in range(12):
        texts = []
        for _ in range(14):
            text = []
            for piece in rng.sample(pieces, 4):
                piece = piece.copy()
                for at in range(len(piece)):
                    if rng.random() < 0.06:
                        piece[at] = rng.randrange(2**63)
                text += [piece, numbered(rng, rng.randrange(25))]
            texts.append(np.concatenate(text))
        n = len(texts)
        found = {(i, j): list(substrings.passages(texts[i], texts[j], 4, 50, 0.8)) for i in range(n) for j in range(n) if i != j}
        x, y = substrings.possible_pairs(texts * 2, np.repeat([0, 1], n), np.tile(np.arange(n), 2), 4, *substrings.least_cover(4, 50, 0.8), rare=rng.choice([1, 3, 8]))
        proposed = set(zip(x.tolist(), (y - n).tolist()))
        with monkeypatch.context() as free:
            free.setattr(substrings, "may_chain", lambda *_: True)
            free.setattr(substrings, "equal_words", lambda *_: 10**6)
            assert found == {(i, j): list(substrings.passages(texts[i], texts[j], 4, 50, 0.8)) for i, j in found}
        assert {z for z, rows in found.items() if rows} <= proposed and any(found.values())


@pytest.mark.parametrize("block", [8, 1024])
def test_op7_all_pairs_of_frequent_seeds_have_rows(spark, monkeypatch, block):
    """40 texts of one class, by a passage that all hold, of which each also has an edited copy of one of two
    others, held by 20: every pair has its rows, whatever else connects it, by lists or blocks of any size."""
    rng = random.Random(37)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, others, cells = fresh(55), [fresh(90), fresh(90)], substrings.frequent_cells
    monkeypatch.setattr(substrings, "frequent_cells", lambda *a: cells(*a, block=block))
    texts = []
    for n in range(40):
        edited = [w if rng.random() > 0.02 else f"edit{n}" for w in others[n % 2]]
        texts.append(fresh(rng.randrange(9)) + p + fresh(120) + edited + fresh(rng.randrange(9)))
    words_ = [np.array([hash(w) for w in t], np.int64).view(np.uint64) for t in texts]
    want = {frozenset((i, j)): len(list(substrings.passages(words_[i], words_[j], 4, 50, 0.8))) for j in range(40) for i in range(j)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for all_pairs in (4, 32):
        got = Counter(frozenset((r.doc_id, r.partner_id)) for r in substrings.repeated_passages(df, all_pairs=all_pairs).collect())
        assert got == want and sorted(set(want.values())) == [1, 2]
