"""Landing once and keeping the latest: what is refused, what is read, and what a run that breaks off leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.sources import files
from heliogrid.streaming import landing


def batch(spark, keys, tag="x", kind="long"):
    return spark.createDataFrame([(k, f"{tag}{k}") for k in keys], f"k {kind}, v string")


def rows(spark, path):
    return sorted((r.k, r.v, r.batch) for r in landing.landed(spark, path).collect())


def hashed(df):
    return df.select("k").withColumn("h", F.xxhash64("k"))


def test_bloom_filters_hold_all_keys_and_few_others():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    mine, others = h[:10_000], h[10_000:]
    content = landing.bloom(mine)
    assert landing.passes(content, len(mine), mine).all()
    assert landing.passes(content, len(mine), others).mean() < 0.01
    assert landing.passes(landing.bloom(mine[:1]), 1, mine[:1]).all()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_late_copies_are_refused_across_runs(spark, tmp_path, kind):
    of = lambda ks: [str(k) if kind == "string" else k for k in ks]
    path = str(tmp_path)
    write = landing.land_once(path, "k")
    write(batch(spark, of([1, 2, 2]), kind=kind), 0, "a")
    write(batch(spark, of([2, 3]), "late", kind), 1, "a")
    write(batch(spark, of([*range(5)]) + [None], "other", kind), 0, "b")  # a new checkpoint numbers from 0
    one, two, three, zero, four = of([1, 2, 3, 0, 4])
    assert rows(spark, path) == sorted([(one, "x1", "a-0"), (two, "x2", "a-0"), (three, "late3", "a-1"), (zero, "other0", "b-0"), (four, "other4", "b-0")])
    write(batch(spark, of([1, 2]), kind=kind), 1, "b")  # nothing new
    assert len(rows(spark, path)) == 5


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path)
    write = landing.land_once(path, "k")
    for _ in range(2):
        write(batch(spark, [1, 2]), 0)
    write(batch(spark, [2, 3], "y"), 1)
    write(batch(spark, [2, 3, 4], "z"), 1)
    assert rows(spark, path) == [(1, "x1", "0-0"), (2, "x2", "0-0"), (3, "z3", "0-1"), (4, "z4", "0-1")]


def test_a_new_key_reads_no_key_file_and_a_late_one_reads_one(spark, tmp_path):
    path = str(tmp_path)
    write = landing.land_once(path, "k", keys_per_file=50, fanout=3)
    for n in range(10):
        write(batch(spark, range(1000 * n, 1000 * n + 200, 2)), n)
    index = landing.KeyIndex(spark, f"{path}/index", "k", 50, 3)
    live = index.tiers.live()
    assert len(live) <= 6 and sum(x["keys"] for x in live) == 1000  # ten batches in a few segments
    files_in_all = sum(x["parts"] for x in live)
    assert files_in_all >= 15
    assert index.parts_for(hashed(batch(spark, [10**6, -5]))) == []  # bounds
    inside = index.parts_for(hashed(batch(spark, range(1, 2000, 100))))  # never landed, between those that have
    assert len(inside) <= 2  # filters let few through
    assert len(index.parts_for(hashed(batch(spark, [4100])))) == 1
    every = index.parts_for(hashed(batch(spark, range(0, 9200, 2))))
    assert len(every) == files_in_all
    assert landing.landed(spark, path).count() == 1000


def breaking(monkeypatch, name, after=0):
    """Makes the call of `files` after so many break off."""
    real, left = getattr(files, name), [after]

    def call(*a, **b):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt
        return real(*a, **b)

    monkeypatch.setattr(files, name, call)


def test_a_run_that_breaks_off_before_its_keys_are_listed_has_landed_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = landing.land_once(path, "k")
    write(batch(spark, [1]), 0)
    with monkeypatch.context() as m:
        m.setattr(files.State, "switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write(batch(spark, [1, 2]), 1)
    assert rows(spark, path) == [(1, "x1", "0-0")]
    write(batch(spark, [2, 3], "new"), 0, "fresh")  # another run may land them
    assert rows(spark, path) == [(1, "x1", "0-0"), (2, "new2", "fresh-0"), (3, "new3", "fresh-0")]


def test_a_run_that_breaks_off_before_the_move_is_completed(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = landing.land_once(path, "k")
    write(batch(spark, [1]), 0)
    with monkeypatch.context() as m:
        breaking(m, "move")
        with pytest.raises(KeyboardInterrupt):
            write(batch(spark, [1, 2]), 1)
    write(batch(spark, [2, 3], "new"), 0, "fresh")  # 2 has landed: its keys were listed
    assert rows(spark, path) == [(1, "x1", "0-0"), (2, "x2", "0-1"), (3, "new3", "fresh-0")]
    with monkeypatch.context() as m:  # a batch that had landed runs again and breaks off
        m.setattr(files.State, "switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write(batch(spark, []), 0, "fresh")
    assert rows(spark, path)[-1] == (3, "new3", "fresh-0")


def test_the_snapshot_reads_few_segments_and_survives_a_broken_merge(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    write = landing.upsert_to(path, "k", "n", fanout=3)
    row = lambda keys, n: spark.createDataFrame([(k, n, f"{k}-{n}") for k in keys], "k long, n long, v string")
    state, tiers = {}, files.Tiers(spark, path, 3)
    for n in range(11):
        keys = [n % 4, n % 3, 100 + n]
        state |= {k: n for k in keys}
        if n == 8:  # the third switch of this call would list a merge
            with monkeypatch.context() as m:
                real, calls = files.State.switch, []

                def switch(self, *a):
                    calls.append(1)
                    if len(calls) == 2:
                        raise KeyboardInterrupt
                    return real(self, *a)

                m.setattr(files.State, "switch", switch)
                with pytest.raises(KeyboardInterrupt):
                    write(row(keys, n), n)
        write(row(keys, n), n)
        got = {r.k: (r.n, r.v) for r in landing.snapshot(spark, path, "k", "n").collect()}
        assert got == {k: (n, f"{k}-{n}") for k, n in state.items()}
        assert len(tiers.live()) <= 6
    on_disk = files.names(spark, f"{path}/segments")
    assert len(on_disk) <= 12  # those that merges replaced are gone
    write(row([0], 3), 3)  # an old batch again, merged long ago
    assert {r.k: r.n for r in landing.snapshot(spark, path, "k", "n").collect()} == state


def test_two_writers_of_one_state(spark, tmp_path):
    a, b = (files.State(spark, str(tmp_path)) for _ in range(2))
    assert a.read() == (0, {})
    assert a.switch(0, {"x": 1}) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        b.switch(0, {"x": 2})
    for n in range(1, 6):
        b.switch(n, {"x": n + 1})
    assert a.read() == (6, {"x": 6}) and len(files.names(spark, str(tmp_path))) == 3
    assert files.names(spark, f"{tmp_path}/none") == []
