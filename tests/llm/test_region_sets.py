"""Rounds of op 7 read the sets of their own points, and only sets that a pair names are shuffled to measure it."""

import numpy as np
import pyarrow as pa

from prefmill.llm import ngram_join, setjoin


def _table(spark, sets):
    rows = [(k, len(s), setjoin.signature(s), s.tobytes()) for k, s in enumerate(sets)]
    return spark.createDataFrame(pa.table({"id": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int32()), "sig": [r[2] for r in rows], "s": [r[3] for r in rows]}))


def test_rounds_read_fewer_sets(spark, monkeypatch):
    """Nine in ten of the points are copies but for one hash and leave in the first round; the others need another."""
    near = [np.array([1, *range(1000, 1030), 5000 + k], np.uint64) for k in range(180)]
    apart = [np.array([1, *range(100_000 + 100 * k, 100_000 + 100 * k + 20)], np.uint64) for k in range(20)]
    sets = _table(spark, near + apart)
    met = spark.createDataFrame([(7, k, len(s), 0, 1.0 / (k + 1)) for k, s in enumerate(near + apart)], "h long, point long, n int, pos int, share double")
    given, overlaps = [], setjoin.overlaps
    monkeypatch.setattr(setjoin, "overlaps", lambda pairs, some: given.append(some.count()) or overlaps(pairs, some))
    links, _ = ngram_join.regions(spark, met, sets, small=2)
    assert links.count() == 179
    assert len(given) > 1 and given[0] == 200 and max(given[1:]) <= 20


def test_only_named_sets_are_shuffled(spark):
    sets = _table(spark, [np.arange(k, k + 40, dtype=np.uint64) for k in range(300)])
    pairs = spark.createDataFrame([(3, 5), (3, 90)], "a long, b long")
    for make in (setjoin.overlaps, setjoin.verify):
        df = make(pairs, sets)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") >= 2 and plan.count("strategy=broadcast") >= 2
        assert {(r["a"], r["b"]) for r in df.collect()} == ({(3, 5), (3, 90)} if make is setjoin.overlaps else {(3, 5)})


def test_many_ids(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "PICKED", 1)
    sets = _table(spark, [np.arange(k, k + 40, dtype=np.uint64) for k in range(30)])
    pairs = spark.createDataFrame([(3, 5), (3, 20), (4, 6)], "a long, b long")
    assert {tuple(r) for r in setjoin.overlaps(pairs, sets).collect()} == {(3, 5, 40, 40, 38), (3, 20, 40, 40, 23), (4, 6, 40, 40, 38)}
    assert {tuple(r) for r in setjoin.verify(pairs, sets).collect()} == {(3, 5), (4, 6)}
