"""The plans after the rounds of op 7 are the same for any number of rounds."""

import pyarrow as pa

from prefmill.llm import ngram_join, setjoin


def _rounds(spark, monkeypatch, points):
    """Links, pairs, joins and scans in their plans, and rounds, of one cell of points whose sets have nothing but the cell's hash in common."""
    import numpy as np

    sets = [np.array([1, *range(100 * k, 100 * k + 3 + k % 2)], np.uint64) for k in range(1, points + 1)]
    rows = [(k, len(s), setjoin.signature(s), s.tobytes()) for k, s in enumerate(sets)]
    table = spark.createDataFrame(pa.table({"id": [r[0] for r in rows], "n": pa.array([r[1] for r in rows], pa.int32()), "sig": [r[2] for r in rows], "s": [r[3] for r in rows]}))
    met = spark.createDataFrame([(k % 3, k, len(s), 0, 1.0 / (k + 1)) for k, s in enumerate(sets)], "h long, point long, n int, pos int, share double")
    count = []
    overlaps = setjoin.overlaps
    monkeypatch.setattr(setjoin, "overlaps", lambda *a: count.append(1) or overlaps(*a))
    links, pairs = ngram_join.regions(spark, met, table, small=2)
    monkeypatch.setattr(setjoin, "overlaps", overlaps)
    plan = "".join(x._jdf.queryExecution().optimizedPlan().toString() for x in (links, pairs))
    return plan.count("Join"), plan.count("Relation"), len(count), {tuple(sorted(r)) for r in pairs.collect()}


def test_plans_do_not_grow_with_the_rounds(spark, monkeypatch):
    few, more = _rounds(spark, monkeypatch, 7), _rounds(spark, monkeypatch, 45)
    assert few[2] < more[2]  # rounds
    assert few[:2] == more[:2] == (0, 2)
