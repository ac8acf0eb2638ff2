"""Vector codes against Lloyd's rounds in plain integers."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from prefmill.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label)."""
    keep = [(i, [min(max(math.floor(float(np.float32(x)) * 256), -vc.LIMIT), vc.LIMIT) for x in v], y) for i, v, y in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    dim = len(min(keep, key=order)[1]) if keep else 0
    keep = [r for r in keep if len(r[1]) == dim]
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in sorted(keep, key=order)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            met = defaultdict(list)
            for _, v, _ in keep:
                met[nearest(p, cut(v, p))].append(cut(v, p))
            for e, xs in met.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by = [], defaultdict(int)
    for i, v, y in keep:
        at = [nearest(p, cut(v, p)) for p in range(parts)]
        err = sum(far(cut(v, p), books[p][at[p]]) for p in range(parts))
        by[y] += err
        out.append((i, "".join(f"{e:02x}" for e in at), err, y))
    return sorted(((i, c, e, by[y]) for i, c, e, y in out), key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def got(spark, rows, **kw):
    state, books = vc.compress(spark, rows, **kw)
    out = vc.with_label_error(spark, vc.codes(state, books)).select("vec_id", "code", "error", "label_error").collect()
    return sorted(map(tuple, out), key=str), books


def table(n, dim, seed, spread):
    r = random.Random(seed)
    base = [[r.choice(spread) for _ in range(dim)] for _ in range(7)]
    return [(r.randrange(n), [x + r.choice(spread) / 3 for x in r.choice(base)], r.choice([None, 0, 1, 2]), "clash", 9) for _ in range(n)]


ODD = [(None, [0.5] * 8, 1), (3, None, 1), (4, [None] + [0.1] * 7, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [], 1), (8, [0.1] * 16, 1), (9, [0.1] * 3, 1), (10, [1e30] * 8, 2), (0, [-0.001] * 8, None), (10**15, [0.0] * 8, 0)]


@pytest.mark.parametrize("seed,spread", [(1, [-0.5, -0.1, 0.0, 0.2, 0.4]), (2, [0.0, 1 / 256, 2 / 256]), (3, [-3.0, 2.9, 100.0])])
def test_against_plain_rounds(spark, seed, spread):
    """Few values make many ties."""
    rows = table(300, 8, seed, spread) + [(*o, "clash", 9) for o in ODD]
    want, sha = plain([r[:3] for r in rows], 4, 16, 3)
    have, books = got(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), parts=4, entries=16, rounds=3)
    assert have == want and books.sha256() == sha
    assert len(books.measured) == 4


def test_bounds_spare_measuring(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(8, 16)) * 20
    rows = [(i, np.float32(centres[i % 8] + r.normal(size=16) / 10).tolist(), 0) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    have, books = got(spark, frame, parts=2, entries=8, rounds=2)
    assert have == plain(rows, 2, 8, 2)[0]
    assert books.measured[0] == 1600 and books.measured[2] < 200


def test_few_vectors_and_none(spark):
    two = [(1, [0.1, 0.2], None, "", 0), (1, [0.3, -0.2], 4, "", 0)]
    want, sha = plain([r[:3] for r in two], 2, 64, 2)
    have, books = got(spark, spark.createDataFrame(two, SCHEMA), parts=2)
    assert have == want and books.sha256() == sha
    for rows in ([], [(1, None, 1, "", 0)]):
        have, books = got(spark, spark.createDataFrame(rows, SCHEMA))
        assert have == [] and books.sha256() == hashlib.sha256(b"").hexdigest()


def test_many_labels(spark, monkeypatch):
    rows = [(i, [i / 7, -i / 3], None if i % 3 == 0 else i, "", 0) for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = got(spark, frame, parts=2, entries=4)[0]
    monkeypatch.setattr(vc, "LABELS", 5)
    assert got(spark, frame, parts=2, entries=4)[0] == whole


def test_decode(spark):
    rows = [(i, [0.25 * (i % 4), -0.5, 0.125, 1.0 * (i % 2)], 0) for i in range(40)]
    state, books = vc.compress(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2, entries=16)
    back = {r["vec_id"]: r["vector"] for r in vc.decode(vc.codes(state, books), books).collect()}
    assert all(np.abs(np.array(back[i]) - np.array(v)).max() <= 1 / 256 for i, v, _ in rows)


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{d}/embeddings.parquet'")
    want = con.sql(vc.OP12_SQL)
    rows = vc.op12_vector_codes(spark, d).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
