"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from prefmill.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, key string, base long, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    below = defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        size = len(p[-1][1].encode()) if p else 0
        sums[p] = [sum(sums[k][0] for k in below[p]) or 1, sum(sums[k][1] for k in below[p]) + (len(members[p]) - 1) * size]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c, e in m if e)
        out.append((m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), len(below[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    said = [("user", "a"), ("user", "é" * 9), ("assistant", "a"), (None, None), ("", ""), ("user", None), ("1:a", ""), ("", "1:a"), ("user", "long " * 20000)]
    common = [r.choice(said) for _ in range(12)]
    out = []
    for c in [*range(60), *range(200, 230, 3), -7, -5, 10**15, None]:
        n = r.choice([1, 2, 3, 8, 9, 12])
        for k in range(n):
            role, text = common[k] if r.random() < 0.9 else r.choice(said)
            out.append((c, None if k == 0 and r.random() < 0.5 else k, role, text))
    out += [(7, k, "user", f"t{k}") for k in range(100, 700)] + [(9, k, "user", f"t{k}") for k in range(100, 700)]
    out += [out[0]] * 3
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("limit", [pt.NODES, 2, 7])
def test_against_plain_trie(spark, rows, table, limit):
    """With a small limit, families come out in many parts."""
    assert got(pt.prefix_trie(spark, table, limit)) == plain(rows)


def test_ranges_and_parents(spark, rows, table, monkeypatch):
    monkeypatch.setattr(pt, "RANGE", 1)
    monkeypatch.setattr(pt, "PARENTS", 3)
    assert got(pt.prefix_trie(spark, table)) == plain(rows)


def test_many_equal_conversations(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(3000) for k in range(3)]
    frame = spark.createDataFrame([(*x, "", 0, 0) for x in rows], SCHEMA)
    assert got(pt.prefix_trie(spark, frame)) == plain(rows)


def test_keys_are_the_tree(spark, table):
    nodes = pt.prefix_trie(spark, table).collect()
    depth = {bytes(r["key"]): r["depth"] for r in nodes}
    assert len(depth) == len(nodes) and all(r["parent"] is None or depth[bytes(r["parent"])] == r["depth"] - 1 for r in nodes)


def test_empty(spark, table):
    assert pt.prefix_trie(spark, table.limit(0)).collect() == []
    assert pt.prefix_trie(spark, table.filter("conv_id is null")).collect() == []


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{d}/conversations.parquet'")
    assert got(pt.op13_prefix_trie(spark, d)) == sorted(con.sql(pt.OP13_SQL).project(",".join(COLUMNS)).fetchall(), key=str)
