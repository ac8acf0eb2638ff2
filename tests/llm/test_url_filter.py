"""URL filters against rules and a model computed row by row."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prefmill.llm import url_filter as uf

URLS = [
    "https://Example.ORG/es/1", "https://a.example.org/en/12", "http://badexample.org/en/1", "ftp://example.org:8080/en/1", "http://b.com/fr/x?y=/de/", "http://c.com/de/", "http://c.com/de", "http://com/de/1#x",
    "http://net?x://y/", "no scheme", "", None, "x://", "://a", "http://é.org/ü?", "http://a/😀/b", "https://poker-bonus.example.net/q", "http://l.net/" + "ab/" * 20000, "http://" + "a." * 5000 + "com/de/1", "http://c.com/DE/",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[cut:]
    stop = next((k for k, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def rule(host, path, rules=uf.RULES):
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def features(host, path):
    grams = {k + t[i : i + n] for k, t in (("h", f"^{host}$" if host else ""), ("p", path)) for n in uf.SIZES for i in range(len(t) - n + 1)}
    signed = lambda g: (h := xxhash.xxh64_intdigest(g.encode(), 42)) - (h >> 63 << 64)
    return sorted({signed(g) % uf.BUCKETS for g in grams})


def fitted(rows, rounds):
    x = np.zeros((len(rows), uf.BUCKETS))
    for k, (url, _) in enumerate(rows):
        at = features(*parts(url))
        x[k, at] = 1 / math.sqrt(max(1, len(at)))
    y, w, b, v, vb = np.array([y for _, y in rows], float), np.zeros(uf.BUCKETS), 0.0, 0.0, 0.0
    for _ in range(rounds):
        d = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(rows)
        v, vb = uf.MOMENTUM * v - uf.RATE * (x.T @ d), uf.MOMENTUM * vb - uf.RATE * d.sum()
        w, b = w + v, b + vb
    return w, b


def model_of(m):
    r = m.first()
    return np.array(r["w"]), r["b"]


@pytest.fixture(scope="module")
def model(spark):
    return uf.train(spark, uf.labelled_urls(spark))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k if k != 4 else None, u, "clash", 0.5, 1) for k, u in enumerate(URLS * 2)]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, w double, b int")


def test_training_is_plain_descent(spark, model):
    rows = [(r["url"], r["label"]) for r in uf.labelled_urls(spark).collect()]
    w, b = fitted(rows, uf.ROUNDS)
    got, intercept = model_of(model)
    assert np.allclose(got, w, atol=1e-8) and abs(intercept - b) < 1e-8


def test_verdicts(pages, model):
    w, b = model_of(model)
    got = sorted(tuple(r) for r in uf.judge(pages, uf.RULES, model).select("url", "host", "path", "rule", "verdict", F.round("score", 9)).collect() if r["url"] is not None)
    want = []
    for u in [u for u in URLS * 2 if u is not None]:
        host, path = parts(u)
        at, (r, v) = features(host, path), rule(host, path)
        p = 1 / (1 + math.exp(-(b + w[at].sum() / math.sqrt(max(1, len(at))))))
        want.append((u, host, path, r, v or ("block" if p > uf.BLOCK_AT else "allow"), p))
    assert [g[:5] for g in got] == [x[:5] for x in sorted(want)]
    assert np.allclose([g[5] for g in got], [x[5] for x in sorted(want)], atol=1e-8)
    null = uf.judge(pages, uf.RULES, model).filter("url is null").collect()
    assert len(null) == 2 and all((r["host"], r["path"], r["rule"]) == ("", "", None) for r in null)


def test_rules_as_a_table(spark, pages, model):
    pick = lambda rules: sorted(map(str, uf.judge(pages, rules, model).collect()))
    table = spark.createDataFrame([*uf.RULES, ("c.com", "", "allow"), ("example.org", "/es/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    assert pick(table) == pick([*uf.RULES, ("c.com", "", "allow")])
    assert pick(table.limit(0)) == pick([])
    with pytest.raises(ValueError):
        uf.judge(pages, uf.RULES * 30, model)


def test_held_out_hosts(spark, model):
    """Pairs of words that the table doesn't hold."""
    known = {parts(r["url"])[0] for r in uf.labelled_urls(spark).collect()}
    made = lambda words: [f"http://x.{a}-{words[(k + 11) % len(words)]}.example/{k}" for k, a in enumerate(words)]
    rows = [(u, y) for y, words in (("block", uf.BLOCKED), ("allow", uf.ALLOWED)) for u in made(words)]
    assert not known & {parts(u)[0] for u, _ in rows}
    pages = spark.createDataFrame([(u, u) for u, _ in rows], "page_id string, url string")
    got = {r["url"]: r["verdict"] for r in uf.judge(pages, [], model).collect()}
    assert sum(got[u] == y for u, y in rows) >= 0.95 * len(rows)


def test_empty_tables(spark, pages, model):
    assert uf.judge(pages.limit(0), uf.RULES, model).collect() == []
    blank = uf.train(spark, spark.createDataFrame([("http://a", None), (None, 1)], "url string, label int"))
    assert set(model_of(blank)[0]) == {0.0}
    assert {r["verdict"] for r in uf.judge(pages, [], blank).collect()} == {"allow"}
