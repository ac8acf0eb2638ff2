"""Cosines of batches of more rows than are weighed at a time."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from prefmill.functions import similarity as sim
from prefmill.operators import cosine_join


def rows(n):
    """Texts of both sides, some of them empty or missing, that differ from row to row."""
    text = lambda k: None if k % 17 == 0 else "" if k % 5 == 0 else " ".join(f"w{(k * j) % 97}" for j in range(1, 2 + k % 9)) + f" own{k // 2} ärger"
    return [(k, text(k), text(k + 1 + k % 3)) for k in range(n)]


def cosines(found):
    bags = {k: [Counter(re.findall(r"\w{2,}", t or "")) for t in ts] for k, *ts in found}
    df = Counter(w for pair in bags.values() for bag in pair for w in bag)
    idf = {w: math.log((1 + 2 * len(found)) / (1 + n)) + 1 for w, n in df.items()}
    size = lambda bag: math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
    return {k: sum(n * b[w] * idf[w] ** 2 for w, n in a.items()) / (size(a) * size(b)) if a and b else 0.0 for k, (a, b) in bags.items()}


@pytest.mark.parametrize("at", [0, 1, 7, 8, 1000, 1900])
def test_terms_of_a_slice(at):
    texts = pa.array([a for _, a, _ in rows(2100)]).slice(at, 150)
    terms, sizes = sim.flat_terms(texts)
    want = [(t or "").split() for t in texts.to_pylist()]
    assert terms.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]


@pytest.mark.parametrize("head", [10, 200_000])
def test_every_row_of_a_large_batch_has_its_cosine(spark, head):
    found = rows(2 * sim.ROWS + 300)
    want = cosines(found)
    frame = spark.createDataFrame(found, "k long, a string, b string").coalesce(1)
    got = {x["k"]: x["cosine_tfidf"] for x in sim.cosines(frame, "k", "a", "b", head=head).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    assert sum(x > 0.1 for k, x in want.items() if k >= sim.ROWS) > 100


def test_near_rows_of_a_slice():
    texts = pa.array([a or "" for _, a, _ in rows(2000)] + ["aa bb cc", "", "aa bb cc", "dd"])
    first, _, a, b, _ = cosine_join.near_rows(texts.slice(2000), 0.9)
    assert first.tolist() == [0, -1, 0, 3] and not len(a) and not len(b)
