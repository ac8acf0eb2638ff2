"""Splits, cosine pairs and first rows of groups against plain computations."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.operators import cosine_join, preference as pf, splits, topk


# ---- split ----------------------------------------------------------------------------------------------------------
def shares(counts, side):
    return counts[side].sum(0) / counts.sum(0)


@pytest.mark.parametrize("seed", range(6))
def test_choice_is_as_good_as_the_best(seed):
    """All subsets of twelve bins."""
    r = np.random.default_rng(seed)
    counts = r.integers(0, 40, (12, 3)) + np.eye(12, 3, dtype=int)
    side = splits.choose(counts, 0.25)
    cost = lambda s: ((shares(counts, np.array(s, bool)) - 0.25) ** 2).sum()
    best = min(cost([k in x for k in range(12)]) for n in range(1, 12) for x in combinations(range(12), n))
    assert cost(side) <= best + 0.01


@pytest.mark.parametrize("groups", [(2, 2), (5, 9), (10, 3), (2, 40), (300, 200, 7)])
def test_labels_of_few_groups_are_on_both_sides(spark, groups):
    rows = [(f"s{y}_{g}", y, k) for y, n in enumerate(groups) for g in range(n) for k in range(6)]
    out = pf.stratified_split(spark.createDataFrame(rows, "prompt_sig string, label int, row_idx int")).collect()
    sides = defaultdict(set)
    for r in out:
        sides[r["prompt_sig"]].add(r["split"])
    assert len(out) == len(rows) and all(len(s) == 1 for s in sides.values())
    for y in range(len(groups)):
        assert {r["split"] for r in out if r["label"] == y} == {"train", "valid"}


def test_shares_within_a_point(spark):
    r = random.Random(3)
    rows = [(f"s{g}", r.choice([0, 0, 0, 1, 1, 2, None]), k) for g in range(4000) for k in range(r.choice([1, 1, 2, 5]))] + [("hot", k % 3, k) for k in range(5000)] + [(None, 1, 0)] * 3
    frame = spark.createDataFrame(rows, "prompt_sig string, label int, row_idx int")
    split = pf.stratified_split(frame)
    plan = split._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    got = split.groupBy("label").agg(F.avg((F.col("split") == "valid").cast("int")).alias("v")).collect()
    assert len(got) == 4 and all(abs(x["v"] - 0.1) <= 0.01 for x in got if x["label"] is not None)
    assert split.filter("prompt_sig is null").select("split").distinct().count() == 1
    again = {tuple(x) for x in pf.stratified_split(frame.repartition(9)).select("prompt_sig", "split").collect()}
    assert again == {tuple(x) for x in split.select("prompt_sig", "split").collect()}


def test_split_of_nothing(spark):
    empty = spark.createDataFrame([], "prompt_sig string, label int")
    assert pf.stratified_split(empty).collect() == []
    one = spark.createDataFrame([("a", None), ("b", None)], "prompt_sig string, label int")
    assert {r["split"] for r in pf.stratified_split(one).collect()} == {"train"}


# ---- cosine ---------------------------------------------------------------------------------------------------------
def plain_pairs(rows, threshold):
    groups = defaultdict(list)
    for i, g, t in rows:
        groups[g].append((i, Counter(re.findall(r"[^\W]{2,}", (t or "").lower()))))
    out = {}
    for g, members in groups.items():
        df = Counter(w for _, c in members for w in c)
        unit = {}
        for i, c in members:
            v = {w: n * (math.log((1 + len(members)) / (1 + df[w])) + 1) for w, n in c.items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            unit[i] = {w: x / size for w, x in v.items()}
        for i, j in combinations(sorted(unit), 2):
            cos = sum(x * unit[j].get(w, 0) for w, x in unit[i].items())
            if cos >= threshold:
                out[i, j] = cos
    return out


@pytest.fixture(scope="module")
def templates():
    r, rows = random.Random(11), []
    words = [f"w{k}" for k in range(40)]
    for g in ["a", "b", "c", None, "single"]:
        base = [[r.choice(words) for _ in range(r.choice([3, 12, 40]))] for _ in range(1 if g == "single" else 8)]
        for _ in range(1 if g == "single" else 40):
            t = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
            r.shuffle(t)
            rows.append((len(rows), g, r.choice([" ".join(t), " ".join(t), " ".join(t), "", None, "x y"])))
    return rows


@pytest.mark.parametrize("threshold", [0.985, 0.8, 0.5])
def test_cosine_pairs_are_all_pairs(spark, templates, threshold):
    want = plain_pairs(templates, threshold)
    frame = spark.createDataFrame(templates, "row_idx long, prompt_sig string, template string")
    got = {(r["a"], r["b"]): r["cosine"] for r in pf.template_edges(frame, threshold).collect()}
    assert {k for k, v in want.items() if abs(v - threshold) > 1e-9} == {k for k in got if abs(got[k] - threshold) > 1e-9}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and got


def test_links_connect_what_pairs_connect(spark, templates):
    frame = spark.createDataFrame(templates, "row_idx long, prompt_sig string, template string")
    parts = lambda edges: {tuple(r) for r in pf.components(frame, edges).collect()}
    assert parts(cosine_join.links(frame, 0.9)) == parts(cosine_join.pairs(frame, 0.9))


def test_prefixes_leave_few_candidates(spark):
    """A group of 3,000 rows that share common words: 4.5 million pairs."""
    r = random.Random(2)
    text = lambda k: " ".join(r.choice(["the", "of", "and", "in"]) for _ in range(20)) + f" own{k} own{k}b rare{k % 700}"
    rows = [(k, "hot", text(k)) for k in range(1500)] + [(1500 + k, "hot", "the same words " * 4) for k in range(1500)]
    members, terms = cosine_join.vectors(spark.createDataFrame(rows, "row_idx long, prompt_sig string, template string"))
    assert members.count() == 3000
    assert cosine_join.candidates(terms, 0.985).count() < 20_000


# ---- first rows -----------------------------------------------------------------------------------------------------
def test_first_rows_of_groups(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["a", "a", "a", "b", None]), r.randrange(9)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "row_idx long, g string, info int").repartition(8)
    out = topk.first(frame, ["g"], [F.desc("info"), F.col("row_idx")], 4)
    assert out._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2  # in every task, and for what they pass on
    want = {(g, x[0], k + 1) for g in ("a", "b", None) for k, x in enumerate(sorted((y for y in rows if y[1] == g), key=lambda y: (-y[2], y[0]))[:4])}
    assert {(x["g"], x["row_idx"], x["place"]) for x in out.collect()} == want
    top = topk.best(frame, ["g"], [F.col("info"), -F.col("row_idx")], ["row_idx"])
    assert {(x["g"], x["row_idx"]) for x in top.collect()} == {(g, i) for g, i, k in want if k == 1}


def test_dedup_has_no_window_over_groups(spark):
    rows = [(k, "hot" if k % 3 else None, "a b", "a b c", 2, 3, 2, 0.99, 0.9, 1) for k in range(60)]
    frame = spark.createDataFrame(rows, "row_idx long, prompt_sig string, response_a_clean string, response_b_clean string, respA_len int, respB_len int, label int, cosine_tfidf double, jaccard_tokens double, abs_len_diff int")
    flags = pf.dedup_flags(frame)
    assert "Window" not in flags._jdf.queryExecution().toString()
    assert sorted(r["row_idx"] for r in flags.filter("keep").collect()) == [0, 1]


# ---- groups in one task and groups over many ------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", [0.985, 0.6])
@pytest.mark.parametrize("rows", [1, 20, 4096])
def test_large_and_small_groups_have_the_same_pairs(spark, templates, threshold, rows, monkeypatch):
    """With a bound of 20 rows the single group is measured in a task, the others are joined."""
    monkeypatch.setattr(cosine_join, "TASK_ROWS", rows)
    want = plain_pairs(templates, threshold)
    frame = spark.createDataFrame(templates, "row_idx long, prompt_sig string, template string")
    out = cosine_join.pairs(frame, threshold).collect()
    got = {(r["a"], r["b"]): r["cosine"] for r in out}
    assert len(out) == len(got) and {k for k, v in want.items() if abs(v - threshold) > 1e-9} == {k for k in got if abs(got[k] - threshold) > 1e-9}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and {r["prompt_sig"] for r in out} == {templates[i][1] for i, _ in want}
    parts = lambda edges: {tuple(r) for r in pf.components(frame, edges).collect()}
    assert parts(cosine_join.links(frame, threshold)) == parts(spark.createDataFrame([(*k, 0) for k in want], "a long, b long, c int"))


def test_groups_of_a_task_are_shuffled_as_texts(spark, templates):
    """Not term by term: the terms of a row stay in one row."""
    frame = spark.createDataFrame(templates, "row_idx long, prompt_sig string, template string")
    rows, wide, large = cosine_join.by_size(frame)
    assert wide is None and large.isEmpty() and rows is frame
    plan = cosine_join.links(frame, 0.9)._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "Window" not in plan


def test_blocks_leave_no_pair_out(templates, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(cosine_join, "BLOCK", 7)
    texts = [" ".join(re.findall(r"[^\W]{2,}", t or "")) for _, g, t in templates if g == "a"]
    first, _, a, b, _ = cosine_join.near_rows(pa.array(texts), 0.8)
    want = plain_pairs([(i, "a", t) for i, t in enumerate(texts)], 0.8)
    assert {(i, j) for i, j in want if first[i] == i and first[j] == j} == set(zip(a.tolist(), b.tolist()))
    assert {(i, j) for i, j in combinations(range(len(texts)), 2) if first[i] == first[j] >= 0} == {(i, j) for i, j in want if Counter(texts[i].split()) == Counter(texts[j].split())}
