"""Audit flags, log, metadata and samples against counts over Python rows."""

import random
import statistics

import pytest

from prefmill.operators import audit, preference as pf, profile as pr
from prefmill.sources import runs

SCHEMA = "row_idx int, split string, label int, prompt_sig string, prompt_len int, respA_len int, respB_len int, cosine_tfidf double, jaccard_tokens double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = [(k, "train", r.choice([0, 1, 2, 2, 2, 2, 2]), f"s{r.randrange(30)}", r.choice([5, 600]), r.randint(1, 400), r.randint(1, 400), r.choice([0.1, 0.95]), 0.2) for k in range(200)]
    out += [(200 + k, "valid", k % 2, f"s{r.randrange(40)}", 5, 100 + k % 3, 102, 0.1, 0.1) for k in range(50)]
    return out


def share(rows, cond):
    return 100 * sum(map(cond, rows)) / len(rows)


def test_flags(spark, rows):
    got = {tuple(r) for r in audit.flags(spark.createDataFrame(rows, SCHEMA), 512).collect()}
    want = set()
    for s in ("train", "valid"):
        own = [r for r in rows if r[1] == s]
        for k, name, cond in ((2, "tie_heavy", lambda x: x > 50), (0, "few_a", lambda x: x < 25), (1, "few_b", lambda x: x < 25)):
            if cond(share(own, lambda r: r[2] == k)):
                want.add((s, name))
        for c, name in ((4, "prompt"), (5, "respA"), (6, "respB")):
            pct = share(own, lambda r: r[c] > 512)
            if pct > 20:
                want.add((s, f"{name}_truncated_{'high' if pct > 30 else 'moderate'}"))
        if share(own, lambda r: r[7] >= 0.9) >= 15:
            want.add((s, "similar"))
        for k in {r[2] for r in own}:
            a, b = (statistics.mean(r[c] for r in own if r[2] == k) for c in (5, 6))
            if abs(a - b) <= 5:
                want.add((s, f"even_lengths_{k}"))
    if share(rows, lambda r: r[7] >= 0.95) >= 15:
        want.add(("all", "near_duplicates"))
    assert got == want and {x[1] for x in want} >= {"tie_heavy", "few_a", "prompt_truncated_high", "similar", "near_duplicates", "even_lengths_0"}
    assert audit.flags(spark.createDataFrame([], SCHEMA)).collect() == []


def test_log(spark, rows, tmp_path):
    text = audit.lines(spark.createDataFrame(rows, SCHEMA))
    train = [r for r in rows if r[1] == "train"]
    n = [sum(r[2] == k for r in train) for k in range(3)]
    assert text[0] == "1) train: " + " | ".join(f"{c}={100 * x / 200:.2f}% (n={x})" for c, x in zip(("A", "B", "TIE"), n))
    assert text[3] == "2) valid: prompt=0.00% | respA=0.00% | respB=0.00%"
    sides = [{r[3] for r in rows if r[1] == s} for s in ("train", "valid")]
    assert text[-1].startswith(f"6) all: prompts: train={len(sides[0])} | valid={len(sides[1])} | both={len(sides[0] & sides[1])} (")
    assert sum(x.startswith("5)") for x in text) == 5
    runs.append_log(spark, str(tmp_path / "audit.txt"), "audit", text)
    assert open(tmp_path / "audit.txt").read().split("\n")[1] == text[0]


def test_metadata(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"row_idx": "id"}).selectExpr("*", "'x' as response_a_clean", "'y' as response_b_clean", "'m' as model_a", "'n' as model_b")
    train, valid = (frame.filter(f"split = '{s}'").drop("split") for s in ("train", "valid"))
    dedup = spark.createDataFrame([(1, 2, 3, 4)], "removed_hard long, removed_near long, kept_near long, removed_total long")
    got = audit.split_metadata(pf.swap_union(train), valid, dedup).collect()
    assert len(got) == 1 and got[0]["n_train"] == 400 and got[0]["is_swapped_train_pct"] == 50.0 and got[0]["removed_total"] == 4
    assert got[0]["hard_cos"] == 0.998 and got[0]["pct_valid_0"] == 50.0
    assert audit.split_metadata(train.limit(0), valid.limit(0)).first()["n_train"] == 0


def test_samples(spark):
    rows = [(k, s, *["t"] * 6) for s in ("train", "valid") for k in range(100 if s == "train" else 7)]
    frame = spark.createDataFrame(rows, "row_idx int, split string, " + ", ".join(f"{c} string" for c in audit.TEXTS))
    got = audit.sample_texts(frame, 20).collect()
    assert sum(r["split"] == "train" for r in got) == 20 and sum(r["split"] == "valid" for r in got) == 7
    again = audit.sample_texts(frame.repartition(5), 20).collect()
    assert {(r["split"], r["row_idx"]) for r in got} == {(r["split"], r["row_idx"]) for r in again}


def test_small_parts(spark, tmp_path):
    rows = spark.createDataFrame([("a b", None, 7)], "prompt_clean string, response_a_clean string, respB_len int")
    got = pf.with_missing_lengths(rows.selectExpr("*", "'x y z' as response_b_clean")).first()
    assert (got["prompt_len"], got["respA_len"], got["respB_len"]) == (2, 1, 7)
    empty = pr.trunc_cols(spark.createDataFrame([], "prompt_len int, respA_len int, respB_len int")).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0)
    third = pr.trunc_cols(spark.createDataFrame([(600, 1, 1), (1, 1, 1), (1, 1, 1)], "prompt_len int, respA_len int, respB_len int")).first()
    assert third["pct_prompt_truncated"] == pytest.approx(100 / 3, abs=1e-12)
    with pytest.raises(FileNotFoundError):
        runs.read_strict(spark, str(tmp_path / "none.csv"))
    (tmp_path / "latin.csv").write_bytes("a\né\n".encode("latin-1"))
    assert runs.read_strict(spark, str(tmp_path / "latin.csv")).first()["a"] == "é"
