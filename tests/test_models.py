"""Strengths, heads, pair encoding, exact quantiles, serialized cells and epoch rows against plain computations."""

import ast
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefmill.functions import text as tx
from prefmill.operators import encoding, evaluation as ev, quantiles as qt, scoring, strengths as st

BATTLE = "model_a string, model_b string, winner_model_a int, winner_model_b int, winner_tie int"


# ---- strengths ------------------------------------------------------------------------------------------------------
def plain_strengths(rows, rounds):
    wins, games = defaultdict(float), defaultdict(int)
    for a, b, x, y, t in rows:
        if a is None or b is None or a == b or x + y + t != 1:
            continue
        w = 0.5 if t else float(x)
        wins[a] += w
        wins[b] += 1 - w
        games[a, b] += 1
        games[b, a] += 1
    p = dict.fromkeys(wins, 1.0)
    for _ in range(rounds):
        d = {i: sum(n / (p[i] + p[j]) for (k, j), n in games.items() if k == i and p[i] + p[j] > 0) for i in p}
        p = {i: wins[i] / d[i] if d[i] else 0.0 for i in p}
    part = {i: i for i in p}
    for _ in p:
        for i, j in games:
            part[i] = min(part[i], part[j])
    mean = {c: np.mean([p[i] for i in p if part[i] == c]) for c in part.values()}
    return {i: (part[i], p[i] / mean[part[i]] if mean[part[i]] else 0.0, wins[i]) for i in p}


def test_strengths(spark):
    r = random.Random(4)
    skill = {"a": 3, "b": 2, "c": 1, "d": 1, "x": 2, "y": 1}
    rows = []
    for _ in range(800):
        a, b = r.sample(r.choice(["abcd", "abcd", "xy"]), 2)
        o = r.choices(range(3), [skill[a], skill[b], 1])[0]
        rows.append((a, b, int(o == 0), int(o == 1), int(o == 2)))
    rows += [("a", "a", 1, 0, 0), (None, "a", 1, 0, 0), ("a", "b", 1, 1, 0), ("a", "winless", 1, 0, 0), ("p", "q", 0, 0, 1)] * 3
    frame = spark.createDataFrame(rows, BATTLE)
    got = {x["model"]: (x["component"], x["strength"], x["wins"]) for x in st.strengths(frame, 10, 0).collect()}
    want = plain_strengths(rows, 10)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 and got[i][2] == want[i][2] for i in got)
    ended = {x["model"]: x["strength"] for x in st.strengths(frame, 200, 1e-7).collect()}
    assert ended["a"] > ended["b"] > ended["c"] and ended["winless"] < 1e-3 and abs(ended["p"] - 1) < 1e-9
    far = plain_strengths(rows, 2000)
    assert all(abs(ended[i] - far[i][1]) < 1e-4 for i in ended if i != "winless")
    assert st.strengths(frame.limit(0)).collect() == []


# ---- heads ----------------------------------------------------------------------------------------------------------
def test_head(spark):
    r = np.random.default_rng(1)
    w1, b1, w2, b2 = r.normal(size=(5, 4)), r.normal(size=5), r.normal(size=(1, 5)), r.normal(size=1)
    vectors = [*r.normal(size=(50, 4)).tolist(), None, [1.0] * 3, [1.0, None, 2.0, 3.0], [], [0.0] * 4]
    frame = spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "id int, v array<double>, score string").repartition(3)
    got = {x["id"]: x["s"] for x in scoring.with_scores(frame, scoring.two_layers(w1, b1, w2, b2), {"v": "s"}).collect()}
    for k, v in enumerate(vectors):
        good = v is not None and len(v) == 4 and None not in v
        assert got[k] is None if not good else abs(got[k] - float(np.tanh(w1 @ np.array(v) + b1) @ w2[0] + b2[0])) < 1e-12
    with pytest.raises(ValueError):
        scoring.with_scores(frame, scoring.two_layers(w1, b1, w2, b2), {"v": "score"})
    with pytest.raises(ValueError):
        scoring.two_layers(w1, b1, w2.T, b2)


def test_predictions(spark):
    head = scoring.Head([([[1.0, 0.0]], [0.0], "none")])
    rows = [(1, [3.0, 0.0], [-3.0, 0.0]), (2, [0.0, 1.0], [0.0, 2.0]), (3, None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "id int, va array<double>, vb array<double>")
    got = {x["id"]: x for x in scoring.predict(frame, head).collect()}
    assert [got[k]["pred_label"] for k in (1, 2, 3)] == ["A", "TIE", "TIE"] and got[3]["prob_B"] == 0.3333
    assert abs(got[1]["prob_A"] + got[1]["prob_B"] + got[1]["prob_TIE"] - 1) < 1e-12
    assert {x["pred_label"] for x in scoring.predict(frame, None).collect()} == {"TIE"}


# ---- pair encoding --------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def fmt():
    import public_tokenizers

    return encoding.PairFormat(public_tokenizers.path("word_bpe_49k.json"), 49406, 49406, 49407, 0, 12, 20, 30)


PAIRS = [("a question", "an answer of words"), (None, "x"), ("", ""), ("word " * 40, "short"), ("short", "reply " * 90), ("one two three four five six seven eight nine", "y " * 19), ("é ü", None), ("q " * 12, "r " * 20)]


def library(fmt, longest, a, b, pad):
    from tokenizers import Tokenizer
    from tokenizers.processors import TemplateProcessing

    tok = Tokenizer.from_file(fmt.tokenizer)
    begin, end = tok.id_to_token(fmt.begin), tok.id_to_token(fmt.end)
    tok.post_processor = TemplateProcessing(single=f"{begin}:0 $A:0 {end}:0", pair=f"{begin}:0 $A:0 {begin}:0 $B:1 {end}:1", special_tokens=[(begin, fmt.begin), (end, fmt.end)])
    tok.enable_truncation(longest, strategy="longest_first")
    out = tok.encode(a, b)
    fill = (pad or len(out.ids)) - len(out.ids)
    return out.ids + [fmt.pad] * fill, out.type_ids + [0] * fill, out.attention_mask + [0] * fill


def test_pairs_for_serving_are_the_librarys(spark, fmt):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "id int, a string, b string").coalesce(1)
    for batch in (1, 3):
        got = {x["id"]: x for x in encoding.encode_pairs(frame, fmt, "a", "b", serving=True, batch=batch).collect()}
        for k, (a, b) in enumerate(PAIRS):
            ids, segments, mask = library(fmt, 12 + 20 + 3, a or "", b or "", len(got[k]["input_ids"]))
            assert (got[k]["input_ids"], got[k]["segments"], got[k]["mask"]) == (ids, segments, mask)
            near = [got[j] for j in range(k // batch * batch, min(len(PAIRS), k // batch * batch + batch))]
            assert len(ids) == max(sum(x["mask"]) for x in near)


def test_pairs_for_training(spark, fmt):
    """Each side is cut first, then the pair as the library cuts it."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(fmt.tokenizer)
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PAIRS)], "row long, a string, b string")
    got = {x["id"]: x for x in encoding.encode_pairs(frame, fmt, "a", "b", "row").collect()}
    for k, (a, b) in enumerate(PAIRS):
        x, y = (tok.encode(t or "", add_special_tokens=False).ids[:n] for t, n in ((a, 12), (b, 20)))
        while len(x) + len(y) > 27:
            (x if len(x) > len(y) else y).pop()
        want = [fmt.begin, *x, fmt.between, *y, fmt.end]
        assert got[k]["input_ids"] == want + [0] * (30 - len(want)) and sum(got[k]["mask"]) == len(want)
        assert got[k]["segments"][: len(want)] == [0] * (len(x) + 2) + [1] * (len(y) + 1)


# ---- quantiles ------------------------------------------------------------------------------------------------------
def test_quantiles(spark):
    r = np.random.default_rng(2)
    values = np.concatenate([r.normal(size=700) * 10.0 ** r.integers(-300, 300, 700), np.repeat([0.0, -0.0, 1.5, -7.0], 90), [math.inf, -math.inf, 5e-324, -5e-324]])
    rows = [(["a", "b", None][k % 3], float(x) if k % 11 else None, k % 5) for k, x in enumerate(values)] + [("empty", None, None), ("one", 3.25, 9)]
    at = [0.0, 0.05, 0.5, 0.731, 0.99, 1.0]
    frame = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    got = {(y["by"], y["column"], y["q"]): (y["n"], y["value"]) for y in qt.quantiles(frame, ["x", "n"], at, "g").collect()}
    for g in ("a", "b", None, "one"):
        for c, k in (("x", 1), ("n", 2)):
            own = sorted(float(y[k]) for y in rows if y[0] == g and y[k] is not None)
            for p in at:
                low, high = own[math.floor(p * (len(own) - 1))], own[math.ceil(p * (len(own) - 1))]
                want = low if low == high else low + (high - low) * (p * (len(own) - 1) - math.floor(p * (len(own) - 1)))
                assert got[g, c, p][0] == len(own) and got[g, c, p][1] == want
    assert not any(k[0] == "empty" for k in got)
    assert qt.quantiles(frame.limit(0), ["x"], at).collect() == []
    one = qt.quantiles(spark.createDataFrame([(math.nan,), (1.0,), (2.0,)], "x double"), ["x"], [0.0, 0.5, 1.0]).orderBy("q").collect()
    assert [y["value"] for y in one[:2]] == [1.0, 2.0] and math.isnan(one[2]["value"])


# ---- cells ----------------------------------------------------------------------------------------------------------
def cell_value(c):
    """Python's own reading of literals, in place of the expressions'."""
    if c is None or c.strip().lower() in ("", "nan", "null", "none"):
        return None
    t = c.strip().replace("\\/", "/").replace("null", '""')
    try:
        v = ast.literal_eval(t)
    except (ValueError, SyntaxError):
        return t
    if isinstance(v, list):
        return "\n".join(x for x in (str(y).strip() for y in v) if x) or None
    return v if isinstance(v, str) else t


def test_cells_by_python(spark):
    r = random.Random(6)
    inside = ["a", "é", "'", '"', "\\", "\n", "\t", " ", "null", "/", "]", ",", "😀", "x" * 30]
    cells = [None, "", " nan", "None", "[]", "[ ]", "plain", "['open", "[a]", "[1 2]", "['a'] x", "'s'", '"s"', "['a' 'b' \"c\"]", "['x',]", "[,]", "['a',,'b']", '["x", null, "a null b"]', '["a\\/b"]', "['\\x41\\u00e9\\101\\q\\\nz']", "[None, True, -1, 2.5]", "[' ', '']"]
    for _ in range(200):
        words = ["".join(r.choice(inside) for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 5))]
        cells.append(str(words) if r.random() < 0.7 else "[" + ", ".join('"' + w.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' for w in words) + "]")
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = {x["i"]: x["v"] for x in rows.select("i", tx.literal_cell(F.col("c")).alias("v")).collect()}
    bad = [(c, got[k], cell_value(c)) for k, c in enumerate(cells) if got[k] != cell_value(c)]
    assert not bad


def test_cells_within_cells_and_long_ones(spark):
    long = "['" + "line \\n " * 60_000 + "']"
    cells = ["[[1, 'x'], 'y']", "[[], [['a','b']], 3]", long, "[" + "'v'," * 2_000 + "]"]
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, c string")
    got = [x["v"] for x in rows.select("i", tx.literal_cell(F.col("c")).alias("v")).orderBy("i").collect()]
    assert got[:2] == ["[1, 'x']\ny", "[]\n[['a', 'b']]\n3"]
    assert got[2] == ("line \n " * 60_000).strip() and got[3] == "\n".join(["v"] * 2_000)


# ---- epochs ---------------------------------------------------------------------------------------------------------
def test_epoch_rows(spark):
    steps = [("m", "r", 1, 0.5), ("m", "r", 1, 1.0), ("m", "r", 2, 0.25), ("n", "r", 1, None)]
    rows = [("m", "r", 1, y, p, y_pred) for y, p, y_pred in [(0, (0.7, 0.2, 0.1), 0), (1, (0.6, 0.3, 0.1), 0), (2, (0.1, 0.1, 0.8), 2)]]
    predictions = spark.createDataFrame([(a, b, c, y, *p, z) for a, b, c, y, p, z in rows], "model string, run string, epoch int, y_true int, p_a double, p_b double, p_tie double, y_pred int")
    got = {(x["model"], x["epoch"]): x for x in ev.epoch_rows(spark.createDataFrame(steps, "model string, run string, epoch int, loss double"), predictions).collect()}
    one = got["m", 1]
    assert one["mean_train_loss"] == 0.75 and one["val_acc"] == round(2 / 3, 6)
    assert one["val_loss"] == round(-(math.log(0.7) + math.log(0.3) + math.log(0.8)) / 3, 6)
    assert (one["precision_A"], one["recall_A"], one["f1_A"], one["f1_B"], one["f1_TIE"]) == (0.5, 1.0, round(2 / 3, 6), 0.0, 1.0)
    assert one["macro_f1"] == round((2 / 3 + 1) / 3, 6) and one["dist_A"] == round(1.4 / 3, 6)
    assert got["m", 2]["mean_train_loss"] == 0.25 and got["m", 2]["val_loss"] is None and got["n", 1]["mean_train_loss"] is None
    names = spark.createDataFrame([("m", "run_b"), ("m", "run_a"), ("m", "x_c")], "model string, run string")
    assert [tuple(x) for x in ev.latest_run_by_name(names).collect()] == [("m", "run_b")]
