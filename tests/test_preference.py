"""Labels, dedup, clusters, splits and swaps."""

import itertools

from pyspark.sql import functions as F

from prefmill.functions import similarity as sim
from prefmill.operators import evaluation as ev, preference as pf, profile as pr


def test_label_of_all_flags(spark):
    rows = spark.createDataFrame([x for x in itertools.product((0, 1), repeat=3)], "winner_model_a int, winner_model_b int, winner_tie int")
    got = {tuple(r)[:3]: r["l"] for r in rows.withColumn("l", pf.label()).collect()}
    assert got == {(1, 0, 0): 0, (0, 1, 0): 1, (0, 0, 1): 2} | {k: None for k in got if sum(k) != 1}


def test_jaccard(spark):
    rows = spark.createDataFrame([("", ""), ("a", ""), ("a b", "b a"), ("a b", "b c")], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(sim.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, round(1 / 3, 6)]


def test_tfidf_identical_and_disjoint(spark):
    rows = spark.createDataFrame([(0, "aa bb", "aa bb"), (1, "cc dd", "ee ff"), (2, "x", "y")], "k int, a string, b string")
    got = {r["k"]: r["cosine_tfidf"] for r in sim.tfidf_cosine(rows, "k", "a", "b").collect()}
    assert abs(got[0] - 1) < 1e-9 and got[1] == 0 and got[2] == 0


def test_components_chain_and_cap(spark):
    rows = spark.range(12).select(F.col("id").alias("row_idx"), F.lit("g").alias("prompt_sig"), F.concat(F.lit("word"), F.when(F.col("id") < 3, 0).otherwise(F.col("id")).cast("string")).alias("template"), F.lit(1).alias("info"))
    got = pf.cluster_templates(rows).orderBy("place").collect()
    assert [r["row_idx"] for r in got] == [0, 3, 4, 5, 6, 7, 8, 9]
    shuffled = pf.cluster_templates(rows.repartition(7, "template")).orderBy("place").collect()
    assert got == shuffled


def test_swap_is_an_involution_and_split_keeps_groups(spark):
    rows = spark.createDataFrame([(i, f"p{i % 7}", f"a{i}", f"b{i}", "m", "n", i % 3) for i in range(70)], "row_idx int, prompt_sig string, response_a_clean string, response_b_clean string, model_a string, model_b string, label int")
    both = pf.swap_union(rows)
    assert both.count() == 140
    back = pf.swap_union(both.filter("is_swapped = 1").drop("is_swapped")).filter("is_swapped = 1").drop("is_swapped")
    assert sorted(back.collect()) == sorted(rows.collect())
    for cut in (pf.split(rows), pf.stratified_split(rows)):
        assert cut.groupBy("prompt_sig").agg(F.countDistinct("split").alias("n")).filter("n > 1").isEmpty()


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0, x) for x in (0, 63, 64, 2047, 2048, 2049)], "label int, n int")
    got = {r["bin_left"]: r["count"] for r in pr.length_histogram(rows, "n").collect()}
    assert len(got) == 32 and got[0] == 2 and got[64] == 1 and got[1984] == 2 and sum(got.values()) == 5


def test_report_without_predictions_of_a_class(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0)], "y_true int, y_pred int")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in ev.class_report(rows).collect()}
    assert got[0] == (0.5, 1.0, 2 / 3) and got[1] == (0.0, 0.0, 0.0) and got[2] == (0.0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(50.0, -50.0), (0.0, 0.0), (1.0, 2.0)], "s_a double, s_b double")
    for r in ev.bt_probabilities(rows).collect():
        assert abs(r["p_a"] + r["p_b"] + r["p_tie"] - 1) < 1e-12
    assert ev.steps(100, 8, 6, 2, 0.1) == (39, 3)


def test_pair_encoding_takes_from_the_longer_side(spark):
    rows = spark.createDataFrame([(a, b) for a in (0, 1, 4, 5, 9, 200) for b in (0, 3, 4, 5, 12, 400)], "prompt_len int, respA_len int")
    for r in ev.pair_encoding(rows, tokenizer_max=11).collect():
        a, b = min(r["prompt_len"], 96), min(r["respA_len"], 320)
        while a + b > 8:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (r["enc_first"], r["enc_second"], r["enc_pad"]) == (a, b, 8 - a - b)


def test_leaked_signatures(spark):
    rows = spark.createDataFrame([("b", "train"), ("b", "valid"), ("a", "train"), ("a", "valid"), ("c", "train"), ("c", "train")], "prompt_sig string, split string")
    assert [r[0] for r in pr.leaked(rows).collect()] == ["a", "b"] and pr.leaked(rows, 1).count() == 1


def test_cosine_of_head_and_tail_terms(spark):
    """The same cosines whatever part of the terms is broadcast; a row is not spread over rows of its terms."""
    import math
    import random
    import re
    from collections import Counter

    from prefmill.functions import similarity as sim

    r = random.Random(4)
    words = ["the", "of", "und", "Ärger", "x"] * 6 + [f"w{k}" for k in range(60)]
    rows = [(k, *(r.choice([None, "", " ".join(r.choices(words, k=12)), " ".join(r.choices(words, k=3))]) for _ in "ab")) for k in range(80)]
    bags = {k: [Counter(re.findall(r"\w{2,}", (t or "").lower())) for t in ts] for k, *ts in rows}
    df = Counter(w for pair in bags.values() for bag in pair for w in bag)
    idf = {w: math.log((1 + 2 * len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    size = lambda bag: math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
    want = {k: sum(n * b[w] * idf[w] ** 2 for w, n in a.items()) / (size(a) * size(b)) if a and b else 0.0 for k, (a, b) in bags.items()}
    frame = spark.createDataFrame(rows, "k long, a string, b string").repartition(5)
    for head in (0, 1, 10, 200_000):
        got = {x["k"]: x["cosine_tfidf"] for x in sim.cosines(frame, "k", "a", "b", head=head).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert any(x > 0.1 for x in want.values())
