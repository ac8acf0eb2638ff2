"""Text functions against values derived by hand from their definitions."""

import pytest
from pyspark.sql import functions as F

from prefmill.functions import text as tx


def values(spark, builder, cells):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t string")
    return [r["v"] for r in rows.select("i", builder(F.col("t")).alias("v")).orderBy("i").collect()]


def test_list_cells_are_parsed_and_never_evaluated(spark):
    cells = [None, "", "null", '["a","b"]', '["a",null,""]', "[]", "plain", '["unterminated', "__import__('os')", "[null]"]
    assert values(spark, tx.list_cell, cells) == [None, None, None, "a\nb", "a", None, "plain", '["unterminated', "__import__('os')", None]


def test_clean_text(spark):
    cells = ["See https://x.y/z NOW", "www.a.b @me #tag ok", "Ünï, cödé!", "a b\u001cc", "½ ²", "***", None]
    assert values(spark, tx.clean_text, cells) == ["see now", "ok", "ünï, cödé!", "a b c", "½ ²", None, None]
    assert values(spark, lambda c: tx.clean_text(c, ("the",)), ["the cat the"]) == ["cat"]


def test_cleaning_puts_a_space_where_a_character_goes(spark):
    cells = ["don't state-of-the-art a/b", "N/A", "x_y (z)", "a—b…c", "it's: 3.5% off!", "<b>hi</b>", "''"]
    assert values(spark, tx.clean_text, cells) == ["don t state of the art a b", "n a", "x_y z", "a b c", "it s: 3.5 off!", "b hi b", None]
    assert values(spark, lambda c: tx.clean_text(c, keep_punct=False), cells) == ["don t state of the art a b", "n a", "x_y z", "a b c", "it s 3 5 off", "b hi b", None]
    assert values(spark, lambda c: tx.fill_no_response(tx.clean_text(c)), ["N/A", "NA", "no answer"]) == ["n a", "no response", "no response"]


@pytest.mark.parametrize("p, want", [(0, 160), (59, 160), (60, 159), (96, 141), (500, 141)])
def test_response_target(spark, p, want):
    assert spark.range(1).select(tx.response_target(F.lit(p)).alias("v")).first()["v"] == want


def test_lengths_and_cuts(spark):
    words = [" ".join(map(str, range(n))) for n in (96, 97)]
    assert values(spark, tx.token_len, [None, "", " a  b "]) == [0, 0, 2]
    assert values(spark, lambda c: tx.token_len(tx.mini_prompt(c)), words) == [96, 65]
    assert values(spark, tx.info_len, ["no response", "x y"]) == [0, 2]
    assert values(spark, tx.shorten, ["a" * 160, "a" * 161]) == ["a" * 160, "a" * 160 + "..."]


def test_no_response_and_signature(spark):
    assert values(spark, tx.fill_no_response, ["NA", "n/a", "None", "no answer", "noanswer", "nan", " ", None]) == ["no response"] * 5 + ["nan", "no response", "no response"]
    assert values(spark, tx.prompt_sig, ["A 1\tb", "a 22 B", None]) == ["a <num> b", "a <num> b", ""]


def test_boilerplate(spark):
    got = values(spark, tx.strip_boilerplate, ["body text. Thanks, me", "so as an AI I can't\nnext", "thanksgiving day"])
    assert got == ["body text.", "so \nnext", ""]


def test_rounding(spark):
    rows = spark.createDataFrame([(0.125,), (2.675,)], "x double").select(tx.round_half_even(F.col("x")).alias("v"))
    assert [r["v"] for r in rows.collect()] == [0.12, 2.68]
