"""sample_middle against its formula over Python lists."""

import pytest
from pyspark.sql import functions as F

from prefmill.functions import text as tx


def formula(tokens, target, stride):
    if len(tokens) <= target:
        return tokens
    half, reach = len(tokens) // 2, min(64, len(tokens) // 4)
    left, right = tokens[:half], tokens[half:]
    out = left[:96] + ["…"] + tokens[half - reach : half + reach][:: max(1, stride)] + ["…"] + right[-32:]
    return out if len(out) <= target else out[: target - 1] + ["…"]


@pytest.mark.parametrize("target, stride", [(150, 24), (150, 1), (120, 24), (40, 7), (3, 24), (130, 0)])
def test_sample_middle(spark, target, stride):
    sizes = [0, 1, 2, 3, 4, 5, 41, 50, 63, 64, 65, 121, 150, 151, 191, 192, 193, 255, 256, 257, 1000, 5001]
    cells = [[str(k) for k in range(n)] for n in sizes]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, t array<string>")
    got = {r["i"]: r["v"] for r in rows.select("i", tx.sample_middle(F.col("t"), target, stride).alias("v")).collect()}
    for i, c in enumerate(cells):
        assert got[i] == formula(c, target, stride)


def test_registered_target_keeps_the_tail(spark):
    words = [str(k) for k in range(256)]
    row = spark.createDataFrame([(words,)], "t array<string>").select(tx.sample_middle(F.col("t"), 150).alias("v")).first()
    assert len(row["v"]) == 136 and row["v"][-32:] == words[-32:]
