"""op1_lm_score scores by every pair of subwords that the training documents hold, however many there are."""

import numpy as np
import pytest

from prefmill.llm import lm_score


@pytest.mark.parametrize("head", [lm_score.HEAD, 2])
def test_scores_go_by_all_pairs(spark, tmp_path, monkeypatch, head):
    texts = ["international unbelievable naming of houses unbelievable", "nationalization of zyxwv unbelievably", "", "houses qwertyuiop international"]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "zyxwvut unseenable"])], "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    whole, counts = lm_score.learn(spark, docs.filter("doc_id < 4"))
    _, ids, lengths = lm_score._sequences([t.encode() for t in [*texts, "zyxwvut unseenable"]])
    want = whole.score(ids, lengths)
    monkeypatch.setattr(lm_score, "PAIRS", 2)
    model, counts = lm_score.learn(spark, docs.filter("doc_id < 4"))
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark, docs, model, counts, head).collect()}
    assert np.allclose([got[i] for i in range(5)], want, atol=1e-4)
