"""Encoding holds one Python worker with one model a task, and what that remembers is bounded."""

import random

import public_tokenizers

from pyspark.sql import functions as F

import corpus_pipeline
from prefmill.llm import pieces


def test_one_worker_a_task(spark, tmp_path):
    rows = [(1, "in the beginning", "x"), (2, None, "x"), (3, "naïve\tcafé ▁ 漢字", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    sizes = {i: len(pieces.model().encode([t])[0]) // 4 for i, t, _ in rows}
    out = pieces.op5_pieces(spark, str(tmp_path))
    last = corpus_pipeline.encode_pieces(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    for df in (out, last):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert {r["doc_id"]: r["n_pieces"] for r in df.collect()} == sizes
    assert out.filter(F.col("round_trip")).count() == 3


def test_long_words_are_not_remembered():
    r, m = random.Random(4), pieces.PieceModel(public_tokenizers.path(pieces.MODEL))
    words = ["▁" + "".join(r.choices("abcdefghij", k=2000)) for _ in range(200)]
    ids = m.encode_words(words)
    assert set(words) <= set(ids) and m.encode_words(words) == ids
    assert sum(map(len, m.known)) < 10_000
    assert len(m.pairs) <= pieces.PAIRS
