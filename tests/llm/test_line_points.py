"""Lines that stand once and have no partner are let go by their key, before lines are grouped and joined."""

from collections import Counter

import corpus_pipeline
from prefmill.llm import common, line_dedup
from test_short_lines import brute


def test_only_lines_that_repeat_or_have_a_partner_are_grouped(spark, tmp_path, monkeypatch):
    long = [f"w{k}" for k in range(40)]
    rows = [(k, "\n".join([f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}", f"only{k}", "the same line stands in every document"])) for k in range(30)]
    rows += [(40, " ".join(long)), (41, " ".join(long[:-1]) + " x\nonly40"), (None, "only3"), (42, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    lines = {}
    stored = common.materialise
    monkeypatch.setattr(common, "materialise", lambda s, df, tag, *a: lines.setdefault(tag, stored(s, df, tag, *a)))
    got = Counter(map(tuple, line_dedup.dedup_lines(spark, spark.read.parquet(path), short=True).select("doc_id", "text", "n_removed").collect()))
    assert got == brute(rows)
    assert lines["op9-lines"].count() == 30 + 2 + 2


def test_texts_go_through_python_once(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, "one line\nand this one\n" + "x " * k, 9) for k in range(5)], "doc_id long, text string, n_chars long").write.parquet(path)
    out = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(path), "")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {0: ("one line\nand this one\n", 9), 1: ("x ", 2)} | {k: ("x " * k, 2 * k) for k in range(2, 5)}
