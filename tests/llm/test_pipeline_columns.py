"""Stages keep the caller's columns, and row ids don't depend on the split or the number of files."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from prefmill.llm import common

TEXT = ["the cat sat upon the mat and ran home with nine dogs in wet sand\nthe cat sat upon the mat and ran home with nine dogs in wet sand", "12 34", None, "", "one small dog", "zq xj kv " * 60]
SCHEMA = "doc_id long, text string, lang string, Score double, lang_pred string, n_removed int, rid string"


@pytest.mark.parametrize("counted", [False, True])
def test_stages_keep_columns(spark, tmp_path, counted):
    """Also of names in other case, and without n_chars."""
    rows = [(k, t, "en", k / 2, f"mine{k}", k + 7, f"r{k}") for k, t in enumerate(TEXT)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.selectExpr("*", "doc_id * 3 as n_chars") if counted else docs
    docs.write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, "no such passage at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    own = lambda r: tuple(r[c] for c in docs.columns if c not in ("text", "n_chars"))
    known = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        out = common.materialise(spark, stage(spark, docs, str(tmp_path)), f"columns-{name}")
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert all(own(r) == own(known[r["doc_id"]]) for r in got)
        if name == "language_id":
            want = {k for k, t in enumerate(TEXT) if re.search("[a-z]", t or "")}
            assert {r["doc_id"] for r in got} == want and all(r["text"] == TEXT[r["doc_id"]] for r in got)
        elif name == "line_dedup":
            texts = {r["doc_id"]: (r["text"], r["n_chars"] if counted else None) for r in got}
            assert texts[0] == (TEXT[0].split("\n")[0], len(TEXT[0]) // 2 if counted else None)
            assert texts[4] == (TEXT[4], 12 if counted else None)
        else:
            assert {r["doc_id"] for r in got} == before
        docs = out


def test_no_language_to_learn(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", None, 0.5)], "doc_id long, text string, lang string, score double")
    assert corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect() == docs.collect()


@pytest.fixture
def many(spark, tmp_path):
    passage = " ".join(f"secret{k}" for k in range(12))
    rows = [(k, f"doc {k} {passage if k % 10 == 0 else 'clean words'} end") for k in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    yield str(tmp_path)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("files", [0, 3, 100_000])
def test_row_ids_at_any_number_of_files(spark, many, monkeypatch, files):
    ids = lambda: {r["doc_id"]: r["rid"] for r in common.with_rid(spark.read.parquet(f"{many}/d")).collect()}
    whole = ids()
    monkeypatch.setattr(common, "FILES", files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    assert ids() == whole and len(set(whole.values())) == 4000


def test_decontamination_when_the_split_changes(spark, many, monkeypatch):
    """Between the two uses of the ids, as when executors come or go."""
    monkeypatch.setattr(common, "FILES", 0)
    found = corpus_pipeline.decontaminate.occurrences

    def then_split(*args):
        out = found(*args)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        return out

    monkeypatch.setattr(corpus_pipeline.decontaminate, "occurrences", then_split)
    left = Counter(r["doc_id"] % 10 == 0 for r in corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{many}/d"), many).collect())
    assert left == {False: 3600}
