"""Templates are normalised over whole texts, in the query and before they are clustered."""

import os

import pytest

from prefmill.plans import catalog, pipeline


def test_whole_texts_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = sorted(map(tuple, catalog.Q["template_norm_pairs"](spark, sf).collect()))
    assert got == sorted(con.execute(catalog.SQL["template_norm_pairs"]).fetchall())
    assert max(len(v) for _, v in got) > 400


def test_pipeline_clusters_normalised_templates(spark):
    # the same template apart from letters outside a-z, which the normalisation drops
    a = " ".join(f"word{k}" for k in range(40))
    rows = [(i, i, "same prompt", f"{a} {'éàü'[i]}{'éàü'[i]}", f"other side of it {'ßøñ'[i] * 3}", "m", "n", 1, 0, 0) for i in range(3)]
    rows += [(3 + i, 3 + i, "same prompt", f"answer number{i} stands alone{i}", f"reply{i} is different{i}", "m", "n", 0, 1, 0) for i in range(2)]
    raw = spark.createDataFrame(rows, "row_idx long, id long, prompt string, response_a string, response_b string, model_a string, model_b string, winner_model_a int, winner_model_b int, winner_tie int")
    assert sorted(r["row_idx"] for r in pipeline.run(raw)["clean"].collect()) == [0, 3, 4]
