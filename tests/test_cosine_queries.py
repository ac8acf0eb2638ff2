"""Queries over cosines against their SQL, on tables with more rows in a task than are weighed at a time."""

import random
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

QUERIES = ["audit_log", "before_after_board", "cosine_hist_dense", "dedup_best_of_group", "dedup_flags", "dedup_meta", "dedup_rows", "dedup_trivial_tie", "exact_quantiles", "near_dup_count", "near_dup_list", "pair_similarity", "similarity_summary", "tfidf_cosine_pairs"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Every second text is followed by a copy, a near copy or a text that shares words with it."""
    r, folder = random.Random(8), tmp_path_factory.mktemp("tables")
    words, texts = [f"w{k}" for k in range(400)], []
    for k in range(2300):
        own = r.choices(words, k=r.choice([3, 12, 40, 90]))
        other = [list(own), own[:-1] + ["last"], own[: len(own) // 2] + r.choices(words, k=len(own) // 2), r.choices(words, k=9)][k % 4]
        if k % 5 == 0:  # near by their cosine only, and the longest
            own = r.choices(words, k=4) * r.randint(25, 60)
            other = own + r.choices(words, k=2)
        texts += [f"{k:04d} a " + " ".join(own), f"{k:04d} b " + " ".join(other)]
    pq.write_table(pa.table({"doc_id": r.sample(range(len(texts)), len(texts)), "text": texts}), folder / "documents.parquet")
    items = [f"Which of these {x}{y} is better, and why?" for x in "abcdefghij" for y in "klmnopqrst"]  # digits would be one group
    pq.write_table(pa.table({"item_id": list(range(len(items))), "text": items}), folder / "benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_is_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    found = entry.queries()[name](spark, tables)
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table().select(found.columns).to_pylist()
    rows = lambda some: sorted((tuple(x.values()) for x in some), key=repr)
    got = rows(x.asDict() for x in found.collect())
    assert want and got == rows(want)
