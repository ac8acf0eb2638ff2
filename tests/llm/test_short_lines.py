"""Lines of 1 to 4 words are one shingle in op9_line_dedup and in the pipeline."""

from collections import Counter

import corpus_pipeline
from prefmill.llm import line_dedup, setjoin

ROWS = [
    (3, "Les.\nfive words stand in here\na b\nA  b\n\n"),
    (1, "Les.\n\n \nAll rights reserved.\nles.\n7 8 9 10"),
    (2, "all rights  reserved.\nall rights\nfive words stand in here\n7 8 9 10 11\nfive words stand in there"),
    (4, "les. x"),
    (None, "Les."),
    (5, None),
]


def brute(rows):
    seen, out = [], Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept, gone = [], 0
        for line in (t or "").split("\n"):
            w = line.lower().split()
            s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
            if any(setjoin.similar(s, x) for x in seen):
                gone += 1
            else:
                kept.append(line)
            seen.append(s)
        out[(i, None if t is None else "\n".join(kept), gone)] += 1
    return out


def test_short_lines_go_when_they_repeat(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, n_chars long").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    want = brute(ROWS)
    got = Counter(map(tuple, line_dedup.dedup_lines(spark, docs, short=True).select("doc_id", "text", "n_removed").collect()))
    assert got == want and sum(k[2] for k in want) == 6
    query = line_dedup.op9_line_dedup(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["n_removed"]) for r in query.collect()) == Counter((k[0], k[2]) for k in want)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert left == {i: t for i, t, n in want if n == 0 or (t or "").split()}


def test_small_sets_match_equal_sets_only():
    sets = [set(range(a, a + n)) for a in range(5) for n in range(1, 8)]
    near = [(x, y) for x in sets for y in sets if x != y and setjoin.similar(x, y)]
    assert near and min(len(x) for x, _ in near) == line_dedup.LEAST
