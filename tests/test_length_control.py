"""List items, repeated blocks, compression, tail control and serving: results worked out by hand, and properties that
hold for any text."""

import random

import pytest
from pyspark.sql import functions as F

from prefmill.functions import text as tx
from prefmill.operators import preference as pf


def numbered(a, z, step=1):
    return [f"t{k}" for k in range(a, z, step)]


def column(spark, builder, cells):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, t string")
    return [r["v"] for r in rows.select("i", builder(F.col("t")).alias("v")).orderBy("i").collect()]


ITEMS = [f"- item {k}" for k in range(30)]


@pytest.mark.parametrize("most, cell, want", [
    (24, "", ""),
    (24, " \n\n ", " \n\n "),
    (24, "a", "a"),
    (24, "\n".join(ITEMS[:24]), "\n".join(ITEMS[:24])),
    (24, "\n".join([*ITEMS[:25], "end"]), "\n".join([*ITEMS[:24], "end", "…"])),
    (2, "1. x\ntext\n* y\n• z\n-no item", "1. x\ntext\n* y\n-no item\n…"),
    (24, "A\n\nb\n \na\n\n\nA\n\nb", "A\n\nb\n \na\n\n\n\n\nb"),
    (24, "x \n \nX\n\nx", "x \n \nX"),
    (24, "- a\n\n- a\n\n- a\n\nlast", "- a\n\n- a\n\n\n\nlast"),
])
def test_items_and_blocks(spark, most, cell, want):
    assert column(spark, lambda c: tx.collapse_repeats(c, most), [cell]) == [want]


def test_items_and_blocks_of_any_text(spark):
    r = random.Random(3)
    cells = ["\n".join(r.choice(["- a", "* b", "3. c", "text", "", " ", "Text"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    out = column(spark, lambda c: tx.collapse_repeats(c, 10), cells)
    item = lambda line: line.startswith(("- ", "* ", "3. "))
    for cell, got in zip(cells, out):
        assert sum(map(item, got.split("\n"))) <= 10
        assert ("…" in got) == (sum(map(item, cell.split("\n"))) > 10)
        assert set(got) <= set(cell) | {"…"} and got.strip()[:1] == cell.strip()[:1]
    assert column(spark, lambda c: tx.collapse_repeats(c, 10), out[:5])[0] is not None


@pytest.mark.parametrize("cell, want", [
    ("as an ai\rmodel x\nnext", "next"),
    ("so long. Thanks\u0085all", "so long."),
    ("dear " + "x" * 90 + "\nbody", "body"),
    ("dear reader\nbody", "dear reader\nbody"),
    ("Body first.\nkind regards, me", "Body first."),
    ("the language model says\nyes", "the \nyes"),
])
def test_boilerplate(spark, cell, want):
    assert column(spark, tx.strip_boilerplate, [cell]) == [want]


LONG = " ".join(numbered(0, 200))


@pytest.mark.parametrize("target, cell, want", [
    (120, "", ""),
    (120, "  ", "  "),
    (120, "thanks, bye", "thanks, bye"),
    (120, "short text", "short text"),
    (130, LONG, " ".join([*numbered(0, 96), "…", *numbered(168, 200)])),
    (200, LONG, LONG),
    # 129 tokens are left: 64 from the front, each 24th of the middle, 32 from the end
    (120, LONG, " ".join([*numbered(0, 64), "…", "t32", "t56", "t80", "…", *numbered(168, 200)])),
])
def test_compress(spark, target, cell, want):
    assert column(spark, lambda c: tx.compress(c, F.lit(target)), [cell]) == [want]


def test_compress_any_text(spark):
    r = random.Random(4)
    words = ["a", "b.", "c!", "Same here.", "x"]
    cells = [" ".join([*(r.choice(words) for _ in range(r.randint(200, 400))), *numbered(0, 32)]) for _ in range(40)]
    for target in (120, 128, 140, 160):
        for cell, got in zip(cells, column(spark, lambda c: tx.compress(c, F.lit(target)), cells)):
            assert len(got.split()) <= target and got.split()[-1] == "t31"
            assert set(got.split()) <= set(cell.split()) | {"…"}


def test_serving(spark):
    """Texts within the limits stay; of a prompt 48 and 16 tokens do; the batch's longest responses are compressed."""
    prompt, answer = " ".join(numbered(0, 97)), " ".join(numbered(0, 500))
    raw = [(i, "a question", f"answer {i}", "yes it is so") for i in range(60)]
    raw += [(60, prompt, answer, "fine"), (61, None, "[]", '["N/A", "it\'s"]')]
    got = {x["id"]: tuple(x)[1:] for x in pf.serving_clean(spark.createDataFrame(raw, "id int, prompt string, response_a string, response_b string")).collect()}
    assert len(got) == 62 and all(got[i] == ("a question", f"answer {i}", "yes it is so") for i in range(60))
    # (387 - 96 - 9) / 2 = 141 tokens at most; 129 from the two ends fit
    assert got[60] == (" ".join([*numbered(0, 48), "…", *numbered(81, 97)]), " ".join([*numbered(0, 96), "…", *numbered(468, 500)]), "fine")
    assert got[61] == ("", "", "n a it s")
    with pytest.raises(ValueError):
        pf.serving_clean(spark.createDataFrame([(1,)], "id int"))


def test_english_stopwords(spark):
    words = pf.english_stopwords(spark)
    assert "the" in words and "don" in words and not any("'" in w for w in words)


def test_serving_by_row_and_from_a_file(spark, tmp_path):
    from prefmill.plans import serving

    one = serving.clean_single(spark, "Hi @you: a question?", "['an answer', 'in two\\nparts']", None, 7).collect()
    assert [tuple(r) for r in one] == [("7", "hi : a question?", "an answer in two parts", "")]
    (tmp_path / "t.csv").write_text('id,prompt,response_a,response_b,other\n1,"a\nb","say ""yes""",no,x\n')
    assert [tuple(r) for r in serving.clean_path(spark, str(tmp_path / "t.csv")).collect()] == [("1", "a b", "say yes", "no")]
    answer = serving.predict_single(serving.clean_single(spark, "p", "a", "b"))
    assert answer == {"id": "single", "prob_A": 0.3333, "prob_B": 0.3333, "prob_TIE": 0.3333, "pred_label": "TIE"}


def test_boilerplate_is_cut_wherever_its_patterns_match(spark):
    """The words that are looked for first leave out no match, in any case of letters."""
    words = ["as an ai", "AS AN Aİ", "aſ an aı", "I am an AI", "Language Model", "thanKs", "Thanks", "THANK YOU", "sincerely", "best regards", "kınd regards", "as an air", "x"]
    texts = [None, "", " ", *words, *(f"{a} {w}, b\n{v} c" for a in ("hello", " A") for w in words for v in words)]

    def plain(c):
        for pattern in (tx.GREETING, tx.DISCLAIMER, tx.SIGN_OFF):
            c = F.regexp_replace(c, pattern, "")
        return F.regexp_replace(c, f"^[{tx.SPACE}]+|[{tx.SPACE}]+$", "")

    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(plain(F.col("t")).alias("want"), tx.strip_boilerplate(F.col("t")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows) and len({r["got"] for r in rows}) > 40


def test_ends_and_single_lines(spark):
    texts = [None, "", " ", "a", " a", "a ", "\x85a b\x1c", "- one item", "- one\n- two\n", "a\n\na\n\nA", "\n"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", tx.strip(F.col("t")).alias("s"), tx.collapse_repeats(F.col("t")).alias("c")).collect()
    assert [r["s"] for r in rows] == [None, "", "", "a", "a", "a", "a b", "- one item", "- one\n- two", "a\n\na\n\nA", ""]
    assert [r["c"] for r in rows] == [None, "", " ", "a", "a", "a", "a b", "- one item", "- one\n- two", "a\n\na", "\n"]


def test_percentiles_and_result_read_the_same_stored_rows(spark):
    """Cleaning is done once: the result is a scan of stored rows, not the chain of patterns again."""
    from prefmill.operators import preference as pf

    raw = spark.createDataFrame([(k, "p", "a b " * k, "c") for k in range(1, 9)], "id long, prompt string, response_a string, response_b string")
    out = pf.serving_clean(raw)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "https?" not in plan and "parquet" in plan and out.count() == 8
