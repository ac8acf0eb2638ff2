"""Queries of reports and checks that the catalogue's older queries leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import evaluation as ev, preference as pf, profile as pr
from ..sources import fixtures as fx
from . import catalog as cat

Q: dict = {}
SQL: dict = {}
LENS = cat.LENS


def q(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


TOKENS = cat._tok
_HALF, _REACH = "(len(t) // 2)", "least(64, len(t) // 4)"


@q("sample_middle_tokens", f"""
WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
m AS (SELECT doc_id, t, list_concat(list_concat(list_concat(list_concat(list_slice(t, 1, least(96, {_HALF})), ['…']),
  list_filter(list_slice(t, {_HALF} - {_REACH} + 1, {_HALF} + {_REACH}), lambda x, i: (i - 1) % 24 = 0)), ['…']),
  list_slice(t, greatest({_HALF} + 1, len(t) - 31), len(t))) AS o FROM d)
SELECT doc_id, array_to_string(CASE WHEN len(t) <= 150 THEN t WHEN len(o) > 150 THEN list_concat(list_slice(o, 1, 149), ['…']) ELSE o END, ' ') AS v FROM m""")
def sample_middle_tokens(s: SparkSession, d: str) -> DataFrame:
    return cat.docs(s, d).select("doc_id", F.array_join(tx.sample_middle(tx.tokens(F.col("text")), 150), " ").alias("v"))


_ITEMS = "text || chr(10) || chr(10) || regexp_replace(text, '[.] ', chr(10) || '- ', 'g') || chr(10) || ' ' || chr(10) || text || chr(10) || chr(10) || chr(10) || text"


@q("collapse_repeats_blocks", f"""
WITH l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM (SELECT doc_id, {_ITEMS} AS x FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, regexp_matches(line, '^[{cat._S}]*([-*•]|\\p{{Nd}}+\\.)[{cat._S}]+') AS item FROM l),
n AS (SELECT *, CASE WHEN item THEN sum(CAST(item AS INT)) OVER (PARTITION BY doc_id ORDER BY i) ELSE 0 END AS nth FROM b),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (nth <= 24) || CASE WHEN max(nth) > 24 THEN chr(10) || '…' ELSE '' END AS x FROM n GROUP BY doc_id),
c AS (SELECT doc_id, x, string_split_regex(x, '\\n[{cat._S}]*\\n+') AS blocks, regexp_extract_all(x, '\\n[{cat._S}]*\\n+') AS gaps FROM t),
p AS (SELECT doc_id, x, gaps, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS i FROM c),
k AS (SELECT *, regexp_replace(block, '^[{cat._S}]+|[{cat._S}]+$', '', 'g') AS key FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(key) ORDER BY i) AS nth FROM k),
o AS (SELECT doc_id, any_value(x) AS x, string_agg(CASE WHEN key = '' OR nth <= 2 THEN block ELSE '' END || coalesce(gaps[i], ''), '' ORDER BY i) AS y FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(nullif(regexp_replace(y, '^[{cat._S}]+|[{cat._S}]+$', '', 'g'), ''), x) AS v FROM o""")
def collapse_repeats_blocks(s: SparkSession, d: str) -> DataFrame:
    """Every text, itself with its sentences as list items, and itself twice again, between blank lines."""
    x = F.concat("text", F.lit("\n\n"), F.regexp_replace("text", "[.] ", "\n- "), F.lit("\n \n"), "text", F.lit("\n\n\n"), "text")
    return cat.docs(s, d).filter("text is not null").select("doc_id", tx.collapse_repeats(x).alias("v"))


@q("valid_utf8_repair", "SELECT doc_id, text || chr(65533) AS v FROM documents")
def valid_utf8_repair(s: SparkSession, d: str) -> DataFrame:
    """A byte that is not UTF-8 after every text."""
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string")
    return cat.docs(s, d).select("doc_id", tx.valid_utf8(broken).alias("v"))


_BLANK = "CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE text END"


@q("blank_text_list", f"SELECT doc_id FROM (SELECT doc_id, {_BLANK} AS t FROM documents) WHERE t IS NULL OR trim(t) = '' ORDER BY doc_id LIMIT 50")
def blank_text_list(s: SparkSession, d: str) -> DataFrame:
    t = F.expr(_BLANK)
    return cat.docs(s, d).filter(t.isNull() | (F.trim(t) == "")).select("doc_id").orderBy("doc_id").limit(50)


@q("set_except_pairs", "SELECT user_id, event_type FROM events WHERE event_id % 2 = 0 EXCEPT SELECT user_id, event_type FROM events WHERE event_id % 50 = 1")
def set_except_pairs(s: SparkSession, d: str) -> DataFrame:
    e = fx.read(s, d, "events")
    side = lambda n, k: e.filter(F.col("event_id") % n == k).select("user_id", "event_type")
    return side(2, 0).subtract(side(50, 1))


_FULL = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, max(x) AS max FROM (SELECT CAST(\"{c}\" AS DOUBLE) AS x FROM clean)" for c in LENS)


@q("length_describe_full", f"WITH {cat.CLEAN} {_FULL}")
def length_describe_full(s: SparkSession, d: str) -> DataFrame:
    return pr.describe(cat.clean(s, d), LENS, (0.5, 0.99))


@q("dtypes_table", "SELECT * FROM (VALUES ('event_id', 'bigint', true), ('user_id', 'bigint', true), ('event_type', 'string', false), ('value', 'double', true)) t(\"column\", dtype, is_numeric)")
def dtypes_table(s: SparkSession, d: str) -> DataFrame:
    return pr.dtypes(fx.read(s, d, "events").select("event_id", "user_id", "event_type", "value"))


_TEXTUAL = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(v) AS count, count(DISTINCT v) AS nunique, (SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v FROM events) WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS top, (SELECT count(*) FROM events WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq FROM (SELECT CAST({c} AS VARCHAR) AS v FROM events)" for c in ("event_type", "user_id"))


@q("describe_values", _TEXTUAL)
def describe_values(s: SparkSession, d: str) -> DataFrame:
    return pr.describe_values(fx.read(s, d, "events"), ("event_type", "user_id"))


_DENSE = """, e AS (SELECT min(x) AS lo, max(x) AS hi FROM v), n AS (SELECT CAST(coalesce(least(floor((x - lo) / nullif(hi - lo, 0) * {n}), {n} - 1), 0) AS INT) AS bin, count(*) AS c FROM v, e WHERE x IS NOT NULL GROUP BY 1)
SELECT CAST(b AS INT) AS bin, coalesce(c, 0) AS count FROM range({n}) r(b) LEFT JOIN n ON n.bin = b"""


@q("similarity_hist_dense", f"WITH {cat.FEAT}, v AS (SELECT jaccard_tokens AS x FROM feat)" + _DENSE.format(n=40))
def similarity_hist_dense(s: SparkSession, d: str) -> DataFrame:
    return pr.dense_histogram(cat.feat(s, d), "jaccard_tokens", 40)


@q("cosine_hist_dense", f"WITH {cat.FEAT}, v AS (SELECT round(cosine_tfidf, 6) AS x FROM feat)" + _DENSE.format(n=40))
def cosine_hist_dense(s: SparkSession, d: str) -> DataFrame:
    return pr.dense_histogram(cat.feat(s, d).withColumn("x", cat.R(F.col("cosine_tfidf"))), "x", 40)


@q("f1_by_class_model", f"""
WITH {cat.PROB}, m AS (SELECT *, 'model_' || CAST(id % 4 AS VARCHAR) AS model FROM pr),
c AS (SELECT model, k AS class, count(*) FILTER (y_true = k AND y_pred = k) AS tp, count(*) FILTER (y_pred = k) AS np, count(*) FILTER (y_true = k) AS nt FROM m, (VALUES (0), (1), (2)) v(k) GROUP BY ALL),
f AS (SELECT model, class, round(coalesce(2.0 * tp / nullif(np + nt, 0), 0.0), 8) AS f1 FROM c)
SELECT model, max(f1) FILTER (class = 0) AS f1_0, max(f1) FILTER (class = 1) AS f1_1, max(f1) FILTER (class = 2) AS f1_2 FROM f GROUP BY model""")
def f1_by_class_model(s: SparkSession, d: str) -> DataFrame:
    scored = cat.prob(s, d).withColumn("model", F.concat(F.lit("model_"), (F.col("id") % 4).cast("string")))
    wide = ev.f1_by_class(scored)
    return wide.select("model", *(cat.R(F.col(c), 8).alias(c) for c in wide.columns[1:]))


@q("tail_compare", f"""
WITH {cat.CLEAN}, a AS (SELECT label, 100.0 * avg(CAST("respA_len" >= 512 AS INT)) AS pct_a FROM clean WHERE row_idx % 2 = 0 GROUP BY label),
b AS (SELECT label, 100.0 * avg(CAST("respB_len" >= 512 AS INT)) AS pct_b FROM clean WHERE row_idx % 3 > 0 AND label <> 2 GROUP BY label)
SELECT label, round(pct_a, 6) AS pct_a, round(pct_b, 6) AS pct_b FROM a JOIN b USING (label)""")
def tail_compare(s: SparkSession, d: str) -> DataFrame:
    """Tail shares of two sets of rows side by side, for the labels that both have."""
    c = cat.clean(s, d)
    share = lambda t, col, name: t.groupBy("label").agg(cat.R(pr.percent(F.col(col) >= 512)).alias(name))
    return share(c.filter("row_idx % 2 = 0"), "respA_len", "pct_a").join(share(c.filter("row_idx % 3 > 0 and label <> 2"), "respB_len", "pct_b"), "label")


_PCT = "count(*) * 100.0 / sum(count(*)) OVER ()"


@q("threshold_flag_lists", f"""
WITH {cat.CLEAN}, b AS (SELECT max(CASE WHEN label = 0 THEN p END) AS a, max(CASE WHEN label = 1 THEN p END) AS b, max(CASE WHEN label = 2 THEN p END) AS t FROM (SELECT label, {_PCT} AS p FROM clean GROUP BY label)),
r AS (SELECT 100 * avg(CAST("respA_len" > 512 AS INT)) AS trunc FROM clean),
f AS (SELECT [CASE WHEN t > 50 THEN 'tie_heavy' END, CASE WHEN a < 25 THEN 'few_a' END, CASE WHEN b < 25 THEN 'few_b' END, CASE WHEN abs(a - b) <= 5 THEN 'a_b_even' END, CASE WHEN trunc > 30 THEN 'trunc_high' WHEN trunc > 20 THEN 'trunc_moderate' END] AS l FROM b, r)
SELECT array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS flags FROM f""")
def threshold_flag_lists(s: SparkSession, d: str) -> DataFrame:
    return pr.threshold_flags(cat.clean(s, d))


@q("class_balance_by_split", f"WITH {cat._SPLIT} SELECT split, label, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY split), 2) AS percent FROM sp GROUP BY split, label")
def class_balance_by_split(s: SparkSession, d: str) -> DataFrame:
    return pr.class_balance_by_split(pf.split(cat.clean(s, d)))


@q("template_clusters_normalised", f"WITH {cat.CLEAN} SELECT row_idx, " + cat._re("lower(response_a_clean || ' || ' || response_b_clean)", "[^a-z0-9]+", " ").join(("trim(", ", ' ')")) + " AS template FROM clean")
def template_clusters_normalised(s: SparkSession, d: str) -> DataFrame:
    return pf.templates(cat.clean(s, d)).select("row_idx", "template")


@q("records_json", "SELECT '[' || string_agg('{\"r_regionkey\":' || CAST(r_regionkey AS VARCHAR) || ',\"r_name\":\"' || r_name || '\"}', ',' ORDER BY r_regionkey) || ']' AS records FROM region")
def records_json(s: SparkSession, d: str) -> DataFrame:
    return pr.records(fx.read(s, d, "region").select("r_regionkey", "r_name"), "r_regionkey")


@q("binned_count", f"WITH {cat.CLEAN} SELECT CAST(floor(\"respA_len\" / 50.0) * 50 AS BIGINT) AS bin_left, count(*) AS count FROM clean GROUP BY 1")
def binned_count(s: SparkSession, d: str) -> DataFrame:
    return pr.binned_count(cat.clean(s, d), "respA_len", 50)
