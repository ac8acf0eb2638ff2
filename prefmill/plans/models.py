"""Queries of strengths, heads, pair encoding, exact quantiles, serialized cells, splits and the audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..operators import audit, encoding, preference as pf, profile as pr, quantiles as qt, scoring, strengths as st
from ..sources import fixtures as fx
from ..sources.store import store
from . import catalog as cat, serving

Q: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ROUNDS = 10
_rounds = "".join(f""",
p{k + 1} AS (SELECT g.i, any_value(o.wins) AS wins, coalesce(any_value(o.wins) / nullif(sum(games / nullif(o.p + x.p, 0)), 0), 0) AS p FROM games g JOIN p{k} o ON o.i = g.i JOIN p{k} x ON x.i = g.j GROUP BY g.i)""" for k in range(ROUNDS))


@q("bt_strengths", f"""
WITH RECURSIVE {cat.BATTLES},
sides AS (SELECT model_a AS i, model_b AS j, CASE WHEN winner_tie = 1 THEN 0.5 WHEN winner_model_a = 1 THEN 1.0 ELSE 0.0 END AS won FROM battles WHERE model_a <> model_b UNION ALL SELECT model_b, model_a, CASE WHEN winner_tie = 1 THEN 0.5 WHEN winner_model_a = 1 THEN 0.0 ELSE 1.0 END FROM battles WHERE model_a <> model_b),
games AS (SELECT i, j, CAST(sum(won) AS DOUBLE) AS wins, count(*) AS games FROM sides GROUP BY ALL),
p0 AS (SELECT i, sum(wins) AS wins, 1.0::DOUBLE AS p FROM games GROUP BY i){_rounds},
reach AS (SELECT i AS r, i AS m FROM p0 UNION SELECT r, j FROM reach JOIN games ON games.i = m),
cp AS (SELECT r AS i, min(m) AS component FROM reach GROUP BY r)
SELECT i AS model, component, round(p / avg(p) OVER (PARTITION BY component), 8) AS strength, wins, CAST((SELECT sum(games) FROM games g WHERE g.i = f.i) AS BIGINT) AS games FROM p{ROUNDS} f JOIN cp USING (i)""")
def bt_strengths(s: SparkSession, d: str) -> DataFrame:
    return st.strengths(fx.battles(s, d), ROUNDS, 0).withColumn("strength", cat.R(F.col("strength"), 8))


#: A head with weights by arithmetic: HIDDEN units over vectors of DIM.
DIM, HIDDEN = 64, 8


def head() -> scoring.Head:
    w1 = [[((k * 7 + i * 3) % 11 - 5) / 10 for i in range(DIM)] for k in range(HIDDEN)]
    return scoring.two_layers(w1, [(k % 3 - 1) / 5 for k in range(HIDDEN)], [[(k * 5 % 7 - 3) / 4 for k in range(HIDDEN)]], [0.125])


_SCORE = f"(0.125 + list_sum(list_transform(range({HIDDEN}), lambda k: ((k * 5) % 7 - 3) / 4.0 * tanh((k % 3 - 1) / 5.0 + list_sum(list_transform(range({DIM}), lambda i: ((k * 7 + i * 3) % 11 - 5) / 10.0 * embedding[i + 1]::DOUBLE))))))"


@q("head_scores", f"SELECT vec_id, CASE WHEN len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 THEN round({_SCORE}, 8) END AS score FROM embeddings")
def head_scores(s: SparkSession, d: str) -> DataFrame:
    rows = fx.read(s, d, "embeddings").select("vec_id", "embedding")
    return scoring.with_scores(rows, head(), {"embedding": "score"}).select("vec_id", cat.R(F.col("score"), 8).alias("score"))


@q("head_predictions", f"""
WITH sc AS (SELECT vec_id, {_SCORE} AS s FROM embeddings),
pr AS (SELECT a.vec_id AS id, greatest(-20, least(20, a.s - b.s)) AS d FROM sc a JOIN sc b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
p AS (SELECT id, 1 / (1 + exp(-d)) AS pa, greatest(0.0, least(0.95, exp(-abs(d)) * 0.5)) AS t FROM pr),
o AS (SELECT id, pa * (1 - t) AS a, (1 - pa) * (1 - t) AS b, t FROM p)
SELECT id, round(a, 8) AS "prob_A", round(b, 8) AS "prob_B", round(t, 8) AS "prob_TIE", CASE WHEN a >= b AND a >= t THEN 'A' WHEN b >= t THEN 'B' ELSE 'TIE' END AS pred_label FROM o""")
def head_predictions(s: SparkSession, d: str) -> DataFrame:
    """Each vector of even id against its neighbour."""
    e = fx.read(s, d, "embeddings").select("vec_id", "embedding")
    pairs = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("vb")), "id")
    out = scoring.predict(pairs, head())
    return out.select("id", *(cat.R(F.col(f"prob_{n}"), 8).alias(f"prob_{n}") for n in ("A", "B", "TIE")), "pred_label")


def pair_format() -> encoding.PairFormat:
    """The word-end vocabulary: its two marks; the begin mark also stands between the texts, 0 fills up."""
    import public_tokenizers

    return encoding.PairFormat(public_tokenizers.path("word_bpe_49k.json"), begin=49406, between=49406, end=49407, pad=0)


@q("pair_input_ids")
def pair_input_ids(s: SparkSession, d: str) -> DataFrame:
    """The encoded prompt and first response of all cleaned rows, as serving pads them."""
    rows = cat.clean(s, d).select("row_idx", "prompt_clean", "response_a_clean")
    return encoding.encode_pairs(rows, pair_format(), "prompt_clean", "response_a_clean", "row_idx")


_AT = (0.05, 0.5, 0.9, 0.99)
_EXACT = " UNION ALL ".join(f"SELECT CAST(label AS VARCHAR) AS \"by\", '{c}' AS \"column\", {at}::DOUBLE AS q, count(x) AS n, round(quantile_cont(x, {at}), 6) AS value FROM (SELECT label, CAST({x} AS DOUBLE) AS x FROM feat) GROUP BY label" for c, x in (("cosine_tfidf", "round(cosine_tfidf, 9)"), ("respA_len", '"respA_len"')) for at in _AT)


@q("exact_quantiles", f"WITH {cat.FEAT} {_EXACT}")
def exact_quantiles(s: SparkSession, d: str) -> DataFrame:
    rows = store(cat.feat(s, d).select("label", cat.R(F.col("cosine_tfidf"), 9).alias("cosine_tfidf"), "respA_len"), "features")
    return qt.quantiles(rows, ["cosine_tfidf", "respA_len"], list(_AT), "label").withColumn("value", cat.R(F.col("value")))


@q("literal_cells", f"""
WITH c AS (SELECT doc_id, text, regexp_replace(text, '^[{cat._S}]+|[{cat._S}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'null') AND NOT contains(text, '\\/') AND doc_id % 5 < 4)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END || 'None' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END || chr(10) || 'éA!' || chr(10) || '[1, ''b'']' AS v FROM c
UNION ALL SELECT doc_id, CASE WHEN lower(t) IN ('', 'nan', 'null', 'none') THEN NULL ELSE t END FROM (SELECT doc_id, regexp_replace(text, '^[{cat._S}]+|[{cat._S}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL AND NOT contains(text, 'null') AND NOT contains(text, '\\/') AND doc_id % 5 = 4)""")
def literal_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells made of whole texts; those with `null` or an escaped slash are in the tests."""
    text = F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    one, two = (F.replace(text, F.lit(x), F.lit("\\" + x)) for x in ("'", '"'))
    cell = F.when(F.col("doc_id") % 5 == 4, F.col("text")).otherwise(F.concat(F.lit("['"), one, F.lit("', None , \""), two, F.lit("\",'\\u00e9\\x41'  \"!\", [1, 'b'], ' ']")))
    rows = cat.docs(s, d).filter(F.col("text").isNotNull() & ~F.col("text").contains("null") & ~F.col("text").contains("\\/"))
    return rows.select("doc_id", tx.literal_cell(cell).alias("v"))


@q("stratified_split_shares", f"WITH {cat.CLEAN} SELECT label, count(*) AS n, true AS near_a_tenth, CAST(0 AS BIGINT) AS groups_on_both FROM clean GROUP BY label")
def stratified_split_shares(s: SparkSession, d: str) -> DataFrame:
    """What the split promises: a tenth of each label to within a point, and no group on both sides."""
    rows = store(pf.stratified_split(cat.clean(s, d)).select("prompt_sig", "label", "split"), "sides")
    both = rows.groupBy("prompt_sig").agg(F.countDistinct("split").alias("n")).filter("n > 1").count()
    share = F.avg((F.col("split") == "valid").cast("double"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), (F.abs(share - 0.1) <= 0.01).alias("near_a_tenth"), F.lit(both).cast("long").alias("groups_on_both"))


_TPL = cat._TPL[cat._TPL.index("tf AS (SELECT row_idx") :]
_NORM = cat._re("lower(response_a_clean || ' || ' || response_b_clean)", "[^a-z0-9]+", " ").join(("trim(", ", ' ')"))
_INFO = " + ".join(f"CASE WHEN trim({c}) = 'no response' THEN 0 ELSE {cat._len(c)} END" for c in ("response_a_clean", "response_b_clean"))


@q("template_clusters_kept", f"""
WITH RECURSIVE {cat.CLEAN}, t AS (SELECT row_idx, prompt_sig, {_NORM} AS template, {_INFO} AS info FROM clean), {_TPL},
rp AS (SELECT row_idx, t.prompt_sig, component, n FROM (SELECT t.*, component, row_number() OVER (PARTITION BY prompt_sig, component ORDER BY info DESC, row_idx) AS r FROM t JOIN cp USING (row_idx)) t JOIN gs USING (prompt_sig) WHERE r = 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY prompt_sig ORDER BY component) AS place FROM rp)
SELECT row_idx, prompt_sig, component, place FROM pl WHERE n <= 10 OR place <= 8""")
def template_clusters_kept(s: SparkSession, d: str) -> DataFrame:
    """Clusters of normalised templates of whole responses."""
    return pf.cluster_templates(pf.templates(cat.clean(s, d)))


_SIDES = cat.FEAT + ", sp AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(prompt_sig), 1, 6) AS BIGINT) % 10 = 0 THEN 'valid' ELSE 'train' END AS split FROM feat)"
_pct = lambda cond: f"coalesce(100 * avg(CAST({cond} AS INT)), 0.0)"
_AUDIT = _SIDES + f""",
ag AS (SELECT split, count(*) AS n, {", ".join(f"{_pct(f'label = {k}')} AS pct_{k}, count(*) FILTER (label = {k}) AS n_{k}" for k in range(3))}, {", ".join(f'{_pct(chr(34) + c + chr(34) + " > 200")} AS "trunc_{n}"' for n, c in audit.LENGTHS.items())},
  {_pct("round(cosine_tfidf, 9) >= 0.9")} AS cosine_high, {_pct("jaccard_tokens >= 0.8")} AS jaccard_high, avg(cosine_tfidf) AS cm, avg(jaccard_tokens) AS jm, count(*) FILTER ({pf.NEAR_REPORT}) AS near FROM sp GROUP BY split),
al AS (SELECT split, label, avg("respA_len") AS am, stddev_samp("respA_len") AS astd, avg("respB_len") AS bm, stddev_samp("respB_len") AS bstd FROM sp GROUP BY ALL),
ak AS (SELECT sum(t) AS n_train, sum(v) AS n_valid, sum(t * v) AS n_both FROM (SELECT prompt_sig, max(CAST(split = 'train' AS INT)) AS t, max(CAST(split = 'valid' AS INT)) AS v FROM sp GROUP BY 1))"""


def _sides(s: SparkSession, d: str) -> DataFrame:
    return store(pf.split(cat.narrow(s, d)), "sides")


@q("audit_flags", f"""
WITH {_AUDIT}
SELECT split, flag FROM (SELECT split, unnest([CASE WHEN pct_2 > 50 THEN 'tie_heavy' END, CASE WHEN pct_0 < 25 THEN 'few_a' END, CASE WHEN pct_1 < 25 THEN 'few_b' END, {", ".join(f"""CASE WHEN "trunc_{n}" > 30 THEN '{n}_truncated_high' WHEN "trunc_{n}" > 20 THEN '{n}_truncated_moderate' END""" for n in audit.LENGTHS)}, CASE WHEN cosine_high >= 15 OR jaccard_high >= 15 THEN 'similar' END]) AS flag FROM ag) WHERE flag IS NOT NULL
UNION ALL SELECT 'all', 'near_duplicates' FROM ag HAVING sum(near) > 0 AND sum(near) * 100 >= 15 * sum(n)
UNION ALL SELECT split, 'even_lengths_' || CAST(label AS VARCHAR) FROM al WHERE abs(am - bm) <= 5""")
def audit_flags(s: SparkSession, d: str) -> DataFrame:
    return audit.flags(_sides(s, d), 200)


@q("audit_log", f"""
WITH {_AUDIT}
SELECT 1 AS section, split, 0 AS place, printf('A=%.2f%% (n=%d) | B=%.2f%% (n=%d) | TIE=%.2f%% (n=%d)', round(pct_0, 2), n_0, round(pct_1, 2), n_1, round(pct_2, 2), n_2) AS line FROM ag
UNION ALL SELECT 2, split, 0, printf('prompt=%.2f%% | respA=%.2f%% | respB=%.2f%%', round("trunc_prompt", 2), round("trunc_respA", 2), round("trunc_respB", 2)) FROM ag
UNION ALL SELECT 3, split, 0, printf('mean cosine=%.3f | mean jaccard=%.3f | cosine>=0.9: %.2f%% | jaccard>=0.8: %.2f%%', round(cm, 3), round(jm, 3), round(cosine_high, 2), round(jaccard_high, 2)) FROM ag
UNION ALL SELECT 4, split, 0, printf('near duplicates: %d of %d', near, n) FROM ag
UNION ALL SELECT 5, split, CAST(label AS INT), printf('label=%d | A mean=%.1f (std %.1f) | B mean=%.1f (std %.1f)', label, round(am, 1), coalesce(round(astd, 1), 0.0), round(bm, 1), coalesce(round(bstd, 1), 0.0)) FROM al
UNION ALL SELECT 6, 'all', 0, printf('prompts: train=%d | valid=%d | both=%d (%.2f%%)', CAST(n_train AS BIGINT), CAST(n_valid AS BIGINT), CAST(n_both AS BIGINT), round(n_both * 100.0 / greatest(1, least(n_train, n_valid)), 2)) FROM ak""")
def audit_log(s: SparkSession, d: str) -> DataFrame:
    return audit.log(_sides(s, d), 200)


_SIDE = lambda x: ", ".join(f"round_even(100.0 * count(*) FILTER (split = '{x}' AND label = {k}) / count(*) FILTER (split = '{x}'), 2) AS pct_{x}_{k}" for k in range(3))


@q("split_metadata", f"""
WITH {cat._SPLIT}, r AS (SELECT prompt_sig, split, label, "respA_len", "respB_len", 0 AS s FROM sp UNION ALL SELECT prompt_sig, split, CASE label WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE label END, "respA_len", "respB_len", 1 FROM sp WHERE split = 'train'),
k AS (SELECT CAST(sum(t) AS BIGINT) AS a, CAST(sum(v) AS BIGINT) AS b, CAST(sum(t * v) AS BIGINT) AS c FROM (SELECT prompt_sig, max(CAST(split = 'train' AS INT)) AS t, max(CAST(split = 'valid' AS INT)) AS v FROM r GROUP BY 1))
SELECT x.*, a AS prompts_unique_train, b AS prompts_unique_valid, c AS prompts_intersection_count, round_even(c * 100.0 / greatest(1, least(a, b)), 2) AS prompts_intersection_pct, {", ".join(f"{v}::DOUBLE AS {n}" for n, v in audit.THRESHOLDS.items())}
FROM (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'valid') AS n_valid, {_SIDE('train')}, {_SIDE('valid')}, round_even(100.0 * count(*) FILTER (split = 'train' AND s = 1) / count(*) FILTER (split = 'train'), 2) AS is_swapped_train_pct, quantile_cont("respA_len", 0.99) FILTER (s = 0) AS "p99_respA", quantile_cont("respB_len", 0.99) FILTER (s = 0) AS "p99_respB" FROM r) x, k""")
def split_metadata(s: SparkSession, d: str) -> DataFrame:
    sides = pf.split(cat.clean(s, d))
    return audit.split_metadata(pf.swap_union(sides.filter("split = 'train'").drop("split")), sides.filter("split = 'valid'").drop("split"))


@q("sample_texts", f"WITH {cat._SPLIT} SELECT split, row_idx, {', '.join(audit.TEXTS)} FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(CAST(row_idx AS VARCHAR) || ':42'), row_idx) AS r FROM sp) WHERE r <= 60")
def sample_texts(s: SparkSession, d: str) -> DataFrame:
    return audit.sample_texts(pf.split(cat.clean(s, d)))


_CLIP = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS x FROM clean" for c in cat.LENS)


@q("length_hist_clipped_all", f"WITH {cat.CLEAN}, lg AS ({_CLIP}), en AS (SELECT feature, quantile_cont(x, 0.99) AS cap, min(x) AS lo FROM lg GROUP BY 1) SELECT feature, CAST(least(floor(coalesce((least(x, cap) - lo) / nullif(cap - lo, 0), 0) * 50), 49) AS INT) AS bin, count(*) AS count FROM lg JOIN en USING (feature) GROUP BY ALL")
def length_hist_clipped_all(s: SparkSession, d: str) -> DataFrame:
    return pr.clipped_histograms(cat.clean(s, d), cat.LENS)


@q("trunc_cols", f"WITH {cat.CLEAN} SELECT count(*) AS n_rows, {', '.join(f'{_pct(chr(34) + c + chr(34) + chr(32) + chr(62) + chr(32) + str(200))} AS {chr(34)}pct_{n}_truncated{chr(34)}' for n, c in audit.LENGTHS.items())} FROM clean")
def trunc_cols(s: SparkSession, d: str) -> DataFrame:
    return pr.trunc_cols(cat.clean(s, d), 200)


_cell = lambda c: f"coalesce({cat._clean(f'replace({c}, {chr(39)}null{chr(39)}, {chr(39)}{chr(34) * 2}{chr(39)})')}, '')"
_tokens = lambda c: f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


@q("serving_batch", f"""
WITH {cat.BATTLES}, c AS (SELECT id, {_cell('prompt')} AS p, {_cell('response_a')} AS a, {_cell('response_b')} AS b FROM battles),
n AS (SELECT *, {_tokens('p')} AS tp, len({_tokens('a')}) AS na, len({_tokens('b')}) AS nb FROM c),
w AS (SELECT *, na > 288 OR na >= quantile_cont(na, 0.99) OVER () AS ca, nb > 288 OR nb >= quantile_cont(nb, 0.99) OVER () AS cb FROM n)
SELECT id, CASE WHEN len(tp) <= 96 THEN p ELSE array_to_string(list_concat(list_concat(list_slice(tp, 1, 48), ['…']), list_slice(tp, len(tp) - 15, len(tp))), ' ') END AS prompt_clean,
CASE WHEN NOT ca THEN a END AS response_a_clean, true AS response_a_fits, CASE WHEN NOT cb THEN b END AS response_b_clean, true AS response_b_fits FROM w""")
def serving_batch(s: SparkSession, d: str) -> DataFrame:
    """The whole batch through serving: prompts, responses that stay as they are, and whether the others have come within
    their limit. What compression makes of a text is in the tests."""
    texts = store(pf.serving_texts(fx.battles(s, d)), "batch")
    after = pf.tail_control(texts, pf.length_limits(texts)).select(*pf.SERVING_OUT)
    return serving.controlled(texts.select("id", "response_a_clean", "response_b_clean"), after)
