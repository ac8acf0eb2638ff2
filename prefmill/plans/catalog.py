"""Queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity as sim, text as tx
from ..operators import evaluation as ev, preference as pf, profile as pr
from ..sources import fixtures as fx

STOP = ("the", "of", "and", "de", "la", "der", "en", "to")
LENS = ("prompt_len", "respA_len", "respB_len")
R = lambda c, k=6: F.round(c, k)

# ---- SQL building blocks -------------------------------------------------------------------------------------------
_S = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_W = r"\p{L}\p{N}_"


def _re(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _collapse(x: str) -> str:
    return f"trim({_re(x, f'[{_S}]+', ' ')}, ' ')"


def _clean(x: str, punct: bool = True) -> str:
    x = f"lower({x})"
    for p in (rf"(https?://[^{_S}]+|www\.[^{_S}]+)", f"@[{_W}]+", f"#[{_W}]+"):
        x = _re(x, p, " ")
    return f"nullif({_collapse(_re(x, f'[^{_W}{_S}.,!?;:]' if punct else f'[^{_W}{_S}]', ' '))}, '')"


def _len(x: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '[{_S}]+'), lambda t: t <> ''))"


def _sig(x: str) -> str:
    base = _re(f"lower(coalesce({x}, ''))", r"[\t\r\n]+", " ")
    return _re(_collapse(_re(base, f"[^{_W}{_S}.,!?;:]", " ")), r"\p{Nd}+", "<num>")


def _fill(x: str) -> str:
    return rf"CASE WHEN regexp_matches(trim(coalesce({x}, '')), '(?i)^(n/?a|na|none|no\s*answer|no\s*response)?$') THEN 'no response' ELSE trim(coalesce({x}, '')) END"


BATTLES = """s AS (SELECT doc_id, text, row_number() OVER (ORDER BY text, doc_id) - 1 AS rn FROM documents),
p AS (SELECT CAST(floor(rn / 2.0) AS BIGINT) AS row_idx, max(CASE WHEN rn % 2 = 0 THEN text END) AS response_a, max(CASE WHEN rn % 2 = 1 THEN text END) AS response_b, min(doc_id) AS d FROM s GROUP BY 1),
battles AS (SELECT p.row_idx, p.row_idx AS id, b.text AS prompt, response_a, response_b, 'model_' || CAST(d % 7 AS VARCHAR) AS model_a, 'model_' || CAST(d % 5 AS VARCHAR) AS model_b,
  CASE WHEN d % 3 = 0 THEN 1 ELSE 0 END AS winner_model_a, CASE WHEN d % 3 = 1 THEN 1 ELSE 0 END AS winner_model_b, CASE WHEN d % 3 = 2 THEN 1 ELSE 0 END AS winner_tie
  FROM p CROSS JOIN (SELECT count(*) AS n FROM benchmark) n JOIN benchmark b ON b.item_id = p.row_idx % n.n WHERE response_b IS NOT NULL)"""
_LABEL = "CASE WHEN winner_tie = 1 THEN 2 WHEN winner_model_a = 1 THEN 0 ELSE 1 END"
CLEAN = BATTLES + f""",
c0 AS (SELECT *, {_clean('prompt')} AS prompt_clean, {_fill(_clean('response_a'))} AS response_a_clean, {_fill(_clean('response_b'))} AS response_b_clean, {_LABEL} AS label FROM battles),
clean AS (SELECT *, {_sig('prompt_clean')} AS prompt_sig, {_len('prompt_clean')} AS prompt_len, {_len('response_a_clean')} AS "respA_len", {_len('response_b_clean')} AS "respB_len" FROM c0 WHERE prompt_clean IS NOT NULL)"""


def _tfidf(table: str, key: str, a: str, b: str) -> str:
    """CTEs ending with cos(key, cosine_tfidf)."""
    term = lambda x: f"unnest(regexp_extract_all(lower(coalesce({x}, '')), '[{_W}]{{2,}}'))"
    return f"""tk AS (SELECT {key}, 0 AS side, {term(a)} AS term FROM {table} UNION ALL SELECT {key}, 1, {term(b)} FROM {table}),
tf AS (SELECT {key}, side, term, count(*) AS tf FROM tk GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT {key}, side, term, tf * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (term) CROSS JOIN (SELECT 2 * count(*) AS n FROM {table})),
nm AS (SELECT {key}, sqrt(sum(CASE WHEN side = 0 THEN w * w END)) AS na, sqrt(sum(CASE WHEN side = 1 THEN w * w END)) AS nb FROM wt GROUP BY 1),
dt AS (SELECT x.{key}, sum(x.w * y.w) AS num FROM wt x JOIN wt y ON x.{key} = y.{key} AND x.term = y.term AND x.side = 0 AND y.side = 1 GROUP BY 1),
cos AS (SELECT t.{key}, coalesce(num / (na * nb) / (1 + 1e-12), 0.0) AS cosine_tfidf FROM {table} t LEFT JOIN nm USING ({key}) LEFT JOIN dt USING ({key}))"""


def _jac(a: str, b: str) -> str:
    t = lambda x: f"list_distinct(list_filter(string_split_regex(coalesce({x}, ''), '[{_S}]+'), lambda t: t <> ''))"
    inter = f"len(list_intersect({t(a)}, {t(b)}))"
    return f"CASE WHEN len({t(a)}) + len({t(b)}) = 0 THEN 1.0 ELSE CAST({inter} AS DOUBLE) / greatest(len({t(a)}) + len({t(b)}) - {inter}, 1) END"


FEAT = CLEAN + ",\n" + _tfidf("clean", "row_idx", "response_a_clean", "response_b_clean") + f""",
feat AS (SELECT clean.*, cosine_tfidf, {_jac('response_a_clean', 'response_b_clean')} AS jaccard_tokens, abs("respA_len" - "respB_len") AS abs_len_diff FROM clean JOIN cos USING (row_idx))"""
FLAGS = FEAT + f""",
fl0 AS (SELECT *, ({pf.HARD}) AS hard, ({pf.NEAR_SAME}) AS near_same, ({pf.NEAR_CROSS}) AS near_cross, ({pf.TIE_TRIVIAL}) AS tie_trivial,
  CASE WHEN trim(response_a_clean) = 'no response' THEN 0 ELSE "respA_len" END + CASE WHEN trim(response_b_clean) = 'no response' THEN 0 ELSE "respB_len" END AS info FROM feat),
fl1 AS (SELECT *, row_number() OVER (PARTITION BY prompt_sig, near_same ORDER BY info DESC, row_idx) AS r_near, row_number() OVER (PARTITION BY prompt_sig, tie_trivial ORDER BY info DESC, row_idx) AS r_tie, count(*) OVER (PARTITION BY prompt_sig) AS g FROM fl0),
flags AS (SELECT *, NOT ((near_same AND g > 1 AND r_near > 1) OR near_cross OR hard OR (tie_trivial AND r_tie > 1)) AS keep FROM fl1)"""
SCORES = BATTLES + f""",
scores AS (SELECT row_idx AS id, {_LABEL} AS y_true, ((row_idx * 37) % 101) / 25.0 - 2.0 AS s_a, ((row_idx * 53) % 97) / 24.0 - 2.0 AS s_b, ((row_idx * 11) % 7) / 3.0 AS z_a, ((row_idx * 13) % 5) / 2.0 AS z_b, CAST((row_idx * 17) % 3 AS DOUBLE) AS z_tie FROM battles)"""
PROB = SCORES + """,
sm AS (SELECT *, exp(z_a - greatest(z_a, z_b, z_tie)) AS ea, exp(z_b - greatest(z_a, z_b, z_tie)) AS eb, exp(z_tie - greatest(z_a, z_b, z_tie)) AS et FROM scores),
pr0 AS (SELECT *, ea / (ea + eb + et) AS p_a, eb / (ea + eb + et) AS p_b, et / (ea + eb + et) AS p_tie FROM sm),
pr AS (SELECT *, CASE WHEN p_a >= p_b AND p_a >= p_tie THEN 0 WHEN p_b >= p_tie THEN 1 ELSE 2 END AS y_pred FROM pr0)"""
REPORT = PROB + """,
cr AS (SELECT k AS class, sum(CASE WHEN y_true = k AND y_pred = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_pred = k THEN 1 ELSE 0 END) AS np, sum(CASE WHEN y_true = k THEN 1 ELSE 0 END) AS nt FROM pr, (VALUES (0), (1), (2)) v(k) GROUP BY k),
rep0 AS (SELECT class, coalesce(tp / nullif(np, 0), 0.0) AS precision, coalesce(tp / nullif(nt, 0), 0.0) AS recall FROM cr),
rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM rep0)"""


Q: dict = {}
SQL: dict = {}


def q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def docs(s, d):
    return fx.read(s, d, "documents").select("doc_id", "text")


def clean(s, d):
    return pf.clean_base(fx.battles(s, d))


def feat(s, d):
    return pf.features(clean(s, d).drop("prompt", "response_a", "response_b", "prompt_clean"))


def narrow(s, d):
    """Rows with features and without texts."""
    return feat(s, d).drop("response_a_clean", "response_b_clean")


def flags(s, d):
    return pf.dedup_flags(narrow(s, d))


def prob(s, d):
    return ev.argmax(ev.softmax(fx.scores(s, d)))


def _text(name, builder, sql, column="v"):
    q(name, f"SELECT doc_id, {sql} AS {column} FROM documents")(lambda s, d: docs(s, d).select("doc_id", builder(F.col("text")).alias(column)))


_cell = "CASE WHEN doc_id % 4 = 0 THEN '[\"' || CAST(doc_id AS VARCHAR) || '\", null, \"b\"]' WHEN doc_id % 4 = 1 THEN 'null' WHEN doc_id % 4 = 2 THEN '[]' ELSE 'plain ' || CAST(doc_id AS VARCHAR) END"
_text("clean_text_keep", lambda c: tx.clean_text(c), _clean("text"))
_text("clean_text_nopunct", lambda c: tx.clean_text(c, keep_punct=False), _clean("text", False))
_text("clean_text_stopwords", lambda c: tx.clean_text(c, STOP), f"nullif(array_to_string(list_filter(string_split({_clean('text')}, ' '), lambda t: NOT list_contains({list(STOP)}, t)), ' '), '')")
_text("prompt_sig", tx.prompt_sig, _sig("text"))
_text("normalize_digits", tx.normalize_digits, _re("text", r"\p{Nd}+", "<num>"))
_text("token_len", tx.token_len, _len("text"))
_text("info_len", tx.info_len, f"CASE WHEN trim(text) = 'no response' THEN 0 ELSE {_len('text')} END")
_text("shorten_preview", tx.shorten, "CASE WHEN length(text) <= 160 THEN text ELSE left(text, 160) || '...' END")
_text("template_norm", lambda c: tx.template_norm(F.substring(c, 1, 200), F.substring(c, 201, 200)), _re("lower(left(text, 200) || ' || ' || substr(text, 201, 200))", "[^a-z0-9]+", " ").join(("trim(", ", ' ')")))
q("template_norm_pairs", f"WITH {CLEAN} SELECT row_idx, " + _re("lower(response_a_clean || ' || ' || response_b_clean)", "[^a-z0-9]+", " ").join(("trim(", ", ' ')")) + " AS v FROM clean")(lambda s, d: clean(s, d).select("row_idx", tx.template_norm(F.col("response_a_clean"), F.col("response_b_clean")).alias("v")))
_text("no_response_fill", lambda c: tx.fill_no_response(F.when(F.length(c) % 3 == 0, "N/A").when(F.length(c) % 3 == 1, "no  answer").otherwise(c)), _fill("(CASE WHEN length(text) % 3 = 0 THEN 'N/A' WHEN length(text) % 3 = 1 THEN 'no  answer' ELSE text END)"))
_tok = f"list_filter(string_split_regex(coalesce(text, ''), '[{_S}]+'), lambda t: t <> '')"
_text("head_tail", lambda c: F.array_join(tx.head_tail(tx.tokens(c), 96, 32), " "), f"array_to_string(CASE WHEN len({_tok}) <= 128 THEN {_tok} ELSE list_concat(list_concat(list_slice({_tok}, 1, 96), ['…']), list_slice({_tok}, -32, -1)) END, ' ')")
_text("mini_prompt", tx.mini_prompt, f"CASE WHEN len({_tok}) > 96 THEN array_to_string(list_concat(list_concat(list_slice({_tok}, 1, 48), ['…']), list_slice({_tok}, -16, -1)), ' ') ELSE text END")
_text("sanitize_text", tx.sanitize, _collapse(_re("text", r"[\x00-\x1F\x7F-\x{9F}]", " ")))
_text("valid_utf8", tx.valid_utf8, "text")
_text("response_target", lambda c: tx.response_target(F.length(c) % 200), "CAST(round_even(greatest(120.0, least(160.0, (387 - least(length(text) % 200, 96) - 9) / 2.0)), 0) AS INTEGER)")
_text("sentence_count", lambda c: F.size(tx.split_sentences(c)), f"len(list_filter(string_split_regex({_re(_collapse('text'), '([.?!]) +', chr(92) + '1' + chr(1))}, '{chr(1)}'), lambda t: trim(t) <> ''))")
q("strip_boilerplate")(lambda s, d: docs(s, d).select("doc_id", tx.strip_boilerplate(F.concat(F.lit("Hello, "), "text", F.lit(" thanks, bye"))).alias("v")))
q("collapse_repeats")(lambda s, d: docs(s, d).select("doc_id", tx.collapse_repeats(F.col("text")).alias("v")))
q("sample_middle")(lambda s, d: docs(s, d).select("doc_id", F.array_join(tx.sample_middle(tx.tokens(F.col("text")), 150), " ").alias("v")))
q("list_cell_parse", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) || chr(10) || 'b' WHEN 3 THEN 'plain ' || CAST(doc_id AS VARCHAR) END AS v FROM documents")(lambda s, d: docs(s, d).select("doc_id", tx.list_cell(F.expr(_cell.replace("VARCHAR", "STRING"))).alias("v")))
q("to_text", "SELECT conv_id, turn, " + _collapse("text") + " AS v FROM conversations")(lambda s, d: fx.read(s, d, "conversations").select("conv_id", "turn", tx.to_text(F.col("text")).alias("v")))
q("scan_filter_project", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")(lambda s, d: fx.read(s, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_totalprice"))
q("battles", f"WITH {BATTLES} SELECT * FROM battles")(lambda s, d: fx.battles(s, d))
q("label_generate", f"WITH {BATTLES} SELECT row_idx, {_LABEL} AS label FROM battles")(lambda s, d: pf.generate_label(fx.battles(s, d)).select("row_idx", "label"))
q("label_invalid_drop", f"WITH {BATTLES} SELECT row_idx, {_LABEL} AS label FROM battles WHERE row_idx % 11 <> 0")(lambda s, d: pf.generate_label(fx.battles(s, d).withColumns({c: F.when(F.col("row_idx") % 11 == 0, 0).otherwise(F.col(c)) for c in ("winner_model_a", "winner_model_b", "winner_tie")})).select("row_idx", "label"))
_c = "row_idx, prompt_clean, response_a_clean, response_b_clean, prompt_sig, label, prompt_len, \"respA_len\", \"respB_len\""
q("clean_base", f"WITH {CLEAN} SELECT {_c} FROM clean")(lambda s, d: clean(s, d).select(*(x.strip().strip('"') for x in _c.split(","))))
q("jaccard_pairs", f"WITH {FEAT} SELECT row_idx, round(jaccard_tokens, 6) AS jaccard_tokens FROM feat")(lambda s, d: clean(s, d).select("row_idx", R(sim.jaccard(F.col("response_a_clean"), F.col("response_b_clean"))).alias("jaccard_tokens")))
q("tfidf_cosine_pairs", f"WITH {FEAT} SELECT row_idx, round(cosine_tfidf, 6) AS cosine_tfidf FROM feat")(lambda s, d: feat(s, d).select("row_idx", R(F.col("cosine_tfidf")).alias("cosine_tfidf")))
q("pair_similarity", f"WITH {FEAT} SELECT row_idx, round(cosine_tfidf, 6) AS cosine_tfidf, round(jaccard_tokens, 6) AS jaccard_tokens, abs_len_diff FROM feat")(lambda s, d: feat(s, d).select("row_idx", R(F.col("cosine_tfidf")).alias("cosine_tfidf"), R(F.col("jaccard_tokens")).alias("jaccard_tokens"), "abs_len_diff"))
q("similarity_summary", f"WITH {FEAT} SELECT round(avg(cosine_tfidf), 6) AS mean_cos, round(avg(jaccard_tokens), 6) AS mean_jac, round(100 * avg(CAST(cosine_tfidf >= 0.9 AS INT)), 6) AS pct_cos, round(100 * avg(CAST(jaccard_tokens >= 0.8 AS INT)), 6) AS pct_jac FROM feat")(lambda s, d: feat(s, d).agg(R(F.avg("cosine_tfidf")).alias("mean_cos"), R(F.avg("jaccard_tokens")).alias("mean_jac"), R(pr.percent(F.col("cosine_tfidf") >= 0.9)).alias("pct_cos"), R(pr.percent(F.col("jaccard_tokens") >= 0.8)).alias("pct_jac")))
q("near_dup_list", f"WITH {FEAT} SELECT row_idx, label, CASE WHEN length(response_a_clean) <= 160 THEN response_a_clean ELSE left(response_a_clean, 160) || '...' END AS response_a_preview FROM feat WHERE round(jaccard_tokens, 6) >= 0.95 OR round(cosine_tfidf, 6) >= 0.95")(lambda s, d: feat(s, d).filter((R(F.col("jaccard_tokens")) >= 0.95) | (R(F.col("cosine_tfidf")) >= 0.95)).select("row_idx", "label", tx.shorten(F.col("response_a_clean")).alias("response_a_preview")))
q("near_dup_count", f"WITH {FEAT} SELECT count(*) AS n FROM feat WHERE {pf.NEAR_REPORT}")(lambda s, d: feat(s, d).filter(pf.NEAR_REPORT).agg(F.count("*").alias("n")))
q("dedup_flags", f"WITH {FLAGS} SELECT row_idx, hard, near_same, near_cross, tie_trivial, info FROM flags")(lambda s, d: flags(s, d).select("row_idx", "hard", "near_same", "near_cross", "tie_trivial", "info"))
q("dedup_rows", f"WITH {FLAGS} SELECT row_idx, prompt_sig, label FROM flags WHERE keep")(lambda s, d: flags(s, d).filter("keep").select("row_idx", "prompt_sig", "label"))
q("dedup_best_of_group", f"WITH {FLAGS} SELECT prompt_sig, row_idx, info FROM flags WHERE near_same AND r_near = 1")(lambda s, d: flags(s, d).filter("near_same").groupBy("prompt_sig").agg(F.max_by(F.struct("row_idx", "info"), F.struct("info", -F.col("row_idx"))).alias("x")).select("prompt_sig", "x.*"))
q("dedup_trivial_tie", f"WITH {FLAGS} SELECT prompt_sig, row_idx FROM flags WHERE tie_trivial AND r_tie = 1")(lambda s, d: flags(s, d).filter("tie_trivial").groupBy("prompt_sig").agg(F.max_by("row_idx", F.struct("info", -F.col("row_idx"))).alias("row_idx")))
q("dedup_meta", f"WITH {FLAGS} SELECT count(*) FILTER (hard) AS removed_hard, count(*) FILTER (NOT keep AND NOT hard) AS removed_near, count(*) FILTER ((near_same OR near_cross) AND keep) AS kept_near, count(*) FILTER (NOT keep) AS removed_total FROM flags")(lambda s, d: pf.dedup_meta(flags(s, d)))


def _templates(s, d):
    return fx.template_rows(s, d).withColumn("info", tx.info_len(F.col("template")))


_TPL = f"""s AS (SELECT doc_id, text, row_number() OVER (ORDER BY text, doc_id) - 1 AS rn FROM documents),
t AS (SELECT rn AS row_idx, CAST(floor(rn / 16.0) AS BIGINT) AS prompt_sig, text AS template, {_len('text')} AS info FROM s),
tf AS (SELECT row_idx, prompt_sig, term, count(*) AS tf FROM (SELECT row_idx, prompt_sig, unnest(regexp_extract_all(lower(template), '[{_W}]{{2,}}')) AS term FROM t) GROUP BY ALL),
dfs AS (SELECT prompt_sig, term, count(*) AS df FROM tf GROUP BY ALL), gs AS (SELECT prompt_sig, count(*) AS n FROM t GROUP BY 1),
wt AS (SELECT row_idx, prompt_sig, term, tf * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN dfs USING (prompt_sig, term) JOIN gs USING (prompt_sig)),
nm AS (SELECT row_idx, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1),
ed AS (SELECT prompt_sig, a, b, cosine FROM (SELECT x.prompt_sig, x.row_idx AS a, y.row_idx AS b, sum(x.w * y.w) / any_value(nx.norm * ny.norm) AS cosine FROM wt x JOIN wt y ON x.prompt_sig = y.prompt_sig AND x.term = y.term AND x.row_idx < y.row_idx JOIN nm nx ON nx.row_idx = x.row_idx JOIN nm ny ON ny.row_idx = y.row_idx GROUP BY 1, 2, 3) WHERE cosine >= 0.985),
both_ AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
reach AS (SELECT row_idx AS r, row_idx AS m FROM t UNION SELECT reach.r, both_.b FROM reach JOIN both_ ON both_.a = reach.m),
cp AS (SELECT r AS row_idx, min(m) AS component FROM reach GROUP BY 1)"""
q("template_edges", f"WITH RECURSIVE {_TPL} SELECT prompt_sig, a, b, round(cosine, 5) AS cosine FROM ed")(lambda s, d: pf.template_edges(fx.template_rows(s, d)).withColumn("cosine", R(F.col("cosine"), 5)))
q("template_components", f"WITH RECURSIVE {_TPL} SELECT row_idx, component FROM cp")(lambda s, d: (lambda t: pf.components(t, pf.template_edges(t)))(fx.template_rows(s, d)))
q("template_cap_topk", f"WITH RECURSIVE {_TPL}, rp AS (SELECT row_idx, t.prompt_sig, component, n FROM (SELECT t.*, component, row_number() OVER (PARTITION BY prompt_sig, component ORDER BY info DESC, row_idx) AS r FROM t JOIN cp USING (row_idx)) t JOIN gs USING (prompt_sig) WHERE r = 1), pl AS (SELECT *, row_number() OVER (PARTITION BY prompt_sig ORDER BY component) AS place FROM rp) SELECT row_idx, prompt_sig, component, place FROM pl WHERE n <= 10 OR place <= 8")(lambda s, d: pf.cluster_templates(_templates(s, d)))
_REPS = ", rp AS (SELECT prompt_sig, max(n) AS g, count(*) AS reps FROM (SELECT DISTINCT t.prompt_sig, component, n FROM t JOIN cp USING (row_idx) JOIN gs USING (prompt_sig)) GROUP BY 1)"
q("template_cluster_meta", f"WITH RECURSIVE {_TPL}{_REPS} SELECT CAST(coalesce(sum(reps), 0) AS BIGINT) AS clusters_kept, count(*) FILTER (g > 10 AND reps > 8) AS capped_prompts, CAST(8 AS BIGINT) AS max_per_prompt FROM rp WHERE g > 1")(lambda s, d: pf.cluster_meta(pf.template_clusters(_templates(s, d))))
_controlled = ("row_idx", "prompt_clean", "response_a_clean", "response_b_clean", "respA_len", "respB_len")
q("tail_control")(lambda s, d: pf.tail_control(clean(s, d).select(*_controlled, "prompt_len")).select(*_controlled))
_SPLIT = CLEAN + ", sp AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(prompt_sig), 1, 6) AS BIGINT) % 10 = 0 THEN 'valid' ELSE 'train' END AS split FROM clean)"
q("group_split", f"WITH {_SPLIT} SELECT row_idx, split FROM sp")(lambda s, d: pf.split(clean(s, d)).select("row_idx", "split"))
q("stratified_split")(lambda s, d: pf.stratified_split(clean(s, d)).select("row_idx", "label", "split"))
q("split_leakage", f"WITH {_SPLIT}, g AS (SELECT prompt_sig, max(CAST(split = 'train' AS INT)) AS t, max(CAST(split = 'valid' AS INT)) AS v FROM sp GROUP BY 1), a AS (SELECT CAST(sum(t) AS BIGINT) AS n_train, CAST(sum(v) AS BIGINT) AS n_valid, CAST(sum(t * v) AS BIGINT) AS n_both FROM g) SELECT *, round_even(n_both * 100.0 / greatest(1, least(n_train, n_valid)), 2) AS pct FROM a")(lambda s, d: pr.leakage(pf.split(clean(s, d))))
q("swap_union", f"WITH {CLEAN} SELECT row_idx, response_a_clean, model_a, label, 0 AS is_swapped FROM clean UNION ALL SELECT row_idx, response_b_clean, model_b, CASE label WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE label END, 1 FROM clean")(lambda s, d: pf.swap_union(clean(s, d)).select("row_idx", "response_a_clean", "model_a", "label", "is_swapped"))
q("class_balance", f"WITH {CLEAN} SELECT label, count(*) AS count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM clean GROUP BY label")(lambda s, d: pr.class_balance(clean(s, d)))
q("class_count", f"WITH {CLEAN} SELECT label, count(*) AS count FROM clean GROUP BY label")(lambda s, d: clean(s, d).groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count")))
_st = ", ".join(f'avg("{c}") AS "{c}_mean", stddev_samp("{c}") AS "{c}_std", quantile_cont("{c}", 0.5) AS "{c}_p50", quantile_cont("{c}", 0.9) AS "{c}_p90", quantile_cont("{c}", 0.99) AS "{c}_p99"' for c in LENS)
q("length_stats_by_class", f"WITH {CLEAN} SELECT label, {_st} FROM clean GROUP BY label")(lambda s, d: pr.length_stats(clean(s, d), "label", LENS))
_ds = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, {', '.join(f'quantile_cont(x, {p / 100}) AS p{p}' for p in (5, 25, 50, 75, 95))}, max(x) AS max FROM (SELECT CAST(\"{c}\" AS DOUBLE) AS x FROM clean)" for c in LENS)
q("feature_describe", f"WITH {CLEAN} {_ds}")(lambda s, d: pr.describe(clean(s, d), LENS))
q("length_describe", f"WITH {CLEAN} SELECT count(*) AS n, quantile_cont(\"respA_len\", 0.99) AS p99_a, quantile_cont(\"respB_len\", 0.99) AS p99_b FROM clean")(lambda s, d: clean(s, d).agg(F.count("*").alias("n"), F.percentile("respA_len", 0.99).alias("p99_a"), F.percentile("respB_len", 0.99).alias("p99_b")))
_ev = ("event_id", "ts", "user_id", "event_type", "value", "props")
q("null_overview", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS na_count, round_even((count(*) - count({c})) * 100.0 / greatest(count(*), 1), 2) AS na_percent FROM events" for c in _ev))(lambda s, d: pr.null_overview(fx.read(s, d, "events").select(*_ev)))
q("dataset_summary", "SELECT 'rows' AS metric, count(*) AS value FROM events UNION ALL SELECT 'cols', 6 UNION ALL SELECT 'nulls_total', " + " + ".join(f"count(*) - count({c})" for c in _ev) + " FROM events")(lambda s, d: pr.dataset_summary(fx.read(s, d, "events").select(*_ev)))
q("datetime_profile", "SELECT min(ts) AS first, max(ts) AS last, count(DISTINCT ts) AS n FROM events")(lambda s, d: fx.read(s, d, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct("ts").alias("n")))
q("string_profile", "SELECT count(event_type) AS count, count(DISTINCT event_type) AS distinct_values, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS top FROM events")(lambda s, d: fx.read(s, d, "events").groupBy("event_type").agg(F.count("event_type").alias("c")).agg(F.sum("c").alias("count"), F.count("event_type").alias("distinct_values"), F.min_by("event_type", F.struct(-F.col("c"), "event_type")).alias("top")))
_num = ("prompt_len", "respA_len", "respB_len", "label")
q("correlation_matrix", f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM clean" for a in _num for b in _num))(lambda s, d: pr.correlations(clean(s, d), _num).withColumn("corr", R(F.col("corr"))))
_WINS = "w AS (SELECT CASE label WHEN 0 THEN model_a ELSE model_b END AS model, CAST(count(*) AS DOUBLE) AS wins FROM clean WHERE label < 2 GROUP BY 1)"
q("model_wins", f"WITH {CLEAN}, {_WINS} SELECT * FROM w")(lambda s, d: pr.model_wins(clean(s, d)))
q("model_wins_top10", f"WITH {CLEAN}, {_WINS} SELECT * FROM w ORDER BY wins DESC, model LIMIT 10")(lambda s, d: pr.model_wins(clean(s, d)).orderBy(F.desc("wins"), "model").limit(10))
q("result_bars", f"WITH {BATTLES} " + " UNION ALL ".join(f"SELECT '{c}' AS result, CAST(sum({c}) AS BIGINT) AS count FROM battles" for c in ("winner_model_a", "winner_model_b", "winner_tie")))(lambda s, d: pr.result_bars(fx.battles(s, d)))
q("length_hist_dense", f"WITH {CLEAN}, g AS (SELECT DISTINCT label, b FROM clean, range(32) r(b)), n AS (SELECT label, least(\"respA_len\" // 64, 31) AS b, count(*) AS c FROM clean WHERE \"respA_len\" <= 2048 GROUP BY 1, 2) SELECT label, CAST(b * 64 AS INT) AS bin_left, CAST(b * 64 + 64 AS INT) AS bin_right, coalesce(c, 0) AS count FROM g LEFT JOIN n USING (label, b)")(lambda s, d: pr.length_histogram(clean(s, d), "respA_len"))
_HIST = "SELECT CAST(coalesce(least(floor((x - lo) / nullif(hi - lo, 0) * {n}), {m}), 0) AS INT) AS bin, count(*) AS count FROM {t}, (SELECT min(x) AS lo, max(x) AS hi FROM {t}) GROUP BY 1"
q("length_hist_clipped", f"WITH {CLEAN}, cl AS (SELECT least(\"respA_len\", quantile_cont(\"respA_len\", 0.99) OVER ()) AS x FROM clean) " + _HIST.format(n=50, m=49, t="cl"))(lambda s, d: (lambda c: pr.auto_histogram(c.crossJoin(F.broadcast(c.agg(F.percentile("respA_len", 0.99).alias("cap")))).select(F.least("respA_len", "cap").alias("x")), "x", 50))(clean(s, d)))
q("similarity_hist40", f"WITH {FEAT}, cl AS (SELECT jaccard_tokens AS x FROM feat) " + _HIST.format(n=40, m=39, t="cl"))(lambda s, d: pr.auto_histogram(feat(s, d), "jaccard_tokens", 40))
q("tail_share", f"WITH {CLEAN} SELECT label, 100.0 * count(*) FILTER (\"respA_len\" >= 512) / count(*) AS pct FROM clean WHERE \"respA_len\" <= 2048 GROUP BY label")(lambda s, d: pr.length_histogram(clean(s, d), "respA_len").groupBy("label").agg((100.0 * F.sum(F.when(F.col("bin_right") > 512, F.col("count")).otherwise(0)) / F.sum("count")).alias("pct")))
_pc = lambda cond, n: f"round_even(avg(CAST({cond} AS INT)) * 100, 2) AS {n}"
q("trunc_flat", f"WITH {CLEAN} SELECT count(*) AS n_rows, " + ", ".join(_pc(f'"{c}" > 512', f'"pct_{n}_truncated"') for c, n in zip(LENS, ("prompt", "respA", "respB"))) + " FROM clean")(lambda s, d: pr.truncation(clean(s, d)))
q("trunc_budget", f"WITH {CLEAN} SELECT " + _pc("prompt_len > 96", "pct_prompt_truncated_real") + ", " + _pc('"respA_len" > 288', '"pct_respA_truncated_real"') + ", " + _pc('"respB_len" > 288', '"pct_respB_truncated_real"') + " FROM clean")(lambda s, d: pr.truncation_budget(clean(s, d)))
q("trunc_weighted", f"WITH {_SPLIT}, b AS (SELECT split, count(*) AS n, 100 * avg(CAST(\"respA_len\" > 288 AS INT)) AS pct FROM sp GROUP BY 1) SELECT round(sum(n * pct) / sum(n), 6) AS pct FROM b")(lambda s, d: pf.split(clean(s, d)).groupBy("split").agg(F.count("*").alias("n"), pr.percent(F.col("respA_len") > 288).alias("pct")).agg(R(F.sum(F.col("n") * F.col("pct")) / F.sum("n")).alias("pct")))
q("perc_ge", f"WITH {CLEAN} SELECT round(coalesce(100 * avg(CAST(\"respA_len\" >= 200 AS INT)), 0), 6) AS pct FROM clean")(lambda s, d: pr.share_at_least(clean(s, d), "respA_len", 200, "pct").withColumn("pct", R(F.col("pct"))))
q("inter_row_diff", f"WITH {CLEAN} SELECT label, avg(\"respA_len\") - avg(\"respB_len\") AS diff FROM clean GROUP BY label")(lambda s, d: clean(s, d).groupBy("label").agg((F.avg("respA_len") - F.avg("respB_len")).alias("diff")))
q("lost_content", f"WITH {CLEAN} SELECT count(*) FILTER (\"respA_len\" <= 3) AS short, count(*) FILTER ({_len('response_a')} >= 10 AND \"respA_len\" <= 3) AS lost FROM clean")(lambda s, d: clean(s, d).agg(F.count_if(F.col("respA_len") <= 3).alias("short"), F.count_if((tx.token_len(F.col("response_a")) >= 10) & (F.col("respA_len") <= 3)).alias("lost")))


def _board(t: DataFrame) -> DataFrame:
    """Each metric over all rows and over those that are kept, in one pass."""
    metrics = {
        "mean_cos": lambda k: F.avg(F.when(k, F.col("cosine_tfidf"))),
        "mean_jac": lambda k: F.avg(F.when(k, F.col("jaccard_tokens"))),
        "pct_cos": lambda k: F.coalesce(F.avg(F.when(k, (F.col("cosine_tfidf") >= 0.9).cast("double"))) * 100, F.lit(0.0)),
        "pct_trunc": lambda k: F.coalesce(F.avg(F.when(k, (F.col("respA_len") > 512).cast("double"))) * 100, F.lit(0.0)),
        "near_dups": lambda k: F.count_if(k & F.expr(pf.NEAR_REPORT)).cast("double"),
        "rows": lambda k: F.count_if(k).cast("double"),
    }
    sides = {"before": F.lit(True), "after": F.col("keep")}
    row = t.agg(*(F.struct(*(R(f(k)).alias(n) for n, k in sides.items())).alias(m) for m, f in metrics.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.before"), F.col(f"{m}.after")) for m in metrics))))


_bd = lambda t, n: " UNION ALL ".join(f"SELECT '{m}' AS metric, round({e}, 6) AS {n} FROM {t}" for m, e in (("mean_cos", "avg(cosine_tfidf)"), ("mean_jac", "avg(jaccard_tokens)"), ("pct_cos", "100 * avg(CAST(cosine_tfidf >= 0.9 AS INT))"), ("pct_trunc", "100 * avg(CAST(\"respA_len\" > 512 AS INT))"), ("near_dups", f"CAST(count(*) FILTER ({pf.NEAR_REPORT}) AS DOUBLE)"), ("rows", "CAST(count(*) AS DOUBLE)")))
q("before_after_board", f"WITH {FLAGS}, kept AS (SELECT * FROM flags WHERE keep), a AS ({_bd('flags', 'before')}), b AS ({_bd('kept', 'after')}) SELECT metric, before, after FROM a JOIN b USING (metric)")(lambda s, d: _board(flags(s, d)))
q("threshold_flags", f"WITH {CLEAN} SELECT label, count(*) * 100.0 / sum(count(*)) OVER () > 50 AS tie_heavy, count(*) * 100.0 / sum(count(*)) OVER () < 25 AS rare FROM clean GROUP BY label")(lambda s, d: pr.class_balance(clean(s, d)).select("label", (F.col("percent") > 50).alias("tie_heavy"), (F.col("percent") < 25).alias("rare")))
q("empty_text_list", "SELECT doc_id FROM documents WHERE text IS NULL OR trim(text) = '' ORDER BY doc_id LIMIT 50")(lambda s, d: docs(s, d).filter("text is null or trim(text) = ''").select("doc_id").orderBy("doc_id").limit(50))
q("head_tail_rows", "(SELECT event_id FROM events ORDER BY event_id LIMIT 10) UNION ALL (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 10)")(lambda s, d: (lambda e: e.orderBy("event_id").limit(10).union(e.orderBy(F.desc("event_id")).limit(10)))(fx.read(s, d, "events").select("event_id")))
q("set_intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")(lambda s, d: (lambda e: e.filter("event_type = 'click'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id")))(fx.read(s, d, "events")))
q("set_except", "SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase'")(lambda s, d: (lambda e: e.filter("event_type = 'click'").select("user_id").subtract(e.filter("event_type = 'purchase'").select("user_id")))(fx.read(s, d, "events")))
q("set_distinct", "SELECT DISTINCT event_type FROM events")(lambda s, d: fx.read(s, d, "events").select("event_type").distinct())
q("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42') LIMIT 60")(lambda s, d: pr.seeded_sample(docs(s, d).select("doc_id"), "doc_id", 60))
_BT = SCORES + ", bt AS (SELECT *, 1 / (1 + exp(-(s_a - s_b))) AS pa, least(0.95, exp(-abs(s_a - s_b)) * 0.5) AS pt FROM scores)"
q("bt_probs", f"WITH {_BT} SELECT id, round(pa * (1 - pt), 8) AS p_a, round((1 - pa) * (1 - pt), 8) AS p_b, round(pt, 8) AS p_tie FROM bt")(lambda s, d: ev.bt_probabilities(fx.scores(s, d)).select("id", *(R(F.col(c), 8).alias(c) for c in ev.P)))
q("bt_loss", f"WITH {_BT} SELECT round(avg(-(z * ln(pa) + (1 - z) * ln(1 - pa))), 6) AS loss FROM (SELECT *, CASE y_true WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS z FROM bt)")(lambda s, d: ev.bt_loss(fx.scores(s, d)).withColumn("loss", R(F.col("loss"))))
q("softmax_argmax", f"WITH {PROB} SELECT id, round(p_a, 8) AS p_a, round(p_b, 8) AS p_b, round(p_tie, 8) AS p_tie, y_pred FROM pr")(lambda s, d: prob(s, d).select("id", *(R(F.col(c), 8).alias(c) for c in ev.P), "y_pred"))
q("ce_loss", f"WITH {PROB}, x AS (SELECT *, CASE y_true WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 1.5 END AS w, -ln(CASE y_true WHEN 0 THEN p_a WHEN 1 THEN p_b ELSE p_tie END) AS nll, -(ln(p_a) + ln(p_b) + 1.5 * ln(p_tie)) / 3 AS sp FROM pr) SELECT round((sum(0.9 * w * nll) + sum(0.1 * sp)) / sum(w), 6) AS loss FROM x")(lambda s, d: ev.cross_entropy(prob(s, d), (1.0, 1.0, 1.5), 0.1).withColumn("loss", R(F.col("loss"))))
q("confusion", f"WITH {PROB} SELECT k AS y_true, count(*) FILTER (y_true = k AND y_pred = 0) AS pred_0, count(*) FILTER (y_true = k AND y_pred = 1) AS pred_1, count(*) FILTER (y_true = k AND y_pred = 2) AS pred_2 FROM pr, (VALUES (0), (1), (2)) v(k) GROUP BY k")(lambda s, d: ev.confusion(prob(s, d)))
q("class_report", f"WITH {REPORT} SELECT class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM rep")(lambda s, d: ev.class_report(prob(s, d)).select("class", *(R(F.col(c), 8).alias(c) for c in ("precision", "recall", "f1"))))
q("accuracy_macro_f1", f"WITH {REPORT} SELECT round((SELECT avg(CAST(y_true = y_pred AS INT)) FROM pr), 8) AS accuracy, round(avg(f1), 8) AS macro_f1 FROM rep")(lambda s, d: ev.accuracy_macro_f1(prob(s, d)).select(R(F.col("accuracy"), 8).alias("accuracy"), R(F.col("macro_f1"), 8).alias("macro_f1")))
q("entropy_mean", f"WITH {PROB} SELECT round(avg(-(p_a * ln(p_a + 1e-8) + p_b * ln(p_b + 1e-8) + p_tie * ln(p_tie + 1e-8))), 6) AS entropy, round(avg(p_a), 6) AS mean_p_a, round(avg(p_b), 6) AS mean_p_b, round(avg(p_tie), 6) AS mean_p_tie FROM pr")(lambda s, d: (lambda e: e.select(*(R(F.col(c)).alias(c) for c in e.columns)))(ev.entropy(prob(s, d))))
q("pred_dist_by_class", f"WITH {PROB} SELECT y_true, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(var_pop({c}), 6) AS var_{c}" for c in ev.P) + ", count(*) AS n FROM pr GROUP BY y_true")(lambda s, d: (lambda e: e.select("y_true", "n", *(R(F.col(c)).alias(c) for c in e.columns if c not in ("y_true", "n"))))(ev.distribution_by_class(prob(s, d))))
q("token_budget_batches", f"WITH {CLEAN} SELECT row_idx // 32 AS batch_id, max(greatest(\"respA_len\", \"respB_len\")) AS len_max, avg(greatest(\"respA_len\", \"respB_len\")) AS len_mean, max(CAST(greatest(\"respA_len\", \"respB_len\") >= 387 AS INT)) AS truncated FROM clean GROUP BY 1")(lambda s, d: ev.token_budget(clean(s, d).select("id", F.col("respA_len").alias("len_a"), F.col("respB_len").alias("len_b"))))
q("alerts", f"WITH {PROB}, m AS (SELECT avg(p_a) AS a, avg(p_b) AS b, avg(p_tie) AS t, avg(CAST(y_true = y_pred AS INT)) AS acc, avg(-(p_a * ln(p_a + 1e-8) + p_b * ln(p_b + 1e-8) + p_tie * ln(p_tie + 1e-8))) AS e FROM pr) SELECT 'collapse' AS type, abs(a - 1/3.0) <= 0.05 AND abs(b - 1/3.0) <= 0.05 AND abs(t - 1/3.0) <= 0.05 AND acc < 0.36 AND e > 0.95 AS raised FROM m UNION ALL SELECT 'all_TIE', t >= 0.95 FROM m UNION ALL SELECT 'flat', e >= 1.05 FROM m")(lambda s, d: ev.alerts(prob(s, d)))
q("confusion_melt", f"WITH {PROB}, c AS (SELECT CASE y_true WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'TIE' END AS t, y_pred FROM pr) SELECT l.x AS \"true\", p.x AS pred, (SELECT count(*) FROM c WHERE c.t = l.x AND c.y_pred = p.k) AS count, CAST(l.k AS INT) AS true_rank, CAST(p.k AS INT) AS pred_rank FROM (VALUES (0, 'A'), (1, 'B'), (2, 'TIE')) l(k, x), (VALUES (0, 'A'), (1, 'B'), (2, 'TIE')) p(k, x)")(lambda s, d: ev.melt_confusion(ev.confusion(prob(s, d)).select(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("TIE")), F.col("y_true") + 1).alias("true"), F.col("pred_0").alias("pred_A"), F.col("pred_1").alias("pred_B"), F.col("pred_2").alias("pred_TIE"))))
q("placeholder_predictions", f"WITH {BATTLES} SELECT id, 0.3333::DOUBLE AS \"prob_A\", 0.3333::DOUBLE AS \"prob_B\", 0.3333::DOUBLE AS \"prob_TIE\", 'TIE' AS pred_label FROM battles")(lambda s, d: ev.placeholder(fx.battles(s, d)))
q("pair_vectors", "SELECT x.vec_id AS vec_id, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 4) AS l1, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 4) AS dot FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.vec_id % 2 = 0")(lambda s, d: _pairs(s, d))
q("pair_encoding", f"WITH {CLEAN}, a AS (SELECT row_idx, least(prompt_len, 96) AS a, least(\"respA_len\", 320) AS b FROM clean), o AS (SELECT *, greatest(0, a + b - 125) AS over FROM a), u AS (SELECT *, least(over, abs(a - b)) AS uneven, over - least(over, abs(a - b)) AS rest FROM o), e AS (SELECT row_idx, CAST(a - CASE WHEN a > b THEN uneven ELSE 0 END - rest // 2 AS INT) AS enc_first, CAST(b - CASE WHEN b > a THEN uneven ELSE 0 END - (rest + 1) // 2 AS INT) AS enc_second FROM u) SELECT *, CAST(125 - enc_first - enc_second AS INT) AS enc_pad FROM e")(lambda s, d: ev.pair_encoding(clean(s, d), tokenizer_max=128).select("row_idx", "enc_first", "enc_second", "enc_pad"))
q("serving_clean", f"SELECT doc_id, coalesce({_clean('text')}, '') AS v FROM documents")(lambda s, d: docs(s, d).select("doc_id", F.coalesce(tx.clean_text(F.col("text")), F.lit("")).alias("v")))
q("predictions_attach", f"WITH {CLEAN}{PROB[len(BATTLES):]} SELECT pr.id, y_true, y_pred, prompt_len, \"respA_len\", \"respB_len\" FROM pr JOIN clean ON clean.id = pr.id")(lambda s, d: ev.attach(prob(s, d).select("id", "y_true", "y_pred"), clean(s, d)))
q("split_meta", f"WITH {_SPLIT} SELECT split, count(*) AS n, " + ", ".join(f"round_even(avg(CAST(label = {k} AS INT)) * 100, 2) AS pct_{k}" for k in (0, 1, 2)) + ", quantile_cont(\"respA_len\", 0.99) AS p99_a, quantile_cont(\"respB_len\", 0.99) AS p99_b FROM sp GROUP BY split")(lambda s, d: pr.split_meta(pf.split(clean(s, d))))
q("leaked_signatures", f"WITH {CLEAN} SELECT prompt_sig FROM (SELECT prompt_sig FROM clean WHERE row_idx // 40 % 2 = 0 INTERSECT SELECT prompt_sig FROM clean WHERE row_idx // 40 % 2 = 1) ORDER BY prompt_sig LIMIT 20")(lambda s, d: pr.leaked(clean(s, d).withColumn("split", F.when(F.floor(F.col("row_idx") / 40) % 2 == 0, "valid").otherwise("train"))))
q("pretty_percent",f"WITH {CLEAN} SELECT label, printf('%.2f%%', count(*) * 100.0 / sum(count(*)) OVER ()) AS pct FROM clean GROUP BY label")(lambda s, d: pr.class_balance(clean(s, d)).select("label", tx.pct_text(F.col("percent")).alias("pct")))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    e = fx.read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = e.filter("vec_id % 2 = 0").select("vec_id", F.col("v").alias("va")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("vb")), "vec_id")
    f = ev.pair_vectors(pairs)
    n = F.size("va")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return f.select("vec_id", R(add(F.slice("features", 2 * n + 1, n)), 4).alias("l1"), R(add(F.slice("features", 3 * n + 1, n)), 4).alias("dot"))
