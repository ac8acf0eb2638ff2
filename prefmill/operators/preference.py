"""Labels, cleaning, length control, in-row dedup, template clusters, split and swap of preference rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import similarity as sim, text as tx
from ..sources.store import store
from . import cosine_join, splits, topk


def label() -> Column:
    """0 = first wins, 1 = second, 2 = tie; null unless exactly one flag is set."""
    a, b, t = (F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("winner_model_a", "winner_model_b", "winner_tie"))
    return F.when(a + b + t != 1, None).when(t == 1, 2).when(a == 1, 0).otherwise(1)


def generate_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", label()).filter("label is not null")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once: filters and projections above are not merged with their expressions, as
    they would be in a plain projection, where every use repeats the whole chain."""
    rows = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return df.select(*(c for c in df.columns if c not in columns), rows)


def clean_frame(df: DataFrame, stopwords=(), cells=tx.list_cell) -> DataFrame:
    """*_clean columns and prompt_sig; rows with a null or blank cleaned text go. cells reads a cell that holds a list:
    tx.list_cell (JSON) or tx.literal_cell."""
    df = once(df, {f"{c}_clean": tx.clean_text(cells(F.col(c)), words) for c, words in (("prompt", stopwords), ("response_a", ()), ("response_b", ()))})
    df = df.filter(F.trim("prompt_clean") != "")
    names = ("response_a_clean", "response_b_clean")
    return once(df, {c: tx.fill_no_response(F.col(c)) for c in names} | {"prompt_sig": tx.prompt_sig(F.col("prompt_clean"))})


def with_lengths(df: DataFrame) -> DataFrame:
    return once(df, {"prompt_len": tx.token_len(F.col("prompt_clean")), "respA_len": tx.token_len(F.col("response_a_clean")), "respB_len": tx.token_len(F.col("response_b_clean"))})


def with_missing_lengths(df: DataFrame) -> DataFrame:
    """Lengths of stored cleaned rows, where they are no columns yet; there a null text counts as one token."""
    sources = {"prompt_len": "prompt_clean", "respA_len": "response_a_clean", "respB_len": "response_b_clean"}
    return df.withColumns({n: tx.token_len(F.coalesce(F.col(c), F.lit("nan"))) for n, c in sources.items() if n not in df.columns})


def clean_base(raw: DataFrame, stopwords=(), cells=tx.list_cell) -> DataFrame:
    return with_lengths(generate_label(clean_frame(raw, stopwords, cells)))


def length_limits(df: DataFrame) -> tuple[float, float]:
    """99th percentiles of the lengths of both responses."""
    return tuple(df.agg(F.percentile("respA_len", 0.99), F.percentile("respB_len", 0.99)).first())


def tail_control(df: DataFrame, p99: tuple[float, float] | None = None) -> DataFrame:
    """Responses over the limit or at the 99th percentile are compressed, long prompts cut; p99 of the batch if not given."""
    if p99 is None:
        df = store(df, "lengths")  # read for the percentiles and for the result
        p99 = length_limits(df)
    target = tx.response_target(F.col("prompt_len"))
    for c, n, p in (("response_a_clean", "respA_len", p99[0]), ("response_b_clean", "respB_len", p99[1])):
        need = (F.col(n) > tx.RESPONSE_LIMIT) | (F.col(n) >= F.lit(p))
        df = df.withColumn(c, F.when(need, tx.let(tx.strip_boilerplate(tx.collapse_repeats(F.col(c))), lambda t: tx.compress(t, target))).otherwise(F.col(c)))
    df = df.withColumn("prompt_clean", tx.mini_prompt(F.col("prompt_clean")))
    return df.withColumns({"respA_len": tx.token_len(F.col("response_a_clean")), "respB_len": tx.token_len(F.col("response_b_clean"))})


#: Columns that serving takes and gives.
SERVING_IN, SERVING_OUT = ("id", "prompt", "response_a", "response_b"), ("id", "prompt_clean", "response_a_clean", "response_b_clean")


def serving_texts(df: DataFrame, cells=tx.literal_cell) -> DataFrame:
    """Unlabelled rows, cleaned without stopwords (nothing left is the empty text), with lengths. No row goes."""
    missing = [c for c in SERVING_IN if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    texts = {f"{c}_clean": F.coalesce(tx.clean_text(cells(F.col(c))), F.lit("")) for c in SERVING_IN[1:]}
    return with_lengths(once(df.select(*SERVING_IN), texts)).select(*SERVING_OUT, "prompt_len", "respA_len", "respB_len")


def serving_clean(df: DataFrame, cells=tx.literal_cell) -> DataFrame:
    """A batch of unlabelled rows as the model gets them: serving_texts() with lengths under control by the batch's own
    99th percentiles."""
    return tail_control(serving_texts(df, cells)).select(*SERVING_OUT)


def english_stopwords(spark) -> list[str]:
    """Spark's English stopwords, cut at apostrophes as cleaning cuts the text."""
    words = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")
    return sorted({part for w in words for part in w.split("'") if part})


def _info() -> Column:
    """Tokens of both responses."""
    return tx.info_len(F.col("response_a_clean")) + tx.info_len(F.col("response_b_clean"))


def features(df: DataFrame) -> DataFrame:
    """df with info and the features of its pairs. The rows are read for their terms, their number and the result, so they
    are stored first; what is said of the texts is stored with them, so that they need not be read again for it."""
    df = store(df.withColumn("info", _info()), "clean")
    return sim.pair_features(df, "row_idx", "response_a_clean", "response_b_clean", "respA_len", "respB_len")


#: Fixed thresholds.
HARD = "cosine_tfidf >= 0.998 and jaccard_tokens >= 0.94"
NEAR_SAME = "(cosine_tfidf >= 0.98 and abs_len_diff <= 16) or jaccard_tokens >= 0.90 or (cosine_tfidf >= 0.985 and abs_len_diff <= 8)"
NEAR_CROSS = "cosine_tfidf >= 0.995 and abs_len_diff <= 8"
TIE_TRIVIAL = "((cosine_tfidf >= 0.97 and jaccard_tokens >= 0.75) or (cosine_tfidf >= 0.985 and abs_len_diff <= 5)) and label = 2"
NEAR_REPORT = "cosine_tfidf >= 0.95 or jaccard_tokens >= 0.95"


def dedup_flags(df: DataFrame) -> DataFrame:
    """hard, near_same, near_cross, tie_trivial, info, keep for each row with features.

    In a prompt group of several rows the near_same rows leave one, that with most information (lowest row_idx on ties);
    near_cross and hard rows go; of the trivial ties of a group one may stay. A group's size and best rows are aggregates
    of the stored rows, and come back to them by a join that may split a large group."""
    df = df.withColumns({"hard": F.expr(HARD), "near_same": F.expr(NEAR_SAME), "near_cross": F.expr(NEAR_CROSS), "tie_trivial": F.expr(TIE_TRIVIAL)} | ({} if "info" in df.columns else {"info": _info()}))
    df = store(df, "flags")
    first = lambda flag: F.max(F.when(F.col(flag), F.struct("info", (-F.col("row_idx")).alias("row")))).getField("row")
    groups = df.groupBy("prompt_sig").agg(F.count("*").alias("g"), (-first("near_same")).alias("r_near"), (-first("tie_trivial")).alias("r_tie"))
    df = topk.with_groups(df, "prompt_sig", groups)
    other = lambda c: F.col(c) != F.col("row_idx")
    gone = (F.col("near_same") & (F.col("g") > 1) & other("r_near")) | F.col("near_cross") | F.col("hard") | (F.col("tie_trivial") & other("r_tie"))
    return df.withColumn("keep", ~gone).drop("r_near", "r_tie", "g")


def dedup_meta(flags: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    k = F.col("keep")
    return flags.agg(count(F.col("hard")).alias("removed_hard"), count(~k & ~F.col("hard")).alias("removed_near"), count((F.col("near_same") | F.col("near_cross")) & k).alias("kept_near"), count(~k).alias("removed_total"))


def templates(df: DataFrame) -> DataFrame:
    """row_idx, prompt_sig, template (both responses, normalised) and info of cleaned rows, for template_clusters()."""
    return df.select("row_idx", "prompt_sig", tx.template_norm(F.col("response_a_clean"), F.col("response_b_clean")).alias("template"), _info().alias("info"))


def template_edges(df: DataFrame, threshold: float = 0.985) -> DataFrame:
    """prompt_sig, a, b, cosine: all pairs of rows of one group whose group-local TF-IDF cosine reaches the threshold."""
    return cosine_join.pairs(df, threshold)


def components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """row_idx, component (smallest row_idx reachable): labels spread along edges and jump to the label of their label;
    each round is stored, and only rows with an edge take part."""
    both = store(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m")).withColumnRenamed("a", "id")
        low = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        new = store(low.join(above, "label", "left").select("id", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            found = labels.select(F.col("id").alias("row_idx"), F.col("label").alias("component"))
            return rows.select("row_idx").join(found, "row_idx", "left").select("row_idx", F.coalesce("component", "row_idx").alias("component"))


#: Places among a group's clusters that are numbered.
PLACES = 10


def template_clusters(df: DataFrame, threshold: float = 0.985) -> DataFrame:
    """Representatives of template clusters, of each component the row with most information: row_idx, prompt_sig,
    component, place (by the order of components; null after the first PLACES) and g, the rows of the group. df: row_idx,
    prompt_sig, template, info. A group without a term of two characters keeps its rows in order of information."""
    base = store(df, "templates")
    groups = base.groupBy("prompt_sig").agg(F.count("*").alias("g"), F.max((F.size(sim.terms(F.col("template"))) > 0).cast("int")).alias("usable"))
    found = components(base, cosine_join.links(base.select("row_idx", "prompt_sig", "template"), threshold))
    rows = base.select("row_idx", "prompt_sig", "info").join(found, "row_idx")
    reps = topk.best(rows, ["prompt_sig", "component"], [F.col("info"), -F.col("row_idx")], ["row_idx", "info"])
    reps = store(topk.with_groups(reps, "prompt_sig", groups), "representatives")
    order = [F.when(F.col("usable") == 1, F.lit(0)).otherwise(-F.col("info")), F.col("component")]
    placed = topk.first(reps, ["prompt_sig"], order, PLACES).select("row_idx", "place")
    return reps.join(placed, "row_idx", "left").select("row_idx", "prompt_sig", "component", "place", "g", "usable")


def cluster_templates(df: DataFrame, max_per_group: int = 8, cap_start: int = 10, threshold: float = 0.985) -> DataFrame:
    """The representatives that stay: groups of more than cap_start rows keep max_per_group of them."""
    if max(max_per_group, cap_start) > PLACES:
        raise ValueError(f"places are numbered up to {PLACES}")
    return template_clusters(df, threshold).filter((F.col("g") <= cap_start) | (F.col("place") <= max_per_group)).drop("g", "usable")


def cluster_meta(reps: DataFrame, max_per_group: int = 8, cap_start: int = 10) -> DataFrame:
    """clusters_kept, capped_prompts, max_per_prompt, from template_clusters(). Clusters of groups of two rows and more
    count before the cap, those of groups without a usable term after it."""
    groups = reps.groupBy("prompt_sig").agg(F.max("g").alias("g"), F.max("usable").alias("usable"), F.count("*").alias("reps")).filter("g > 1")
    over = (F.col("g") > cap_start) & (F.col("reps") > max_per_group)
    kept = F.when(over & (F.col("usable") == 0), max_per_group).otherwise(F.col("reps"))
    return groups.agg(F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("clusters_kept"), F.count_if(over).alias("capped_prompts"), F.lit(max_per_group).cast("long").alias("max_per_prompt"))


#: Names of the splitters, as metadata has them.
SPLITTERS = ("stratified_group", "group_hash")


def split_with_tag(df: DataFrame, n: int = 10, least: int = 2) -> tuple[DataFrame, str]:
    """The stratified split if every label has `least` groups, else the split by hash; and the name of the one chosen."""
    groups = df.groupBy("label").agg(F.countDistinct("prompt_sig").alias("g")).agg(F.min("g").alias("g")).first()["g"]
    return (stratified_split(df, n), SPLITTERS[0]) if groups is not None and groups >= least else (split(df, n), SPLITTERS[1])


def fold(sig: Column, n: int = 10) -> Column:
    """Portable group fold: all rows of a signature go together."""
    return F.conv(F.substring(F.md5(sig.cast("binary")), 1, 6), 16, 10).cast("long") % n


def split(df: DataFrame, n: int = 10) -> DataFrame:
    """The group split by hash; its name in metadata is SPLITTERS[1]."""
    return df.withColumn("split", F.when(fold(F.col("prompt_sig"), n) == 0, "valid").otherwise("train"))


def stratified_split(df: DataFrame, n: int = 10) -> DataFrame:
    """df with split: of each label one nth of the rows, as nearly as whole groups allow, is valid. No group is on both
    sides; a label of two groups and more is on both."""
    bins = splits.valid_bins(df, "prompt_sig", "label", n)
    chosen = splits.bin_of(F.col("prompt_sig")).isin(bins) if bins else F.lit(False)
    return df.withColumn("split", F.when(chosen, "valid").otherwise("train"))


def swap_union(df: DataFrame, swap_lengths: bool = False) -> DataFrame:
    """Every row and its mirror image (is_swapped 1): cleaned responses, models and label change sides."""
    pairs = [("response_a_clean", "response_b_clean"), ("model_a", "model_b")] + [("respA_len", "respB_len")] * swap_lengths
    swaps = {c: F.col(d) for a, b in pairs for c, d in ((a, b), (b, a))}
    swaps["label"] = F.when(F.col("label") == 0, 1).when(F.col("label") == 1, 0).otherwise(F.col("label"))
    mirror = df.select(*(swaps.get(c, F.col(c)).alias(c) for c in df.columns), F.lit(1).alias("is_swapped"))
    return df.withColumn("is_swapped", F.lit(0)).unionByName(mirror)
