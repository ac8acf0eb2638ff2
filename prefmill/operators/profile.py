"""Profiling operators over preference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.text import round_half_even as rnd


def class_balance(df: DataFrame, by: str = "label") -> DataFrame:
    n = df.groupBy(by).agg(F.count("*").alias("count"))
    total = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("t"))
    return n.crossJoin(F.broadcast(total)).select(by, "count", rnd(F.col("count") / F.col("t") * 100).alias("percent"))


def length_stats(df: DataFrame, by: str, columns) -> DataFrame:
    """Mean, standard deviation, median, 90th and 99th percentile (linear interpolation) of each column by class."""
    aggs = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), *(q[i].alias(f"{c}_{p}") for i, p in enumerate(("p50", "p90", "p99")))]
    return df.groupBy(by).agg(*aggs)


def describe(df: DataFrame, columns, quantiles=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row for each column: one pass over the columns unpivoted."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    q = F.percentile("x", F.array(*map(F.lit, quantiles)))
    return long.groupBy("feature").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), *(q[i].alias(f"p{round(100 * p)}") for i, p in enumerate(quantiles)), F.max("x").alias("max"))


def null_overview(df: DataFrame) -> DataFrame:
    row = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return row.unpivot("_n", list(df.columns), "column", "na_count").select("column", "na_count", rnd(F.col("na_count") / F.greatest("_n", F.lit(1)) * 100).alias("na_percent"))


def dataset_summary(df: DataFrame) -> DataFrame:
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    row = df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("nulls_total")).withColumn("cols", F.lit(len(df.columns)).cast("long"))
    return row.unpivot([], ["rows", "cols", "nulls_total"], "metric", "value")


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pairwise-complete Pearson correlations, in long form: one pass, one row out of it."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs))
    long = row.unpivot([], [f"`{a}|{b}`" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "corr")


def model_wins(df: DataFrame) -> DataFrame:
    a = df.filter("label = 0").select(F.col("model_a").alias("model"))
    return a.union(df.filter("label = 1").select("model_b")).groupBy("model").agg(F.count("*").cast("double").alias("wins"))


def result_bars(df: DataFrame) -> DataFrame:
    flags = ["winner_model_a", "winner_model_b", "winner_tie"]
    return df.agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in flags)).unpivot([], flags, "result", "count")


def length_histogram(df: DataFrame, column: str, by: str = "label", step: int = 64, bins: int = 32) -> DataFrame:
    """Dense bins [0, step), ...; the last one is closed; larger values are outside."""
    spark = df.sparkSession
    binned = df.filter(F.col(column) <= step * bins).select(by, F.least(F.floor(F.col(column) / step), F.lit(bins - 1)).cast("int").alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))
    grid = df.select(by).distinct().crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("bin"))))
    return grid.join(binned, [by, "bin"], "left").select(by, (F.col("bin") * step).alias("bin_left"), ((F.col("bin") + 1) * step).alias("bin_right"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def auto_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    edge = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edge)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("count"))


def percent(cond):
    return F.coalesce(F.avg(cond.cast("double")) * 100, F.lit(0.0))


def truncation(df: DataFrame, limit: int = 512) -> DataFrame:
    names = {"prompt_len": "prompt", "respA_len": "respA", "respB_len": "respB"}
    return df.agg(F.count("*").alias("n_rows"), *(rnd(percent(F.col(c) > limit)).alias(f"pct_{n}_truncated") for c, n in names.items()))


def trunc_cols(df: DataFrame, limit: int = 512) -> DataFrame:
    """truncation() without rounding; 0 of no rows."""
    names = {"prompt_len": "prompt", "respA_len": "respA", "respB_len": "respB"}
    return df.agg(F.count("*").alias("n_rows"), *(percent(F.col(c) > limit).alias(f"pct_{n}_truncated") for c, n in names.items()))


def clipped_histograms(df: DataFrame, columns, bins: int = 50, at: float = 0.99) -> DataFrame:
    """feature, bin, count of each column, clipped at its own quantile, in equal bins from its minimum on."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*").filter("x is not null")
    ends = long.groupBy("feature").agg(F.percentile("x", at).alias("cap"), F.min("x").alias("lo"))
    width = F.col("cap") - F.col("lo")
    place = F.least(F.floor(F.coalesce(F.try_divide(F.least("x", "cap") - F.col("lo"), width), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return long.join(F.broadcast(ends), "feature").groupBy("feature", place.alias("bin")).agg(F.count("*").alias("count"))


def truncation_budget(df: DataFrame, prompt: int = 96, response: int = 288, total: int = 387) -> DataFrame:
    over = lambda c: (F.col(c) > response) | (F.least("prompt_len", F.lit(prompt)) + F.least(c, F.lit(response)) - total > 0)
    return df.agg(rnd(percent(F.col("prompt_len") > prompt)).alias("pct_prompt_truncated_real"), rnd(percent(over("respA_len"))).alias("pct_respA_truncated_real"), rnd(percent(over("respB_len"))).alias("pct_respB_truncated_real"))


def leakage(df: DataFrame) -> DataFrame:
    """Signatures on both sides of a split."""
    g = df.groupBy("prompt_sig").agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") == "valid").cast("int")).alias("v"))
    row = g.agg(F.sum("t").alias("n_train"), F.sum("v").alias("n_valid"), F.sum(F.col("t") * F.col("v")).alias("n_both"))
    return row.withColumn("pct", rnd(F.col("n_both") / F.greatest(F.lit(1), F.least("n_train", "n_valid")) * 100))


def share_at_least(df: DataFrame, column: str, threshold: float, name: str) -> DataFrame:
    return df.agg(percent(F.col(column) >= threshold).alias(name))


def min_max(df: DataFrame, column: str, by: str) -> DataFrame:
    w = W.partitionBy(by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn("norm", (F.col(column) - lo) / F.greatest(F.lit(1e-9), hi - lo))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest portable hash of key and seed: a sampling operator, so n is its meaning."""
    return df.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))).orderBy("h").limit(n).drop("h")


def split_meta(df: DataFrame, lengths=("respA_len", "respB_len")) -> DataFrame:
    """Rows, class percents and 99th percentiles of both lengths of each split."""
    shares = [rnd(percent(F.col("label") == k)).alias(f"pct_{k}") for k in (0, 1, 2)]
    return df.groupBy("split").agg(F.count("*").alias("n"), *shares, F.percentile(lengths[0], 0.99).alias("p99_a"), F.percentile(lengths[1], 0.99).alias("p99_b"))


def leaked(df: DataFrame, n: int = 20) -> DataFrame:
    """The first n signatures, in order, that stand in more than one split."""
    sides = df.groupBy("prompt_sig").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return sides.filter("lo < hi").select("prompt_sig").orderBy("prompt_sig").limit(n)


def dtypes(df: DataFrame) -> DataFrame:
    """column, dtype and whether it is numeric, from the schema."""
    rows = [(f.name, f.dataType.simpleString(), f.name in numeric_columns(df)) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, is_numeric boolean")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe_values(df: DataFrame, columns) -> DataFrame:
    """count, distinct values, commonest value (the first of equals) and its count of each column, as text."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*")
    n = long.groupBy("column", "v").agg(F.count("v").alias("n"))
    first = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("n")).alias("n"), "v")))
    return n.groupBy("column").agg(F.sum("n").alias("count"), F.count("v").alias("nunique"), first.alias("x")).select("column", "count", "nunique", F.col("x.v").alias("top"), (-F.col("x.n")).alias("freq"))


def dense_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """auto_histogram() with its empty bins."""
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(grid).join(auto_histogram(df, column, bins), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def binned_count(df: DataFrame, column: str, step: float) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / step) * step).cast("long").alias("bin_left")).agg(F.count("*").alias("count"))


def threshold_flags(df: DataFrame) -> DataFrame:
    """One row, flags: the names of the fixed thresholds that the table crosses, in order, comma-joined."""
    share = lambda k: percent(F.col("label") == k)
    row = df.agg(share(0).alias("a"), share(1).alias("b"), share(2).alias("t"), percent(F.col("respA_len") > 512).alias("trunc"))
    flag = lambda cond, name: F.when(cond, name)
    flags = (flag(F.col("t") > 50, "tie_heavy"), flag(F.col("a") < 25, "few_a"), flag(F.col("b") < 25, "few_b"), flag(F.abs(F.col("a") - F.col("b")) <= 5, "a_b_even"), flag(F.col("trunc") > 30, "trunc_high").when(F.col("trunc") > 20, "trunc_moderate"))
    return row.select(F.array_join(F.array_compact(F.array(*flags)), ",").alias("flags"))


def class_balance_by_split(df: DataFrame) -> DataFrame:
    n = df.groupBy("split", "label").agg(F.count("*").alias("count"))
    return n.withColumn("percent", rnd(F.col("count") / F.sum("count").over(W.partitionBy("split")) * 100))


def records(df: DataFrame, order: str) -> DataFrame:
    """A small report as one JSON text."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row"))))
    return df.agg(F.to_json(F.transform(rows, lambda x: x["row"])).alias("records"))
