"""The audit of prepared rows: thresholds that a split crosses, the narrative log, and the metadata of a split.

Rows have split, label, prompt_sig, the three lengths, cosine_tfidf and jaccard_tokens. What is said of a split is one
aggregate over it, so the log is a handful of rows for any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import preference as pf, profile as pr

#: Fixed thresholds, in percent or tokens.
TIE_ABOVE, SIDE_BELOW, TRUNC_HIGH, TRUNC_MODERATE, SHARE, EVEN = 50, 25, 30, 20, 15, 5
SIMILAR_COSINE, SIMILAR_JACCARD = 0.9, 0.8
LENGTHS = {"prompt": "prompt_len", "respA": "respA_len", "respB": "respB_len"}
THRESHOLDS = {"hard_cos": 0.998, "hard_jac": 0.94, "near_cos": 0.98, "template_sim": 0.985}


def _by_split(df: DataFrame, limit: int) -> DataFrame:
    pct = pr.percent
    return df.groupBy("split").agg(
        F.count("*").alias("n"),
        *(pct(F.col("label") == k).alias(f"pct_{k}") for k in range(3)),
        *(F.count_if(F.col("label") == k).alias(f"n_{k}") for k in range(3)),
        *(pct(F.col(c) > limit).alias(f"trunc_{n}") for n, c in LENGTHS.items()),
        pct(F.col("cosine_tfidf") >= SIMILAR_COSINE).alias("cosine_high"),
        pct(F.col("jaccard_tokens") >= SIMILAR_JACCARD).alias("jaccard_high"),
        F.avg("cosine_tfidf").alias("cosine_mean"),
        F.avg("jaccard_tokens").alias("jaccard_mean"),
        F.count_if(F.expr(pf.NEAR_REPORT)).alias("near"),
    )


def _by_label(df: DataFrame) -> DataFrame:
    stats = [f(c).alias(f"{s}_{n}") for s, c in (("a", "respA_len"), ("b", "respB_len")) for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy("split", "label").agg(*stats)


def _rows(df: DataFrame, *columns: tuple[Column, ...]) -> DataFrame:
    """A row for each tuple that has no null."""
    names = [f"x{k}" for k in range(len(columns[0]))]
    each = F.explode(F.array(*(F.struct(*(v.alias(n) for n, v in zip(names, c))) for c in columns)))
    out = df.select(each.alias("x")).select("x.*")
    return out.filter(" and ".join(f"{n} is not null" for n in names[1:]))


def flags(df: DataFrame, limit: int = 512) -> DataFrame:
    """split, flag for each threshold that a split crosses; near duplicates are judged over all splits (split "all")."""
    flag = lambda c, name: (F.col("split"), F.when(c, F.lit(name)))
    trunc = [(F.col("split"), F.when(F.col(f"trunc_{n}") > TRUNC_HIGH, f"{n}_truncated_high").when(F.col(f"trunc_{n}") > TRUNC_MODERATE, f"{n}_truncated_moderate")) for n in LENGTHS]
    of_split = _by_split(df, limit)
    similar = (F.col("cosine_high") >= SHARE) | (F.col("jaccard_high") >= SHARE)
    found = _rows(of_split, flag(F.col("pct_2") > TIE_ABOVE, "tie_heavy"), flag(F.col("pct_0") < SIDE_BELOW, "few_a"), flag(F.col("pct_1") < SIDE_BELOW, "few_b"), *trunc, flag(similar, "similar"))
    every = of_split.agg(F.sum("near").alias("near"), F.sum("n").alias("n")).withColumn("split", F.lit("all"))
    near = _rows(every, flag((F.col("near") > 0) & (F.col("near") * 100 >= SHARE * F.col("n")), "near_duplicates"))
    even = F.abs(F.col("a_mean") - F.col("b_mean")) <= EVEN
    lengths = _rows(_by_label(df), (F.col("split"), F.when(even, F.concat(F.lit("even_lengths_"), F.col("label").cast("string")))))
    return found.unionByName(near).unionByName(lengths).toDF("split", "flag")


def log(df: DataFrame, limit: int = 512) -> DataFrame:
    """section (from 1), split, place, line: class balance, truncation, similarity, near duplicates, lengths by class,
    and groups on both sides. In order of section, split and place it is the text of the audit."""
    of_split, text = _by_split(df, limit), F.format_string
    one, two, three = F.lit(1), F.lit(2), F.lit(3)
    pct = lambda c: F.round(c, 2)
    split = _rows(
        of_split,
        (F.col("split"), one, F.lit(0), text("A=%.2f%% (n=%d) | B=%.2f%% (n=%d) | TIE=%.2f%% (n=%d)", *(x for k in range(3) for x in (pct(F.col(f"pct_{k}")), F.col(f"n_{k}"))))),
        (F.col("split"), two, F.lit(0), text("prompt=%.2f%% | respA=%.2f%% | respB=%.2f%%", *(pct(F.col(f"trunc_{n}")) for n in LENGTHS))),
        (F.col("split"), three, F.lit(0), text("mean cosine=%.3f | mean jaccard=%.3f | cosine>=0.9: %.2f%% | jaccard>=0.8: %.2f%%", F.round("cosine_mean", 3), F.round("jaccard_mean", 3), pct(F.col("cosine_high")), pct(F.col("jaccard_high")))),
        (F.col("split"), F.lit(4), F.lit(0), text("near duplicates: %d of %d", "near", "n")),
    )
    one_digit = lambda c: F.coalesce(F.round(c, 1), F.lit(0.0))
    label = _rows(_by_label(df), (F.col("split"), F.lit(5), F.coalesce(F.col("label"), F.lit(-1)).cast("int"), text("label=%d | A mean=%.1f (std %.1f) | B mean=%.1f (std %.1f)", F.coalesce(F.col("label"), F.lit(-1)), *(one_digit(F.col(c)) for c in ("a_mean", "a_std", "b_mean", "b_std")))))
    leak = _rows(pr.leakage(df).withColumn("split", F.lit("all")), (F.col("split"), F.lit(6), F.lit(0), text("prompts: train=%d | valid=%d | both=%d (%.2f%%)", "n_train", "n_valid", "n_both", "pct")))
    return split.unionByName(label).unionByName(leak).toDF("split", "section", "place", "line").select("section", "split", "place", "line")


def lines(df: DataFrame, limit: int = 512) -> list[str]:
    """The text of the audit, for runs.append_log()."""
    return [f"{r['section']}) {r['split']}: {r['line']}" for r in log(df, limit).orderBy("section", "split", "place").collect()]  # a few rows a split and label


def split_metadata(train: DataFrame, valid: DataFrame, dedup: DataFrame | None = None) -> DataFrame:
    """One row: rows and class percents of both sides, the share of swapped rows in train, 99th percentiles of the
    lengths of both responses over original rows, prompts of each side and on both, the fixed thresholds, and, from
    dedup_meta(), what was removed."""
    swapped = F.col("is_swapped") if "is_swapped" in train.columns else F.lit(0)
    columns = ("prompt_sig", "label", "respA_len", "respB_len")
    rows = train.select(*columns, swapped.alias("s"), F.lit("train").alias("split")).unionByName(valid.select(*columns, F.lit(0).alias("s"), F.lit("valid").alias("split")))
    side = lambda x: F.col("split") == x
    share = lambda x, k: pr.rnd(F.coalesce(F.try_divide(F.count_if(side(x) & (F.col("label") == k)) * 100.0, F.count_if(side(x))), F.lit(0.0))).alias(f"pct_{x}_{k}")
    p99 = [F.percentile(F.when(F.col("s") == 0, F.col(c)), 0.99).alias(f"p99_{c[:5]}") for c in ("respA_len", "respB_len")]
    row = rows.agg(*(F.count_if(side(x)).alias(f"n_{x}") for x in ("train", "valid")), *(share(x, k) for x in ("train", "valid") for k in range(3)), pr.rnd(F.coalesce(F.try_divide(F.count_if(side("train") & (F.col("s") == 1)) * 100.0, F.count_if(side("train"))), F.lit(0.0))).alias("is_swapped_train_pct"), *p99)
    leak = pr.leakage(rows).select(F.col("n_train").alias("prompts_unique_train"), F.col("n_valid").alias("prompts_unique_valid"), F.col("n_both").alias("prompts_intersection_count"), F.col("pct").alias("prompts_intersection_pct"))
    out = row.join(leak)  # single rows
    out = out.join(dedup) if dedup is not None else out
    return out.withColumns({k: F.lit(v) for k, v in THRESHOLDS.items()})


#: Texts of a sample, before and after cleaning.
TEXTS = ("prompt", "response_a", "response_b", "prompt_clean", "response_a_clean", "response_b_clean")


def sample_texts(df: DataFrame, n: int = 60, seed: int = 42) -> DataFrame:
    """split, row_idx and the texts of n rows of each split: those with the smallest hash of row and seed."""
    from . import topk

    mark = F.md5(F.concat(F.col("row_idx").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return topk.first(df.select("split", "row_idx", *TEXTS), ["split"], [mark, F.col("row_idx")], n, "place").drop("place")
