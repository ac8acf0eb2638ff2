"""The whole preparation of a raw preference table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import audit, preference as pf, profile as pr
from ..sources.store import store


def run(raw: DataFrame, stopwords=(), folds: int = 10, cells=tx.literal_cell) -> dict[str, DataFrame]:
    """raw: row_idx and the columns of the raw table. Cleaned base, deduplicated rows, train (with mirror images) and
    validation rows in order of row_idx, and the reports. What several branches read is stored; sources.store.release()
    deletes it when the frames are not needed any more."""
    base = store(pf.tail_control(pf.clean_base(raw, stopwords, cells)), "base")
    flags = store(pf.dedup_flags(pf.features(base)), "flags")
    kept = flags.filter("keep")
    reps = store(pf.template_clusters(pf.templates(kept)), "clusters")
    chosen = reps.filter((F.col("g") <= 10) | (F.col("place") <= 8)).select("row_idx")
    clean = store(kept.join(chosen, "row_idx", "left_semi").drop("hard", "near_same", "near_cross", "tie_trivial", "info", "keep").orderBy("row_idx"), "kept")
    sides, splitter = pf.split_with_tag(clean, folds)
    train, valid = sides.filter("split = 'train'").drop("split"), sides.filter("split = 'valid'").drop("split")
    return {
        "clean_base": base,
        "clean": clean.orderBy("row_idx"),
        "train_strat": pf.swap_union(train).orderBy("row_idx", "is_swapped"),
        "valid_strat": valid.orderBy("row_idx"),
        "dedup_meta": pf.dedup_meta(flags),
        "cluster_meta": pf.cluster_meta(reps),
        "split_metadata": audit.split_metadata(pf.swap_union(train), valid, pf.dedup_meta(flags)).withColumn("splitter", F.lit(splitter)),
        "audit_flags": audit.flags(sides),
        "audit_log": audit.log(sides),
        "sample_texts": audit.sample_texts(sides),
        "split_meta": pr.split_meta(sides).withColumn("splitter", F.lit(splitter)),
        "leakage": pr.leakage(sides),
        "class_balance": sides.groupBy("split", "label").agg(F.count("*").alias("count")),
        "length_stats": pr.length_stats(sides, "split", ("prompt_len", "respA_len", "respB_len")),
    }


def clean_test(raw: DataFrame) -> DataFrame:
    """Serving input without labels: the cleaned columns, blank responses as "no response"."""
    return pf.with_lengths(pf.clean_frame(raw, cells=tx.literal_cell))
