"""Serving: rows without labels, cleaned as a batch, one by one or from a file, and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evaluation as ev, preference as pf, scoring
from ..sources import quoted

_TEXTS = "id string, prompt string, response_a string, response_b string"


def clean_single(spark: SparkSession, prompt: str | None, response_a: str | None, response_b: str | None, id: str = "single") -> DataFrame:
    """A batch of one row; its own lengths are the batch's 99th percentiles, so both responses go through compression."""
    return pf.serving_clean(spark.createDataFrame([(str(id), prompt, response_a, response_b)], _TEXTS))


def clean_path(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a delimited file with a header, which may have other columns. Files are read in parallel."""
    return pf.serving_clean(quoted.read_quoted(spark, path))


def predict_batch(rows: DataFrame, head: scoring.Head | None = None, first: str = "va", second: str = "vb") -> DataFrame:
    """id, prob_A, prob_B, prob_TIE, pred_label: by a head, from columns of vectors; the placeholder where there is none
    of either, as serving answers whatever is missing."""
    if head is None or not {first, second} <= set(rows.columns):
        return ev.placeholder(rows)
    return scoring.predict(rows, head, first, second)


def predict_single(row: DataFrame, head: scoring.Head | None = None) -> dict:
    """The answer to the first row."""
    return predict_batch(row.limit(1), head).first().asDict()


def controlled(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, prompt_clean, and for each response: its text where it came through unchanged, else null, and whether it is
    within 160 tokens or unchanged."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col("b.id") == F.col("a.id"))
    out = [F.col("a.id").alias("id"), F.col("a.prompt_clean").alias("prompt_clean")]
    for c in ("response_a_clean", "response_b_clean"):
        same = F.col(f"b.{c}") == F.col(f"a.{c}")
        out += [F.when(same, F.col(f"a.{c}")).alias(c), (same | (F.size(F.split(F.col(f"a.{c}"), " ")) <= 160)).alias(f"{c[:10]}_fits")]
    return both.select(*out)
