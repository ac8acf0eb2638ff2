"""Quality classifier by importance resampling (op 4).

Words [^\\x20\\x09-\\x0D]+ (A-Z lower-cased) and pairs of neighbouring words are hashed into BUCKETS buckets. Two
generative models are the smoothed bucket shares of target text (documents labelled quality 1 and not toxic) and of raw
text (all documents); a document's log importance ratio is the sum over its n-grams of the difference of their logs.
Gumbel noise, a function of the seed, the document and its place in the table, is added, and the documents with the k largest keys are the
sample (Gumbel top-k: drawing without replacement in proportion to the ratios). k is a share of the documents; if not
given, the share of quality 1 among the labelled ones.

The k-th key is found exactly by radix selection: the keys' order-preserving 64-bit codes, then row ids, are counted
by their next 16 bits, so the driver sees 65,536 counts at most at a time.

Cases: a null or empty text has no n-grams and ratio 0; without labelled target text both models are flat and noise
alone decides; ties go to the smaller doc_id, then the earlier row; a document labelled twice is target if any label
says so. Rows of equal doc_id, and repeated rows, have noise of their own
and are sampled one by one. Documents that are no scan of stored files are stored first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

BUCKETS, SEED = 16_384, 11
#: Target documents that the target model is fitted on, at most; if there are more, those with the smallest hashes.
LABELLED = 200_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def buckets(text: bytes, n: int) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours."""
    words = text.lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-1] >> np.uint64(31)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    both = np.concatenate([h, pairs])
    return ((both ^ (both >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def _counts(n: int):
    def run(batches):
        total = np.zeros((2, n), np.int64)
        for b in batches:
            for text, good in zip(common.raw_bytes(b.column("text")), b.column("target").to_pylist()):
                c = np.bincount(buckets(text, n), minlength=n)
                total[0] += c
                if good:
                    total[1] += c
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])

    return run


def fit(labelled: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket from documents (text, target): n rows of counts reach the driver."""
    rows = labelled.select("text", "target").mapInArrow(_counts(n), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.ones(n), np.ones(n)
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _code(key: np.ndarray) -> np.ndarray:
    """Signed 64-bit codes, larger for larger doubles."""
    bits = (key + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def score(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """rid, doc_id, log_ratio, key, code for each document."""

    @F.pandas_udf("log_ratio double, key double, code long")
    def measure(texts: pd.Series, ids: pd.Series, rids: pd.Series) -> pd.DataFrame:
        values = np.array([ratio[buckets((t or "").encode(), len(ratio))].sum() for t in texts], float)
        draws = np.array([xxhash.xxh3_64_intdigest(f"{i}/{r}/{t or ''}", seed=seed) for i, r, t in zip(ids, rids, texts)], np.uint64)
        key = values - np.log(-np.log((draws >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54))
        return pd.DataFrame({"log_ratio": values, "key": key, "code": _code(key)})

    rows = common.with_rid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.select("rid", "doc_id", measure("text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "rid").alias("m")).select("rid", "doc_id", "m.*")


def top_k(df: DataFrame, k: int) -> "F.Column":
    """Column that is true for the k first rows by code descending, doc_id (null last), rid: radix selection."""
    if k <= 0:
        return F.lit(False)
    order = [-(F.col("code") + 1), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("rid")]  # -(x + 1) turns the order round without overflow
    keep, tied = F.lit(False), F.lit(True)
    for column in order:
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(column.bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit(0xFFFF))
            seen, at = 0, None
            for r in sorted(df.filter(tied).groupBy(digit.alias("d")).count().collect(), key=lambda r: r["d"]):
                if seen + r["count"] >= k:
                    at = r["d"]
                    break
                seen += r["count"]
            if at is None:
                return keep | tied  # fewer than k rows
            keep, tied, k, whole = keep | (tied & (digit < at)), tied & (digit == at), k - seen, r["count"] == k - seen
            if whole:
                return keep | tied
    return keep | tied


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None, n: int = BUCKETS, seed: int = SEED, most: int = LABELLED) -> DataFrame:
    """doc_id, log_ratio, key, kept for each document."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target"), F.max((F.col("quality") == 1).cast("int")).alias("good"))
    if share is None:
        good, all_ = known.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
        share = good / all_ if all_ else 1.0
    targets = known.filter("target").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "target")
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(targets), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    scored = common.materialise(spark, score(docs, fit(labelled, n), seed), "op4-scored")
    return scored.select("doc_id", "log_ratio", "key", top_k(scored, round(share * scored.count())).alias("kept"))


def op4_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.arrow_rows(spark, 1000):
        return resample(spark, common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
