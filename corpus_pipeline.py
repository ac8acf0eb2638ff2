"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents, and any others, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from prefmill.llm import common, decontaminate, language_id, line_dedup, ngram_join, pieces

#: A text of LETTERS letters or more whose cosine with every prototype is within 2.5 standard deviations of what two
#: unrelated vectors have is in none of the languages. Ordinary text of that length lies at three times that and more.
LEAST_COSINE, LETTERS = 2.5 / language_id.DIM**0.5, 200
#: Ids of contaminated documents that are broadcast, at most (8 MB); more are joined by a shuffle of the documents.
LEAKS = 1_000_000


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with its columns of these names, in any case, under others; and the columns of docs as they were."""
    moved = {}
    for c in (c for c in docs.columns if c.lower() in names):
        moved[c] = f"kept_{len(moved)}"
        while moved[c] in docs.columns:
            moved[c] += "_"
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like none of the languages, go. Learns from the lang column of its input."""
    rows, back = aside(docs, "lang_pred", "score")
    with common.arrow_rows(spark, 500):
        model = language_id.learn(docs)
        guessed = language_id.predict(rows, model)
    if not model:
        return docs
    unlike = (F.col("score") < LEAST_COSINE) & (F.length(F.regexp_replace("text", r"\P{L}+", "")) >= LETTERS)
    return guessed.filter((F.col("lang_pred") != "und") & ~unlike).select(*back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and with them documents of which no word is left; n_chars, where it is a
    column, is counted anew where text changed. Documents that had no word from the start stay."""
    rows, back = aside(docs, "n_removed")
    with common.arrow_rows(spark, 500):
        out = line_dedup.dedup_lines(spark, rows, short=True).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return out.select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays (null last, of equal ids the first row). Documents
    without a word, such as empty and null texts, are in no group and stay."""
    docs = common.stored(spark, docs)
    with common.arrow_rows(spark, 500):
        found = common.materialise(spark, ngram_join.jaccard_components(spark, docs, groups=True), "pipeline-groups")
    none = F.col("doc_id").isNull().alias("none")
    first = found.filter("group_id is not null").groupBy("group_id").agg(F.min(F.struct(none, "doc_id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    stay = first.union(found.filter("group_id is null").select("rid"))
    rid = common.fresh(docs, "rid")
    return common.with_rid(docs, rid).join(stay.withColumnRenamed("rid", rid), rid, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = common.stored(spark, docs)
    hits, _ = decontaminate.occurrences(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rid = common.fresh(docs, "rid")
    gone = common.materialise(spark, hits.filter("n_hit > 0").select(F.col("rid").alias(rid)), "pipeline-leaks")
    if gone.count() <= LEAKS:
        gone = F.broadcast(gone)
    return common.with_rid(docs, rid).join(gone, rid, "left_anti").select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and the crc32 of the ids (little-endian 32-bit) of each document that is left."""

    def digest(batches):
        for b in batches:
            lists = b.column("piece_ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[i:j].astype("<u4").tobytes()) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "n_pieces", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.arrow_rows(spark, 500):
        return pieces.encode(rows, keep=False, then=digest, schema="doc_id long, n_pieces long, ids_crc32 long")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pieces", encode_pieces),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.materialise(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
