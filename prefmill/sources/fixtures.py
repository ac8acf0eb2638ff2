"""Tables derived from the driver's tables: battles (raw preference rows), scores, template rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import store


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_index(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """Row numbers from 0 in the given order, without gathering rows in one task: a range sort, the size of each
    partition (one row each to the driver), and an offset added to the place in the partition."""
    place = F.monotonically_increasing_id()
    kept = store(df.orderBy(*order).withColumn("_at", place), "ordered")
    part, low = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, at = [], 0
    for r in kept.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], at))
        at += r["count"]
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "p int, off long"))
    return kept.withColumn("p", part).join(table, "p").withColumn(name, F.col("off") + low).drop("_at", "p", "off")


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in text order make a pair; the prompt comes from benchmark."""
    s = with_row_index(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").withColumn("row_idx", F.floor(F.col("rn") / 2))
    side = F.col("rn") % 2
    p = s.groupBy("row_idx").agg(F.max(F.when(side == 0, F.col("text"))).alias("response_a"), F.max(F.when(side == 1, F.col("text"))).alias("response_b"), F.min("doc_id").alias("d")).filter("response_b is not null")
    bench = read(spark, sf_dir, "benchmark")
    n = bench.count()
    items = bench.select("item_id", F.col("text").alias("prompt"))
    p = p.join(items, F.pmod("row_idx", F.lit(n)) == F.col("item_id"))
    flag = lambda k: F.when(F.col("d") % 3 == k, 1).otherwise(0)
    return p.select("row_idx", F.col("row_idx").alias("id"), "prompt", "response_a", "response_b", F.concat(F.lit("model_"), (F.col("d") % 7).cast("string")).alias("model_a"), F.concat(F.lit("model_"), (F.col("d") % 5).cast("string")).alias("model_b"), flag(0).alias("winner_model_a"), flag(1).alias("winner_model_b"), flag(2).alias("winner_tie"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic model scores, arithmetic on row_idx."""
    r = F.col("row_idx")
    part = lambda a, m, d, s=0.0: ((r * a) % m).cast("double") / F.lit(d) - F.lit(s)
    y = F.when(F.col("winner_tie") == 1, 2).when(F.col("winner_model_a") == 1, 0).otherwise(1)
    return battles(spark, sf_dir).select(r.alias("id"), y.alias("y_true"), part(37, 101, 25.0, 2.0).alias("s_a"), part(53, 97, 24.0, 2.0).alias("s_b"), part(11, 7, 3.0).alias("z_a"), part(13, 5, 2.0).alias("z_b"), part(17, 3, 1.0).alias("z_tie"))


def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_row_index(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", name="row_idx")
    return s.select("row_idx", F.floor(F.col("row_idx") / 16).alias("prompt_sig"), F.col("text").alias("template"))


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


