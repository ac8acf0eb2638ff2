"""The first rows of each group, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Of each group the columns of its greatest row by `order`: one aggregate, which tasks begin on their own rows."""
    rows = df.groupBy(*by).agg(F.max(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.struct(*columns).alias("row"))).alias("best"))
    return rows.select(*by, *[F.col(f"best.row.{c}").alias(c) for c in columns])


def first(df: DataFrame, by: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group, numbered from 1. As the number is only asked for up to k, every task sorts its own
    rows and passes on k of each group (WindowGroupLimit), and what meets are those: k rows a task, not the group."""
    return df.withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def with_groups(df: DataFrame, by: str, groups: DataFrame) -> DataFrame:
    """df with the columns of groups (one row for each value of `by`, null included). A group with many rows may be split:
    the side of the groups has one row for it."""
    of = groups.withColumnRenamed(by, "of_group")
    return df.join(of, df[by].eqNullSafe(of["of_group"]), "left").drop("of_group")
