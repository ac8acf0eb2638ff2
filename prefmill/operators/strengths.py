"""Bradley-Terry strengths by minorise-maximise rounds.

Battles are added up to pairs of players first, so a round joins as many rows as there are pairs, whatever the number of
battles. Player i's new strength is its wins (a tie is half a win) divided by the sum over its opponents j of the games
played / (strength i + strength j). A few rounds make one job, whose result is stored; rounds end when no strength has
changed by more than `tolerance` of itself. Strengths compare only within a component of players that are connected by
games; there they are scaled to a mean of 1. A player without a win ends at 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import store
from .preference import components, label

BLOCK = 5


def pair_counts(battles: DataFrame) -> DataFrame:
    """i, j, wins of i, games, for either order. Battles without exactly one outcome, or of a model with itself, or with
    a null model, don't count."""
    won = F.when(F.col("label") == 0, 1.0).when(F.col("label") == 1, 0.0).otherwise(0.5)
    rows = battles.withColumn("label", label()).filter("label is not null and model_a <> model_b")
    sides = F.array(F.struct(F.col("model_a").alias("i"), F.col("model_b").alias("j"), won.alias("won")), F.struct(F.col("model_b").alias("i"), F.col("model_a").alias("j"), (1 - won).alias("won")))
    return rows.select(F.inline(sides)).groupBy("i", "j").agg(F.sum("won").alias("wins"), F.count("*").alias("games"))


def _round(pairs: DataFrame, p: DataFrame) -> DataFrame:
    own, other = p.select("i", F.col("p").alias("pi"), "wins"), p.select(F.col("i").alias("j"), F.col("p").alias("pj"))
    share = F.when(F.col("pi") + F.col("pj") > 0, F.col("games") / (F.col("pi") + F.col("pj")))
    met = pairs.select("i", "j", "games").join(own, "i").join(other, "j").groupBy("i").agg(F.first("wins").alias("wins"), F.first("pi").alias("last"), F.sum(share).alias("d"))
    return met.select("i", "wins", F.coalesce(F.try_divide(F.col("wins"), F.col("d")), F.lit(0.0)).alias("p"), "last")


def strengths(battles: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """model, component (its smallest model), strength, wins, games."""
    pairs = store(pair_counts(battles), "pairs")
    p = pairs.groupBy("i").agg(F.sum("wins").alias("wins")).withColumn("p", F.lit(1.0))
    for k in range(0, rounds, BLOCK):
        for _ in range(min(BLOCK, rounds - k)):
            p = _round(pairs, p)
        p = store(p, "strengths")
        if tolerance and not p.filter(F.abs(F.col("p") - F.col("last")) > tolerance * F.greatest("p", F.lit(1e-12))).head(1):
            break
    found = components(p.select(F.col("i").alias("row_idx")), pairs.select(F.col("i").alias("a"), F.col("j").alias("b"))).withColumnRenamed("row_idx", "i")
    games = pairs.groupBy("i").agg(F.sum("games").alias("games"))
    rows = p.join(found, "i").join(games, "i")
    means = rows.groupBy("component").agg(F.avg("p").alias("mean"))
    scaled = F.coalesce(F.try_divide(F.col("p"), F.col("mean")), F.lit(0.0))
    return rows.join(means, "component").select(F.col("i").alias("model"), "component", scaled.alias("strength"), "wins", "games")
