"""Fusion of ranked legs into one ranking, with each leg's rank and raw score kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rrf:
    k: float = 60.0


@dataclass(frozen=True)
class Weighted:
    weights: tuple[float, ...]


def ranked_leg(hits: DataFrame, leg: int, higher_is_better: bool) -> DataFrame:
    """leg, id, rank (from 0), score, up; hits are at most k' rows."""
    order = Window.orderBy(F.desc("score") if higher_is_better else F.asc("score"), "id")
    return hits.select(F.lit(leg).alias("leg"), "id", (F.row_number().over(order) - 1).alias("rank"), F.col("score").cast("double"), F.lit(higher_is_better).alias("up"))


def fuse(legs: list[DataFrame], how: Rrf | Weighted, k: int, digits: int | None = None) -> DataFrame:
    """id, score, legs (array of {rank, score} or null), the k best by score, then id.

    Weighted: each leg's scores are scaled to 0..1 over its hits; distances count as one minus that. A leg whose scores
    are all equal scales to 1, so that it adds nothing if it is a distance and its weight if it is a text score.
    """
    hits = legs[0]
    for leg in legs[1:]:
        hits = hits.unionAll(leg)
    if isinstance(how, Rrf):
        hits = hits.withColumn("part", 1 / (F.lit(float(how.k)) + F.col("rank") + 1))
    else:
        own = Window.partitionBy("leg")
        low, high = F.min("score").over(own), F.max("score").over(own)
        norm = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), F.col("leg") + 1)
        hits = hits.withColumn("part", weight * F.when(F.col("up"), norm).otherwise(1 - norm))
    each = [F.max(F.when(F.col("leg") == i, F.struct(F.col("rank").cast("int").alias("rank"), "score"))) for i in range(len(legs))]
    total = F.sum("part") if digits is None else F.round(F.sum("part"), digits)
    return hits.groupBy("id").agg(total.alias("score"), F.array(*each).alias("legs")).orderBy(F.desc("score"), "id").limit(k)
