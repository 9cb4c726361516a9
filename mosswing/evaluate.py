"""Retrieval measures over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(got: Column | str, truth: Column | str, k: int) -> Column:
    """Of two arrays of ids: how many of the true k were got, over k."""
    return F.size(F.array_intersect(got, truth)) / F.lit(k)


def mean_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """found and truth: query_id, rank, id. One row, recall."""
    hit = truth.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "id"), ["query_id", "id"], "left_semi")
    return hit.agg(F.count("*").alias("hits")).crossJoin(truth.where(F.col("rank") <= k).agg(F.count("*").alias("n"))).select((F.col("hits") / F.col("n")).alias("recall"))


def mrr(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """found: query_id, rank, id; relevant: query_id, id. One row, mrr over the queries that have relevant ids."""
    first = found.where(F.col("rank") <= k).join(relevant, ["query_id", "id"]).groupBy("query_id").agg((1 / F.min("rank")).alias("r"))
    return relevant.select("query_id").distinct().join(first, "query_id", "left").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("mrr"))
