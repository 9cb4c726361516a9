"""Synthetic attributes and takedown schedules: pure functions of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, what: str, id_: Column | str = "id") -> Column:
    """A number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col(id_) if isinstance(id_, str) else id_), F.lit(1 << 40)) / float(1 << 40)


def zipf(seed: int, what: str, n: int) -> Column:
    """0..n-1 with weight 1/(i+1), by the inverse of the harmonic sum's logarithm."""
    return F.least(F.lit(n - 1), F.floor(F.exp(uniform(seed, what) * F.log(F.lit(float(n + 1)))) - 1)).cast("int")


def attributes(spark: SparkSession, n: int, seed: int = 1, clusters: int = 100, correlated: bool = False) -> DataFrame:
    """id, cluster, flags that hold for 50, 10, 1 and 0.1 % of rows, date, channel, rights, speaker.

    correlated: flags hold for whole clusters, not for rows at random.
    """
    df = spark.range(n).withColumn("cluster", F.floor(uniform(seed, "cluster") * clusters).cast("int"))
    on = "cluster" if correlated else "id"
    flags = {f"flag_{name}": uniform(seed, f"flag {name}", on) < share for name, share in (("50", 0.5), ("10", 0.1), ("1", 0.01), ("01", 0.001))}
    u, v = uniform(seed, "rights"), uniform(seed, "denied")
    rights = F.when(u < 0.4, "cleared").when(v < 0.7, "restricted").otherwise("pending")
    return df.withColumns(flags | {"date": F.floor(uniform(seed, "date") * 13149).cast("long"), "channel": zipf(seed, "channel", 12), "rights": rights, "speaker": zipf(seed, "speaker", 5000)})


def takedowns(spark: SparkSession, ids: int, count: int, span_ms: int, seed: int = 1) -> DataFrame:
    """at_ms, id: distinct ids, evenly spread over the span, in a seeded order."""
    picked = spark.range(ids).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count)
    order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id")) - 1
    return picked.select((order * span_ms / F.lit(max(1, count))).cast("long").alias("at_ms"), "id")
