"""Distances as JVM expressions in double precision; less is nearer for all three metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda x, y: x + y)


def doubles(vector: Column | str) -> Column:
    return (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def negative_dot(a: Column, b: Column) -> Column:
    return -_sum(a, b, lambda x, y: x * y)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    length = F.sqrt(_sum(vector, vector, lambda x, y: x * y))
    return F.when(length > 0, F.transform(vector, lambda x: x / length)).otherwise(vector)


def distance(metric: str, rows: Column | str, query: list[float]) -> Column:
    """Of a vector column to one query, whose length is made one on the driver for cosine."""
    v = doubles(rows)
    if metric == "cosine":
        length = math.sqrt(sum(float(x) * float(x) for x in query))
        query = [x / length for x in query] if length else query
        # dividing the product by the row's length is the same as making the row's length one
        own = F.sqrt(_sum(v, v, lambda x, y: x * y))
        product = negative_dot(v, literal(query))
        return F.when(own > 0, product / own).otherwise(product)
    return (squared_l2 if metric == "l2" else negative_dot)(v, literal(query))


def relevance(metric: str, raw: Column) -> Column:
    """A leg's raw distance as a relevance that grows with nearness: (1+s)/2 for cosine, 1 - sqrt(d)/sqrt(2) for L2."""
    if metric == "cosine":
        return (1 - raw) / 2
    return 1 - F.sqrt(raw) / math.sqrt(2) if metric == "l2" else -raw


def similarity(metric: str, raw: Column) -> Column:
    """1 / (1 + distance) for L2, the product for the others."""
    return 1 / (1 + raw) if metric == "l2" else -raw
