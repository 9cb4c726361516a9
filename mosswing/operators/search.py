"""Hybrid search: legs under one filter, fused, grouped, and joined to their documents at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import Everything
from ..plans.request import MAX_K, SearchRequest
from ..schema import Schema
from .bm25 import bm25
from .fusion import fuse, ranked_leg
from .knn import exact_knn

LEGS = "array<struct<rank:int,score:double>>"
Leg = Callable[..., DataFrame]


def hits(df: DataFrame, request: SearchRequest, schema: Schema, id_col: str = "id", restrict: Column | None = None, digits: int | None = None, text_leg: Leg | None = None, vector_leg: Leg | None = None) -> DataFrame:
    """id, score, legs of the k best; without legs, the first k ids that pass the filter, score 0.

    restrict is a condition besides the request's own (tenant, retention); neither touches BM25 statistics. text_leg
    and vector_leg, if given, find a leg's hits (id, score) by an index: (leg, depth, condition or None, digits).
    """
    where = request.where.column()
    where = where if restrict is None else where & restrict
    if not request.vectors and request.text is None:
        first = df.where(where).select(F.col(id_col).alias("id")).orderBy("id").limit(request.k)
        return first.select("id", F.lit(0.0).alias("score"), F.array().cast(LEGS).alias("legs"))
    some = None if restrict is None and isinstance(request.where, Everything) else where
    legs = []
    for i, leg in enumerate(request.vectors):
        if vector_leg:
            found = vector_leg(leg, request.depth, some, digits)
        else:
            found = exact_knn(df, id_col, leg.field, list(leg.vector), schema[leg.field].metric, request.depth, where, digits)
        legs.append(ranked_leg(found, i, False))
    if request.text:
        t = request.text
        found = text_leg(t, request.depth, some, digits) if text_leg else bm25(df, id_col, t.field, t.query, request.depth, t.match_all, where, digits=digits)
        legs.append(ranked_leg(found, len(legs), True))
    return fuse(legs, request.fusion, request.k, digits)


def best_of_groups(found: DataFrame, df: DataFrame, field: str, k: int, id_col: str = "id") -> DataFrame:
    """The best hit for each value of a field; a null value is a group of its own. Hits are MAX_K at most: df is not shuffled."""
    values = df.select(F.col(id_col).alias("id"), F.col(field).alias("group"))
    grouped = values.join(F.broadcast(found.limit(MAX_K)), "id")
    own = F.when(F.col("group").isNull(), F.struct(F.lit(True), F.to_json(F.struct("id")))).otherwise(F.struct(F.lit(False), F.col("group").cast("string")))
    order = Window.partitionBy(own).orderBy(F.desc("score"), "id")
    first = grouped.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.select("id", "score", "legs", "group").orderBy(F.desc("score"), "id").limit(k)


def search(df: DataFrame, request: SearchRequest, schema: Schema, id_col: str = "id", restrict: Column | None = None, digits: int | None = None, text_leg: Leg | None = None, vector_leg: Leg | None = None) -> DataFrame:
    """Hits, with group where asked for, and the documents' fields as `doc` if the request wants them.

    Grouping widens the search from 4k hits, doubling up to the cap, until k groups are found or no hits are left.
    """
    request.check(schema)
    if request.group_by is None:
        found = hits(df, request, schema, id_col, restrict, digits, text_leg, vector_leg)
    else:
        wide = min(MAX_K, 4 * request.k)
        while True:
            raw = hits(df, request.widened(wide), schema, id_col, restrict, digits, text_leg, vector_leg).cache()
            found = best_of_groups(raw, df, request.group_by, request.k, id_col).cache()
            if found.count() >= request.k or raw.count() < wide or wide >= MAX_K:
                break
            wide = min(MAX_K, 2 * wide)
    if not request.with_documents:
        return found
    docs = df.select(F.col(id_col).alias("id"), F.struct(*[f.name for f in schema.fields if f.name in df.columns]).alias("doc"))
    return docs.join(F.broadcast(found), "id").select(*found.columns, "doc").orderBy(F.desc("score"), "id")  # at most MAX_K hits
