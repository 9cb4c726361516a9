"""The state after an ordered command log, as relational plans without user code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(upserts: DataFrame, id_col: str, seq: str = "seq", pos: str | None = None) -> DataFrame:
    """The last version of each id; within one command the later position wins."""
    order = Window.partitionBy(id_col).orderBy(F.desc(seq), *([F.desc(pos)] if pos else []))
    return upserts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fold(upserts: DataFrame, deletes: DataFrame, id_col: str, wheres: list[tuple[int, Column]] = (), seq: str = "seq", pos: str | None = None) -> DataFrame:
    """Live rows: the last version of each id, unless a later delete names it or a later delete-where matches it.

    One shuffle by id serves both the versions and the deletes; a delete-where is a condition on the row and its seq.
    """
    live = latest(upserts, id_col, seq, pos)
    last = deletes.groupBy(F.col(id_col).alias("_id")).agg(F.max(seq).alias("_deleted"))
    live = live.join(last, (live[id_col] == last["_id"]) & (last["_deleted"] > live[seq]), "left_anti")
    for at, matches in wheres:
        live = live.where(~((F.col(seq) < at) & F.coalesce(matches, F.lit(False))))
    return live


def delete_where_counts(upserts: DataFrame, deletes: DataFrame, id_col: str, at: int, matches: Column, seq: str = "seq") -> DataFrame:
    """One row, `count`: the rows that a delete-where at position `at` removes."""
    before = fold(upserts.where(F.col(seq) < at), deletes.where(F.col(seq) < at), id_col, seq=seq)
    return before.agg(F.count_if(F.coalesce(matches, F.lit(False))).alias("count"))


def apply_patches(live: DataFrame, patches: DataFrame, id_col: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """live with each patch's fields set or cleared in the order of seq; patches of ids that are not live are skipped.

    patches: id, seq, and for each field f the columns set_f (boolean: this patch touches f) and f (its new value or
    null). The last patch that touches a field decides it.
    """
    decided = patches.groupBy(F.col(id_col).alias("_patched")).agg(
        *[F.max_by(F.struct(F.lit(True).alias("touched"), F.col(f).alias("value")), F.when(F.col(f"set_{f}"), F.col(seq))).alias(f"_{f}") for f in fields]
    )
    joined = live.join(decided, live[id_col] == decided["_patched"], "left")
    new = {f: F.when(F.col(f"_{f}.touched"), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(new).select(*live.columns)


def keyed_order(upserts: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, ord: text ids sort by their last write, so a rewritten one moves to the end."""
    return upserts.groupBy(key).agg(F.max(seq).alias("ord"))
