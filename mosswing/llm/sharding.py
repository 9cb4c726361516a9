"""Histogram sort into shards: exact byte counts below candidate boundaries refine the splitters, then one exchange.

Native: DataFrame functions only. Keys are (hash of the text, hash of the id), so equal texts are neighbours and a
boundary falls inside a group of equal texts only where the group alone exceeds the tolerance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_of

BITS = 63
Cut = tuple[int, int]


def _key_columns(docs: DataFrame) -> DataFrame:
    high = F.shiftrightunsigned(F.xxhash64(text_of()), 1)
    low = F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col("doc_id")), 1)
    return docs.select("*", high.alias("_hs_k1"), low.alias("_hs_k2"), (F.octet_length(text_of()).cast("long") + 1).alias("_hs_size"))


def _splitters(keys: DataFrame, shards: int, tolerance: float, step: int = 12) -> tuple[list[Cut], int]:
    """Boundaries of which each leaves within tolerance of i/shards of the bytes below it, or is the nearest row's edge.

    Every round counts exact bytes in 2^step bins of each open interval, in one pass over the keys; the driver gets at
    most shards * 2^step sums. An interval is (fixed high part, fixed low part, bits left of each).
    """
    total = keys.agg(F.sum("_hs_size")).first()[0] or 0
    allowed = tolerance * total / shards
    targets = [total * i / shards for i in range(1, shards)]
    # per target: key prefix as (k1 prefix, bits of k1 fixed, k2 prefix, bits of k2 fixed), bytes below the interval
    state: list[tuple[int, int, int, int, int]] = [(0, 0, 0, 0, 0)] * len(targets)
    cuts: list[Cut | None] = [None] * len(targets)
    rounds = 0
    while total and any(c is None for c in cuts):
        rounds += 1
        opened = sorted({state[i] for i, c in enumerate(cuts) if c is None})
        parts: list[Column] = []
        for n, (p1, f1, p2, f2, _) in enumerate(opened):
            inside = F.shiftrightunsigned("_hs_k1", BITS - f1) == p1 if f1 else F.lit(True)
            if f1 == BITS:
                inside = inside & (F.shiftrightunsigned("_hs_k2", BITS - f2) == p2 if f2 else F.lit(True))
                child = F.shiftrightunsigned("_hs_k2", BITS - min(BITS, f2 + step))
            else:
                child = F.shiftrightunsigned("_hs_k1", BITS - min(BITS, f1 + step))
            parts.append(F.when(inside, F.struct(F.lit(n).alias("n"), child.alias("bin"))))
        binned = keys.select("_hs_k1", "_hs_size", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("b"))
        sums = binned.groupBy("b.n", "b.bin").agg(F.sum("_hs_size").alias("bytes"), F.min("_hs_k1").alias("low"), F.max("_hs_k1").alias("high")).collect()
        by_interval: dict[int, list] = {}
        for row in sums:
            by_interval.setdefault(row["n"], []).append(row)
        for i, target in enumerate(targets):
            if cuts[i] is not None:
                continue
            p1, f1, p2, f2, below = state[i]
            bins = sorted(by_interval.get(opened.index(state[i]), []), key=lambda r: r["bin"])
            if not bins:
                cuts[i] = _edge(p1, f1, p2, f2)
                continue
            at = below
            for row in bins:
                if at + row["bytes"] >= target or row is bins[-1]:
                    break
                at += row["bytes"]
            n1, n2 = (f1, min(BITS, f2 + step)) if f1 == BITS else (min(BITS, f1 + step), 0)
            child = (row["bin"], n1, 0, 0) if f1 < BITS else (p1, BITS, row["bin"], n2)
            after = at + row["bytes"]
            lower = abs(target - at) <= abs(after - target)
            nearest = target - at if lower else after - target
            if nearest <= allowed or child[3] == BITS:
                cuts[i] = _edge(*child) if lower else _edge(*child, after=True)
            else:
                if row["low"] == row["high"]:  # one group of equal texts: go on inside it
                    child = (row["low"], BITS, child[2] if f1 == BITS else 0, child[3] if f1 == BITS else 0)
                state[i] = (*child, at)
    return [c or (0, 0) for c in cuts], rounds


def _edge(p1: int, f1: int, p2: int, f2: int, after: bool = False) -> Cut:
    """The first key in a bin, or the first one after it."""
    if f1 < BITS or not f2:
        return (p1 + after) << (BITS - f1), 0
    low = (p2 + after) << (BITS - f2)
    return (p1, low) if low < 1 << BITS else (p1 + 1, 0)


def histogram_sort_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, cell_rows: int = 50_000) -> DataFrame:
    """docs with shard (0..shards-1) and slot (gapless from 0 in each shard), sorted by key inside a shard's cells.

    Law: bytes. A shard's UTF-8 bytes (+1 a row) differ from the mean by at most `tolerance`, or by the row at the
    boundary. Null texts are empty; rows that repeat stay apart rows; equal (text, id) pairs share a shard. An empty
    table gives an empty result. Other columns are kept; columns shard, slot and size of the input are replaced.

    The keys (ids, hashes, sizes) are stored once; no pass but the first reads texts until the one exchange, which
    moves rows by cell: a range of keys with about cell_rows rows, a hot key being split by the id's hash.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot", "size")]
    rows = _key_columns(docs.select(*keep))
    keys = cut(rows.select("_hs_k1", "_hs_k2", "_hs_size"))
    cuts, _ = _splitters(keys, shards, tolerance)
    n = keys.count()
    bits = max(0, (max(1, n // cell_rows) - 1).bit_length())

    def celled(df: DataFrame) -> DataFrame:
        above = [(F.col("_hs_k1") > a) | ((F.col("_hs_k1") == a) & (F.col("_hs_k2") >= b)) for a, b in cuts]
        shard = reduce(lambda x, y: x + y, [c.cast("int") for c in above], F.lit(0))
        return df.withColumns({"shard": shard, "_hs_c1": F.shiftrightunsigned("_hs_k1", BITS - bits) if bits else F.lit(0).cast("long")})

    counts = celled(keys).groupBy("shard", "_hs_c1").agg(F.count("*").alias("rows"))
    hot = counts.where(F.col("rows") > 4 * cell_rows).select(
        "shard", "_hs_c1", F.least(F.lit(20), F.ceil(F.log2(F.col("rows") / cell_rows))).cast("int").alias("_hs_split"))
    n_hot = hot.count()  # a hot cell has over 4 * cell_rows rows, so there are few

    def split(df: DataFrame) -> DataFrame:
        if not n_hot:
            return df.withColumn("_hs_c2", F.lit(0).cast("long"))
        joined = df.join(F.broadcast(hot) if n_hot <= 100_000 else hot, ["shard", "_hs_c1"], "left")
        low = F.expr(f"shiftrightunsigned(_hs_k2, {BITS} - _hs_split)")
        return joined.withColumn("_hs_c2", F.when(F.col("_hs_split").isNull(), F.lit(0).cast("long")).otherwise(low)).drop("_hs_split")

    cells = split(celled(keys)).groupBy("shard", "_hs_c1", "_hs_c2").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("shard").orderBy("_hs_c1", "_hs_c2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "_hs_c1", "_hs_c2", F.coalesce(F.sum("_rows").over(order), F.lit(0)).alias("_hs_before"))
    placed = split(celled(rows)).join(offsets, ["shard", "_hs_c1", "_hs_c2"])
    in_cell = F.row_number().over(Window.partitionBy("shard", "_hs_c1", "_hs_c2").orderBy("_hs_k1", "_hs_k2", "_hs_size"))
    return placed.select(*keep, F.col("_hs_size").alias("size"), "shard", (F.col("_hs_before") + in_cell - 1).cast("long").alias("slot"))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_crc32", F.crc32(text_of()))
    out = histogram_sort_shards(docs, shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
