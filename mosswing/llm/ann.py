"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are rotated, kept in inverted lists, and scanned in blocks of columns: within a probed list a hypothesis test
on the partial distance abandons a candidate early. What remains is scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SAMPLE = 16_384
SCHEMA = "query_row long, query_id long, row long, vec_id long, score double"


def valid(vector: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, steps: int = 12) -> np.ndarray:
    """Lloyd's steps from rows spread over the sample; an empty list keeps its centre. Deterministic."""
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(steps):
        near = nearest_lists(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_lists(x: np.ndarray, c: np.ndarray, many: int) -> np.ndarray:
    """The `many` nearest centres of each row, nearest first; in blocks, so that memory is bounded."""
    out = np.empty((len(x), many), dtype=np.int32)
    norms = (c**2).sum(1)
    for a in range(0, len(x), 4096):
        d = norms - 2 * x[a : a + 4096] @ c.T
        top = np.argpartition(d, many - 1, axis=1)[:, :many] if many < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out[a : a + 4096] = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)
    return out


def scan(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray, blocks: list[slice], slack: float) -> np.ndarray:
    """Places in x of candidates that may be among q's k nearest.

    Before each block the 2k candidates nearest so far are measured whole; the k-th of them bounds the search. After t of d rotated dimensions, sqrt(d / t) times the partial distance estimates the whole; a candidate is given
    up when that exceeds the bound by the factor 1 + slack / sqrt(t).
    """
    d = x.shape[1]
    alive = np.flatnonzero(own)
    part = ((x[alive, blocks[0]] - q[blocks[0]]) ** 2).sum(1)
    if len(alive) <= 2 * k:
        return alive
    bound, seeds, done = np.inf, alive, blocks[0].stop
    for block in [*blocks[1:], None]:
        seeds = alive[np.argpartition(part, 2 * k - 1)[: 2 * k]] if len(alive) > 2 * k else alive
        if len(seeds) >= k:
            bound = min(bound, np.partition(((x[seeds] - q) ** 2).sum(1), k - 1)[k - 1])
        keep = part * (d / done) <= bound * (1 + slack / np.sqrt(done)) ** 2 + 1e-12
        keep |= np.isin(alive, seeds)
        alive, part = alive[keep], part[keep]
        if block is None:
            break
        part = part + ((x[alive, block] - q[block]) ** 2).sum(1)
        done = block.stop
    return alive


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, target: float = 0.97, slack: float = 2.1, block_dims: int = 8, chunk: int = 20_000, seed: int = 7
) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows by Euclidean distance on the original vectors.

    vectors has vec_id and embedding. Rows with an invalid vector, or another dimension than most, take no part. The
    index (centres, and how many lists to probe for the recall `target`) is fitted on at most SAMPLE rows and 128
    queries; every row is indexed. A query whose lists hold fewer than k other rows probes further ones until they
    do. A list longer than `chunk` rows is searched in chunks, and so are the queries that probe it, so that no group
    exceeds a bound. Rows are told apart by themselves: of rows that share a vec_id each is a query of its own with its
    own ranks, and a candidate for all but itself. Ties go to the smaller vec_id. Fewer than k other rows: all of them.
    No valid rows: an empty result. Other columns of the input are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(valid() & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["n"]
    rows = rows.where(F.size("v") == d).withColumn("row", F.monotonically_increasing_id())
    turn = rotation(d, seed)
    lists = int(max(1, min(4096, round(n**0.5 / 2))))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]) @ turn
    centres = centroids(sample, min(lists, len(sample)))
    lists = len(centres)
    sent = spark.sparkContext.broadcast((turn, centres))  # at most 4096 centres

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, c = sent.value
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()) @ t
                yield pd.DataFrame({"row": pdf["row"], "vec_id": pdf["vec_id"], "q": pdf["q"], "v": pdf["v"], "list": nearest_lists(x, c, 1)[:, 0]})

    indexed = cut(rows.mapInPandas(assign, "row long, vec_id long, q boolean, v array<double>, list int"))
    probes = _probes(indexed, sent, k, target, lists, d)

    counts = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    held = np.array([counts.get(i, 0) for i in range(lists)])

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, c = sent.value
        for pdf in frames:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                x = np.stack(part["v"].to_numpy()) @ t
                near = nearest_lists(x, c, probes)
                short = np.flatnonzero(held[near].sum(1) <= k)
                chosen = list(near)
                if len(short):
                    order = nearest_lists(x[short], c, lists)
                    enough = (held[order].cumsum(1) <= k).sum(1) + 1  # the first that brings k besides the row itself
                    for i, o, n in zip(short, order, enough):
                        chosen[i] = o[: max(n, probes)]
                yield pd.DataFrame({"row": part["row"], "vec_id": part["vec_id"], "v": part["v"], "list": chosen}).explode("list").astype({"list": np.int32})

    wanted = cut(indexed.where("q").select("row", "vec_id", "v").mapInPandas(probe, "row long, vec_id long, v array<double>, list int"))
    asked = {r["list"]: r["n"] for r in wanted.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts_of = lambda of: F.element_at(F.array(*[F.lit(max(1, -(-of.get(i, 0) // chunk))) for i in range(lists)]), F.col("list") + 1)
    row_parts, query_parts = parts_of(counts), parts_of(asked)
    hashed = lambda x: F.pmod(F.xxhash64("row", F.lit("chunk")), x).cast("int")
    left = wanted.withColumns({"qc": hashed(query_parts), "rc": F.explode(F.sequence(F.lit(0), row_parts - 1))})
    # a row is copied only for the parts of the queries that probe its own list
    right = indexed.where(F.col("list").isin(sorted(asked))).select("row", "vec_id", "v", "list").withColumns({"rc": hashed(row_parts), "qc": F.explode(F.sequence(F.lit(0), query_parts - 1))})
    blocks = [slice(a, min(d, a + block_dims)) for a in range(0, d, block_dims)]

    def nearest(qs: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(xs):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []})
        t, _ = sent.value
        xs = xs.sort_values("vec_id", kind="stable")
        ids, rows_, x = xs["vec_id"].to_numpy(), xs["row"].to_numpy(), np.stack(xs["v"].to_numpy())
        turned = x @ t
        out = []
        for q_row, q_id, q in zip(qs["row"], qs["vec_id"], qs["v"]):
            at = scan(q @ t, turned, k, rows_ != q_row, blocks, slack)
            score = np.sqrt(((x[at] - q) ** 2).sum(1))
            best = np.lexsort((ids[at], score))[:k]
            out.append(pd.DataFrame({"query_row": q_row, "query_id": q_id, "row": rows_[at][best], "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out)

    by = ["list", "rc", "qc"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, SCHEMA)
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(indexed: DataFrame, sent, k: int, target: float, lists: int, d: int, most: int = 128) -> int:
    """How many lists hold `target` of the true neighbours of at most 128 of the queries, found by brute force.

    Each partition keeps k candidates a query, so little moves.
    """
    picked = indexed.where("q").orderBy(F.xxhash64("vec_id"), "row").limit(most).collect()
    if not picked:
        return 1
    ids, q = np.array([r["row"] for r in picked]), np.array([r["v"] for r in picked])
    held = indexed.sparkSession.sparkContext.broadcast((ids, q))

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = held.value
        best_s, best_l = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        for pdf in frames:
            for a in range(0, len(pdf), 8192):
                x = np.stack(pdf["v"][a : a + 8192].to_numpy())
                s = (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)
                s[ids[:, None] == pdf["row"][a : a + 8192].to_numpy()] = np.inf
                s = np.concatenate([best_s, s], axis=1)
                l = np.concatenate([best_l, np.tile(pdf["list"][a : a + 8192].to_numpy(), (len(q), 1))], axis=1)  # noqa: E741
                at = np.argpartition(s, k - 1, axis=1)[:, :k]
                best_s, best_l = np.take_along_axis(s, at, 1), np.take_along_axis(l, at, 1)
        yield pd.DataFrame({"q": np.repeat(np.arange(len(q)), k), "score": best_s.ravel(), "list": best_l.ravel()}).query("list >= 0")

    rows = indexed.select("row", "v", "list").mapInPandas(top, "q int, score double, list int")
    order = Window.partitionBy("q").orderBy("score")
    best = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "list").toPandas()
    turn, centres = sent.value
    near = nearest_lists(q @ turn, centres, lists)
    place = np.argsort(near, axis=1)[best["q"].to_numpy(), best["list"].to_numpy()]
    return int(np.quantile(place, target, method="higher")) + 1 if len(place) else 1


def op5_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
