"""Exact nearest neighbours under a filter, for one query or a batch; quantised and partitioned variants."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, doubles, unit

QUERY_BLOCK = 1024
ROW_BLOCK = 1024
PAIRS = 50_000


def exact_knn(df: DataFrame, id_col: str, vector: str, query: list[float], metric: str, k: int | None, where: Column | None = None, digits: int | None = None) -> DataFrame:
    """id, score of the k nearest rows (None: all) that pass `where`; rows without a vector are never returned; ties by id.

    One scan with a bounded heap in each task (TakeOrderedAndProject); the filter reaches the scan. With `digits`,
    scores are rounded before they are ranked.
    """
    rows = df if where is None else df.where(where)
    score = distance(metric, vector, query)
    score = score if digits is None else F.round(score, digits)
    scored = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), score.alias("score"))
    return scored if k is None else scored.orderBy("score", "id").limit(k)


def _matrix(vectors: pd.Series, metric: str) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
    return x


def _near(q: np.ndarray, x: np.ndarray, metric: str, k: int, least: np.ndarray, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row, distance of all pairs that may be among the k nearest: of what one product of matrices finds no farther
    than `least` by query or than the kth in x, with room for its error. Distances are of exact differences for L2."""
    rough = -(q @ x.T)
    room = 0.0 if digits is None else 10.0**-digits
    slack = np.full(len(q), room)
    if metric == "l2":  # the expanded form loses digits to cancellation
        ours, theirs = (q**2).sum(1), (x**2).sum(1)
        rough *= 2
        rough += ours[:, None]
        rough += theirs
        slack += 1e-9 * (ours + theirs.max(initial=0))
    bound = least + slack
    if np.isinf(least).any() and len(x) > k:
        bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
    at, n = np.nonzero(~(rough > bound[:, None]))  # what is no number stays, as the farthest
    if metric == "l2":
        d = np.empty(len(at))
        for a in range(0, len(at), PAIRS):
            d[a : a + PAIRS] = ((x[n[a : a + PAIRS]] - q[at[a : a + PAIRS]]) ** 2).sum(1)
    else:
        d = rough[at, n]
    return at, n, d if digits is None else np.round(d, digits)


def batch_knn(rows: DataFrame, id_col: str, vector: str, queries: DataFrame, metric: str, k: int, digits: int | None = 6) -> DataFrame:
    """query_id, rank (from 1), id, score for a table of queries (query_id, vector).

    Queries go in blocks of QUERY_BLOCK to every task, which keeps its own k nearest of each: what is shuffled is
    tasks * queries * k small rows, never a pair for each row.
    """
    spark = rows.sparkSession
    base = rows.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), doubles(vector).alias("v"))
    held = queries.where("vector is not null").select("query_id", doubles("vector").alias("v")).orderBy("query_id").toLocalIterator()
    block: list = []
    parts: list[DataFrame] = []

    def flush() -> None:
        if not block:
            return
        ids = np.array([r["query_id"] for r in block])
        sent = spark.sparkContext.broadcast((ids, _matrix(pd.Series([r["v"] for r in block]), metric)))
        block.clear()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            kept = pd.DataFrame({"at": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
            least = np.full(len(q), np.inf)  # what is farther is not among the k nearest
            for pdf in frames:
                for a in range(0, len(pdf), ROW_BLOCK):
                    part = pdf.iloc[a : a + ROW_BLOCK]
                    at, n, d = _near(q, _matrix(part["v"], metric), metric, k, least, digits)
                    kept = pd.concat([kept, pd.DataFrame({"at": at, "id": part["id"].to_numpy()[n], "score": d})])
                    if len(kept) > 4 * k * len(q) or np.isinf(least).any():
                        kept = kept.sort_values(["at", "score", "id"]).groupby("at").head(k)
                        full = kept.groupby("at")["score"].agg(["size", "max"])
                        full = full[full["size"] == k]
                        least[full.index.to_numpy()] = full["max"].to_numpy()
            kept = kept.sort_values(["at", "score", "id"]).groupby("at").head(k)
            yield pd.DataFrame({"query_id": ids[kept["at"].to_numpy()], "id": kept["id"], "score": kept["score"]})

        parts.append(base.mapInPandas(run, "query_id long, id long, score double"))

    for row in held:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


@dataclass(frozen=True)
class Sq8:
    """The least value and the step of each dimension: a code is one of 256 steps."""

    low: list[float]
    step: list[float]

    @classmethod
    def fit(cls, df: DataFrame, vector: str) -> Sq8:
        """Once for a table: two aggregates a dimension, in one pass."""
        d = df.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        if d is None:
            return cls([], [])
        edges = df.agg(*[f(F.col(vector)[i].cast("double")) for i in range(d[0]) for f in (F.min, F.max)]).first()
        low = [edges[2 * i] for i in range(d[0])]
        return cls(low, [max((edges[2 * i + 1] - edges[2 * i]) / 255, 1e-12) for i in range(d[0])])

    def codes(self, vector: str) -> Column:
        """A column to store; null for a null vector."""
        shifted = F.zip_with(doubles(vector), F.array(*map(F.lit, self.low)), lambda x, a: x - a)
        return F.zip_with(shifted, F.array(*map(F.lit, self.step)), lambda x, s: F.least(F.lit(255), F.greatest(F.lit(0), F.round(x / s))).cast("smallint"))

    def decoded(self, codes: str) -> Column:
        scaled = F.zip_with(F.col(codes).cast("array<double>"), F.array(*map(F.lit, self.step)), lambda x, s: x * s)
        return F.zip_with(scaled, F.array(*map(F.lit, self.low)), lambda x, a: x + a)


def sq8_knn(coded: DataFrame, sq8: Sq8, id_col: str, vector: str, query: list[float], metric: str, k: int, codes: str = "q8", rerank: int = 4) -> DataFrame:
    """The rerank * k nearest by stored codes, ranked again by exact distance; the first pass reads codes and ids only."""
    if not sq8.low:
        return coded.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rough = coded.where(F.col(codes).isNotNull()).select(F.col(id_col).alias("id"), distance(metric, sq8.decoded(codes), query).alias("rough"))
    first = rough.orderBy("rough", "id").limit(rerank * k).select("id")
    rows = coded.select(F.col(id_col).alias("id"), vector).join(F.broadcast(first), "id")  # rerank * k ids
    return rows.select("id", distance(metric, vector, query).alias("score")).orderBy("score", "id").limit(k)


@dataclass(frozen=True)
class Pq:
    """Product quantiser: for each run of `width` dimensions up to 256 centres, found on a bounded sample."""

    width: int
    centres: list[np.ndarray]

    @classmethod
    def fit(cls, df: DataFrame, vector: str, width: int = 4, codes: int = 256, sample: int = 20_000, steps: int = 12) -> Pq:
        some = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).select(doubles(vector).alias("v")).collect()
        if not some:
            return cls(width, [])
        x = np.array([r["v"] for r in some])
        return cls(width, [_kmeans(x[:, a : a + width], codes, steps) for a in range(0, x.shape[1], width)])

    def encoded(self, df: DataFrame, vector: str, name: str = "pq") -> DataFrame:
        """df with an array of one code a run; null for a null vector."""
        from pyspark.sql.functions import pandas_udf

        width, centres = self.width, self.centres

        @pandas_udf("array<smallint>")
        def codes(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), dtype=object)
            there = np.flatnonzero(v.notna().to_numpy())
            if len(there) and centres:
                x = np.stack(v.iloc[there].to_numpy()).astype(np.float64)
                runs = [((c**2).sum(1) - 2 * x[:, i * width : (i + 1) * width] @ c.T).argmin(1) for i, c in enumerate(centres)]
                for at, row in zip(there, np.stack(runs, axis=1).astype(np.int16)):
                    out.iloc[at] = row
            return out

        return df.withColumn(name, codes(F.col(vector)))

    def distance(self, codes: str, query: list[float], metric: str) -> Column:
        """Asymmetric: the sum of table entries, one a run, of the query to each centre."""
        q = np.asarray(query, dtype=np.float64)
        total = F.lit(0.0)
        for i, c in enumerate(self.centres):
            part = q[i * self.width : (i + 1) * self.width]
            entries = ((c - part) ** 2).sum(1) if metric == "l2" else -(c @ part)
            total = total + F.element_at(F.array(*[F.lit(float(e)) for e in entries]), F.col(codes)[i].cast("int") + 1)
        return total


def pq_knn(coded: DataFrame, pq: Pq, id_col: str, vector: str, query: list[float], metric: str, k: int, codes: str = "pq", rerank: int = 10) -> DataFrame:
    """The rerank * k nearest by product codes (cosine: for vectors of one length), ranked again by exact distance."""
    if not pq.centres:
        return coded.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).limit(0)
    rough = coded.where(F.col(codes).isNotNull()).select(F.col(id_col).alias("id"), pq.distance(codes, query, metric).alias("rough"))
    first = rough.orderBy("rough", "id").limit(rerank * k).select("id")
    rows = coded.select(F.col(id_col).alias("id"), vector).join(F.broadcast(first), "id")  # rerank * k ids
    return rows.select("id", distance(metric, vector, query).alias("score")).orderBy("score", "id").limit(k)


def _kmeans(x: np.ndarray, k: int, steps: int) -> np.ndarray:
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)]
    for _ in range(steps):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _direction(vector: str, metric: str) -> Column:
    return unit(doubles(vector)) if metric == "cosine" else doubles(vector)


def ivf_centres(df: DataFrame, vector: str, metric: str, lists: int, sample: int = 50_000) -> list[list[float]]:
    """Centres by Lloyd's steps on a bounded sample; of unit vectors for cosine."""
    some = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(vector)).limit(sample).select(_direction(vector, metric).alias("v")).collect()
    return _kmeans(np.array([r["v"] for r in some]), lists, 12).tolist() if some else []


def ivf_list(vector: str, centres: list[list[float]], metric: str) -> Column:
    """The list of each row's nearest centre; -1 for a null vector."""
    from pyspark.sql.functions import pandas_udf

    c = np.array(centres)

    @pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        out = np.full(len(v), -1, dtype=np.int32)
        there = np.flatnonzero(v.notna().to_numpy())
        for a in range(0, len(there), 4096):
            x = np.stack(v.iloc[there[a : a + 4096]].to_numpy())
            out[there[a : a + 4096]] = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        return pd.Series(out)

    return nearest(_direction(vector, metric))


def nearest_centres(centres: list[list[float]], query: list[float], metric: str, probes: int) -> list[int]:
    c, q = np.array(centres), np.asarray(query, dtype=np.float64)
    d = ((c - q) ** 2).sum(1) if metric == "l2" else -(c @ q)
    return [int(i) for i in np.argsort(d, kind="stable")[:probes]]


def choose_route(passing: int, total: int, rows: int = 50_000, share: float = 0.05) -> str:
    """Exact scan where few rows pass the filter, else the probed lists."""
    return "scan" if passing <= rows or passing <= share * total else "ivf"
