"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits, one feature after the other, shallow trees on the feature's bins; their sums are one lookup table
a feature. Then pairs of features with the most gain left get two-dimensional tables the same way. A score is a sum of
table entries, looked up for whole batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, slices, table, text_of

FEATURES = [
    "log_words", "word_chars", "upper", "digit", "space", "symbol", "comma_stop", "pipe", "not_ascii", "distinct_words", "top_word",
    "distinct_lines", "line_words", "long_words", "short_words", "capitalised", "stop_ended", "mixed_words", "repeat_next", "distinct_pairs",
]
SAMPLE = 12_000

_CLASS = np.zeros(256, dtype=np.uint8)  # of a UTF-8 byte: 1 upper, 2 digit, 3 space, 4 symbol, 5 comma or stop, 6 pipe, 7 not ASCII
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_CLASS[[ord(c) for c in ",.;:'"]] = 5
_CLASS[ord("|")] = 6
_CLASS[128:] = 7


def features(text: str) -> list[float]:
    """One number for each of FEATURES, of the whole text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    of = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)], minlength=8) / len(text)
    words = text.split()
    n = len(words)
    if not n:
        return [0.0, 0.0, *of[1:8], *[0.0] * (len(FEATURES) - 9)]
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), lengths.mean(), *of[1:8], len(seen) / n**0.8, seen.most_common(1)[0][1] / n,
        len(set(lines)) / len(lines), n / len(lines), (lengths > 15).mean(), (lengths < 3).mean(),
        sum(map(str.istitle, seen)) / len(seen), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        sum(map(str.isalpha, seen)) / len(seen), sum(map(str.__eq__, words, words[1:])) / n, pairs / max(1, n - 1),
    ]


@dataclass
class Additive:
    """bias + tables[f][bin of f] + pair tables[(f, g)][coarse bin of f, coarse bin of g], through a logistic."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = _bins(x, self.edges)
        total = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            total += t[bins[:, f]]
        rough = _bins(x, self.coarse)
        for (f, g), t in self.pairs.items():
            total += t[rough[:, f], rough[:, g]]
        return _logistic(total)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), int)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """A regression tree of `leaves` leaves on ordered bins, as one Newton step for each bin."""
    cuts = [0, len(grad)]
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        options = [(gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(cuts, cuts[1:]) for m in range(a + 1, b)]
        if not options or (best := max(options))[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 20, n_pairs: int = 6, rate: float = 0.2, bins: int = 24, coarse: int = 6) -> Additive:
    """Trained on the driver, from a bounded sample. With one class only, a constant."""
    d = x.shape[1] if len(x) else len(FEATURES)
    none = [np.zeros(0)] * d
    mean = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Additive(none, none, float(np.log(mean / (1 - mean))), [np.zeros(1)] * d, {})
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.arange(1, n) / n)) for f in range(d)]
    edges, rough = quantiles(bins), quantiles(coarse)
    b, c = _bins(x, edges), _bins(x, rough)
    sizes, rsizes = [len(e) + 1 for e in edges], [len(e) + 1 for e in rough]
    bias = float(np.log(mean / (1 - mean)))
    total = np.full(len(y), bias)
    tables = [np.zeros(n) for n in sizes]
    for _ in range(rounds):
        for f in range(d):
            p = _logistic(total)
            step = rate * _tree(np.bincount(b[:, f], y - p, sizes[f]), np.bincount(b[:, f], p * (1 - p), sizes[f]))
            tables[f] += step
            total += step[b[:, f]]
    p = _logistic(total)

    def cells(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = c[:, f] * rsizes[g] + c[:, g], rsizes[f] * rsizes[g]
        return np.bincount(at, y - p, n), np.bincount(at, p * (1 - p), n)

    gains = {}
    for f in range(d):
        for g in range(f + 1, d):
            gr, he = cells(f, g)
            gains[f, g] = float((gr**2 / (he + 5)).sum())
    pairs = {k: np.zeros((rsizes[k[0]], rsizes[k[1]])) for k in sorted(gains, key=gains.get, reverse=True)[:n_pairs]}
    for _ in range(pair_rounds):
        for (f, g), t in pairs.items():
            p = _logistic(total)
            gr, he = cells(f, g)
            step = (rate * gr / (he + 5)).reshape(t.shape)
            t += step
            total += step[c[:, f], c[:, g]]
    return Additive(edges, rough, bias, tables, pairs)


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample, computed on the executors."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames):
            yield pd.DataFrame({"x": [features(t) for t in pdf["text"]], "label": pdf["label"]})

    rows = sample.mapInPandas(compute, "x array<double>, label int").toPandas()
    return np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES)), rows["label"].to_numpy(dtype=float)


def train(docs: DataFrame, labels: DataFrame, modulus: int | None = 3, held: int = 1, most: int = SAMPLE) -> Additive:
    """Fits on at most `most` labelled rows, none of the held-out fold (crc32 of doc_id modulo modulus equal to held)."""
    usable = F.lit(True) if modulus is None else fold(modulus) != held
    x, y = sample_features(labelled_sample(docs, labels, "quality", usable, most))
    order = np.lexsort((*x.T, y))  # the same model, however the rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """docs with score (0 to 1): every whole text, one at a time, empty and null ones too; equal texts score alike, rows
    that repeat stay. A column score of the input is replaced, other ones are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # lookup tables: of fixed size
    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name != "score"]
    kept = docs.select(*[f.name for f in fields]).withColumns({"_quality_null": F.col("text").isNull(), "text": text_of()})
    names = [f.name for f in fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], dtype=float).reshape(batch.num_rows, len(FEATURES))
            was_null = batch.column("_quality_null")
            columns = [pc.if_else(was_null, pa.scalar(None, batch.column(n).type), batch.column(n)) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sent.value.score(x), pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(run, StructType([*fields, StructField("score", DoubleType())]))


def op9_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels come only from rows outside the held-out fold; a document with an empty or null text has a score too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
