"""Benchmark decontamination by q-gram lemma filtering.

Shared character q-grams are counted in overlapping diagonal bands; bands that meet the edit-budget bound are regions,
verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Q = 8
BUDGET = 0.1
BLOCK_CHARS = 4_000_000
_BASE = 0x9E3779B97F4A7C15
_BITS = 22

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_FOLD[65:91] += 32
_GROWS = "\u0130"  # the one character whose lower case has two


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased text, runs of ASCII signs and white space as one space; and each one's place in text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(points < 128, _FOLD[np.minimum(points, 127)], points)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    places = np.flatnonzero(keep)
    if _GROWS in text:
        places = np.repeat(np.arange(len(text)), [1 + (c == _GROWS) for c in text])[places]
    return points[keep], places


def _chars(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q consecutive code points."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(_BASE)
        powers = {1: points.astype(np.uint64) + np.uint64(1)}
        factor, size = base, 1
        factors = {1: base}
        while size * 2 <= q:
            h = powers[size]
            powers[size * 2] = h[:-size] * factors[size] + h[size:] if len(h) > size else h[:0]
            factors[size * 2] = factors[size] * factors[size]
            size *= 2
        total, at = None, 0
        for s in sorted(powers, reverse=True):
            if q & s:
                part = powers[s][at : at + n]
                total = part if total is None else total * factors[s] + part
                at += s
        total = total ^ (total >> np.uint64(29))
        return total * np.uint64(0xBF58476D1CE4E5B9)


def best_place(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the substring b[start:end] that the fewest edits make of a, if they are at most `most`.

    Two bit-parallel passes over the region: forwards with a free start for the end, then backwards from it for the start.
    """
    edits, end = _scan(a.tolist(), b.tolist(), True)
    if edits > most:
        return None
    back = b[:end][::-1].tolist()
    return edits, end - _scan(a[::-1].tolist(), back, False)[1], end


def _scan(a: list[int], b: list[int], free: bool) -> tuple[int, int]:
    """The least edits between a and a prefix of b (with a free start: a substring), and where it ends first."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    n = len(a)
    every, top, first = (1 << n) - 1, 1 << (n - 1), 0 if free else 1
    vp, vn, score = every, 0, n
    best, end = n, 0
    for j, y in enumerate(b):
        x = at.get(y, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        hp = hp << 1 | first
        vp = (hn << 1 | ~(d0 | hp)) & every
        vn = d0 & hp & every
    return best, end


@dataclass
class Index:
    """q-grams of a block of benchmark items: sorted hashes, with item and place of each; a bit map of the hashes."""

    ids: list
    points: list[np.ndarray]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    map: np.ndarray
    budgets: np.ndarray
    least: np.ndarray
    offsets: np.ndarray
    short: list[tuple[object, str]]

    @classmethod
    def build(cls, rows: list[tuple[object, str]], q: int, budget: float) -> Index:
        ids, points, h, it, pl, budgets, least, short = [], [], [], [], [], [], [], []
        for item, text in rows:
            p = normal(text)[0]
            p = p[(np.cumsum(p != 32) > 0) & (np.cumsum((p != 32)[::-1])[::-1] > 0)]  # without the outer spaces
            if len(p) < q:
                if len(p):
                    short.append((item, f" {_chars(p)} "))
                continue
            grams = gram_hashes(p, q)
            e = int(budget * len(p))
            e = min(e, (len(grams) - 1) // q)  # the lemma needs one gram left
            h.append(grams)
            it.append(np.full(len(grams), len(ids), dtype=np.int32))
            pl.append(np.arange(len(grams), dtype=np.int32))
            budgets.append(e)
            least.append(len(grams) - q * e)
            ids.append(item)
            points.append(p)
        hashes = np.concatenate(h) if h else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[hashes >> np.uint64(64 - _BITS)] = True
        cat = lambda x: np.concatenate(x)[order] if x else np.zeros(0, dtype=np.int32)
        return cls(ids, points, hashes[order], cat(it), cat(pl), bits, np.array(budgets, dtype=np.int64), np.array(least, dtype=np.int64), np.cumsum([0, *map(len, points)], dtype=np.int64), short)

    def regions(self, text: str, q: int) -> list[tuple[object, int, int, int]]:
        """(item, first character, character after the last, edits) of each verified region, the best of those that overlap."""
        points, places = normal(text)
        return self._exact(points, places) + self._similar(points, places, q)

    def _exact(self, points: np.ndarray, places: np.ndarray) -> list[tuple[object, int, int, int]]:
        """Items under q characters, as whole words."""
        if not self.short:
            return []
        out, within = [], f" {_chars(points)} "
        for item, wanted in self.short:
            at = within.find(wanted)
            while at >= 0:
                out.append((item, int(places[at]), int(places[at + len(wanted) - 3]) + 1, 0))
                at = within.find(wanted, at + 1)
        return out

    def _similar(self, points: np.ndarray, places: np.ndarray, q: int) -> list[tuple[object, int, int, int]]:
        grams = gram_hashes(points, q)
        at = np.flatnonzero(self.map[grams >> np.uint64(64 - _BITS)])
        if not len(at):
            return []
        g = grams[at]
        first = np.searchsorted(self.hashes, g, side="left")
        many = np.searchsorted(self.hashes, g, side="right") - first
        if not many.any():
            return []
        spots = np.repeat(at, many)
        entry = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(many.cumsum() - many, many)
        item = self.items[entry]
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least  # no band of an item has more than all of them
        some = enough[item]
        item, spots, place = item[some].astype(np.int64), spots[some], self.places[entry[some]].astype(np.int64)
        if not len(item):
            return []
        # bands of 2w diagonals that start at every multiple of w > budget: any budget's worth of drift is inside one
        w = self.budgets[item] + 1
        band = (spots - place) // w
        low = int(band.min()) - 1
        span = int(band.max()) - low + 1
        found = set()
        for shift in (0, 1):
            key = (self.offsets[item] + place) * span + (band - shift - low)
            one = np.unique(key)  # a place of the item counts once
            of = np.searchsorted(self.offsets, one // span, side="right") - 1
            bands, votes = np.unique(of * span + one % span, return_counts=True)
            good = bands[votes >= self.least[bands // span]]
            found |= set(zip((good // span).tolist(), (good % span + low).tolist()))
        out = []
        for i, b in sorted(found):
            p, e = self.points[i], int(self.budgets[i])
            start = max(0, b * (e + 1) - e)
            end = min(len(points), (b + 2) * (e + 1) + len(p) + e)
            hit = best_place(p, points[start:end], e)
            if hit:
                out.append((hit[0], i, int(places[start + hit[1]]), int(places[start + hit[2] - 1]) + 1))
        best: dict[int, list[tuple[int, int]]] = {}
        kept = []
        for edits, i, start, end in sorted(out):  # neighbouring bands find a place twice
            taken = best.setdefault(i, [])
            if not any(2 * (min(end, y) - max(start, x)) > min(end - start, y - x) for x, y in taken):
                taken.append((start, end))
                kept.append((self.ids[i], start, end, edits))
        return kept


def _indexes(benchmark: DataFrame, q: int, budget: float) -> Iterator[Index]:
    """Distinct benchmark items in hash classes of about half BLOCK_CHARS: each index is small enough for every task."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.char_length("text") + 8)).first()[0] or 0
    classes = max(1, -(-2 * chars // BLOCK_CHARS))
    for c in range(classes if chars else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(classes)) == c).collect()
        yield Index.build(sorted((r["item_id"], r["text"]) for r in rows), q, budget)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, start, end, edits: every place of a document that holds a benchmark item within its edit budget.

    start and end are characters of the original text, of the alignment itself. The budget is `budget` of an item's
    characters (fewer for short items, so that the q-gram lemma still holds); items under q characters are searched
    exactly, as whole words. Items are sent to the tasks in blocks of bounded size, one pass over the documents a
    block. Null and empty texts hold nothing; repeated rows and null ids are reported each, repeated items once; an
    empty table of either kind gives an empty result. Other columns of the input are ignored.
    """
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id long, item_id {id_type}, start long, end long, edits int"
    spark = docs.sparkSession
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(sent):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = sent.value
            for batch in batches:
                out = [(row, *hit) for row, text in enumerate(batch.column("text")) for hit in index.regions(text.as_py(), q)]
                if out:
                    rows, items, starts, ends, edits = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows)), pa.array(items), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(edits, pa.int32())],
                        names=["doc_id", "item_id", "start", "end", "edits"])

        return run

    found = None
    for index in _indexes(benchmark, q, budget):
        part = texts.mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET) -> DataFrame:
    """The rows of docs, with all their columns, whose own text holds no benchmark item.

    Each row is judged by itself in the scan, so null and repeated ids matter nothing; null and empty texts stay.
    """
    spark = docs.sparkSession

    def clean(sent):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            index = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not index.regions(x.as_py() or "", q) for x in batch.column("text")], pa.bool_()))

        return run

    for index in _indexes(benchmark, q, budget):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(index)), docs.schema)
    return docs


def op3_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
