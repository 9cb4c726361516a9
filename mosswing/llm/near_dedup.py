"""Near-duplicates by order MinHash: each sketch keeps a few minimal occurrence-labelled word k-mers in text order.

Sketches that agree make candidates; a banded alignment of the words verifies them; classes are the connected
components of the verified links. Neighbours in a bucket of equal sketches give first classes; then all pairs of a
bucket that are still in different classes are verified. Rows of crowded buckets (a passage that many texts share) meet
by their rarest word pairs instead, of which texts alike must share some: the work follows the rows, not their square.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .alignment import band_distance
from .common import cut, stored, table, text_of

WORDS = re.compile(r"[^\W_]+")
K = 5
SKETCHES = 32
SIMILAR = 0.8
PIVOTS = 4
BLOCK_ROWS = 2000
BINS = 128
CROWDED = 1000
SHARED = 3
ONE_TASK = 2_000_000

_SEEDS = np.random.default_rng(11).integers(1, 2**63, size=SKETCHES, dtype=np.uint64)[:, None] | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_list(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def sketch(words: list[str], k: int = K) -> np.ndarray:
    """SKETCHES hashes, each of the two least occurrence-labelled k-mers in the order of the text."""
    with np.errstate(over="ignore"):
        w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        n = max(1, len(w) - k + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for i in range(min(k, len(w))):
            grams = (grams ^ (grams >> np.uint64(31))) * _MIX + w[i : i + n]
        order = np.argsort(grams, kind="stable")
        s = grams[order]
        new = np.ones(n, dtype=bool)
        new[1:] = s[1:] != s[:-1]
        starts = np.flatnonzero(new)
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        labelled = grams + occurrence * _STEP
        out = np.empty(SKETCHES, dtype=np.uint64)
        for a in range(0, SKETCHES, rows := max(1, min(SKETCHES, 400_000 // n))):
            h = labelled[None, :] * _SEEDS[a : a + rows]
            h ^= h >> np.uint64(32)
            h *= _MIX
            each = np.arange(len(h))
            one = h.argmin(1)
            h[each, one] = np.uint64(2**64 - 1)
            two = h.argmin(1)
            first, last = np.minimum(one, two), np.maximum(one, two)
            x = (labelled[first] ^ (labelled[first] >> np.uint64(29))) * _MIX + labelled[last]
            out[a : a + rows] = (x ^ (x >> np.uint64(32))) * _STEP
        return out


def _sketched(docs: DataFrame) -> DataFrame:
    """row (unique), doc_id, v (hash of the text), key (of the words in order; of the text where there are none),
    s (the sketches; null without words), n (words), w (32 bits of each word).
    """
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("v"), text_of().alias("text")).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, sketches, n, w = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                words = word_list(text)
                same = "w" + " ".join(words) if words else "t" + text
                keys.append(hashlib.blake2b(same.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                sketches.append(sketch(words).view(np.int64) if words else None)
                n.append(len(words))
                w.append(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("v"), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(n, pa.int32()), pa.array(w, pa.binary())],
                names=["row", "doc_id", "v", "key", "s", "n", "w"])

    return columns.mapInArrow(run, "row long, doc_id long, v long, key binary, s array<long>, n int, w binary")


def _candidates(reps: DataFrame) -> DataFrame:
    """a < b, agree: neighbours, and rows beside the first, among representatives that share a sketch; in how many they are.

    A bucket is sorted by the sketches that follow, so those that share most are neighbours in one of its rotations.
    Rows are ranged over tasks by the whole sort key: a bucket of any size is split, and the ends are linked after.
    """
    following = [F.get("s", F.pmod(F.col("j") + i, F.lit(SKETCHES)).cast("int")) for i in (1, 2)]
    rows = reps.select("rep", "s", F.posexplode("s").alias("j", "h")).select("j", "h", following[0].alias("h1"), following[1].alias("h2"), "rep")
    rows = rows.repartitionByRange("h", "j", "h1", "h2", "rep").sortWithinPartitions("h", "j", "h1", "h2", "rep")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, ends = None, None, []
        for pdf in frames:
            if not len(pdf):
                continue
            h, j, r = (pdf[c].to_numpy(dtype=np.int64) for c in ("h", "j", "rep"))
            if last is None:
                ends.append((h[0], j[0], r[0]))
                last = (~h[0], j[0], r[0])
            ph, pj, pr = (np.concatenate([[x], y[:-1]]) for x, y in zip(last, (h, j, r)))
            same = (ph == h) & (pj == j)
            head = np.maximum.accumulate(np.where(same, -1, np.arange(len(h))))
            heads = np.where(head >= 0, r[np.maximum(head, 0)], begun if begun is not None else -1)
            a, b = np.concatenate([pr[same], heads[same]]), np.concatenate([r[same], r[same]])
            yield pd.DataFrame({"h": 0, "j": -1, "a": np.minimum(a, b), "b": np.maximum(a, b)})
            last, begun = (h[-1], j[-1], r[-1]), heads[-1]
        if last is not None:
            ends.append(last)
            yield pd.DataFrame([(x, y, z, begun) for x, y, z in ends], columns=["h", "j", "a", "b"])

    linked = cut(rows.mapInPandas(link, "h long, j int, a long, b long"))
    ends = linked.where("j >= 0").groupBy("h", "j").agg(F.array_sort(F.collect_set("a")).alias("r")).where(F.size("r") > 1)  # two rows a task
    across = ends.select(F.explode(F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r") - 1).alias("b"))).alias("x"))
    return linked.where("j < 0").select("a", "b").union(across.select("x.a", "x.b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("agree"))


def _few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a checkpointed table of one or two numbers a row, broadcast if it is counted and small."""
    return F.broadcast(df) if df.count() <= most else df


def _verified(pairs: DataFrame, words: DataFrame, similar: float) -> DataFrame:
    """a, b, edits of the pairs whose words align with a similarity of at least `similar`."""
    joined = pairs.join(words.select(F.col("rep").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("rep").alias("b"), F.col("w").alias("wb")), "b")
    n = F.greatest(F.length("wa"), F.length("wb"))
    joined = joined.where(F.least(F.length("wa"), F.length("wb")) >= similar * n)

    def align(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for a, b, wa, wb in zip(pdf["a"], pdf["b"], pdf["wa"], pdf["wb"]):
                x, y = np.frombuffer(wa, dtype=np.uint32), np.frombuffer(wb, dtype=np.uint32)
                most = int((1 - similar) * max(len(x), len(y)) + 1e-9)
                surplus = np.bincount(x & 1023, minlength=1024) - np.bincount(y & 1023, minlength=1024)
                if max(surplus.clip(0).sum(), (-surplus).clip(0).sum()) > most:  # each edit takes one word from either at most
                    continue
                edits = band_distance(x.tolist(), y.tolist(), most)
                if edits is not None:
                    out.append((a, b, edits))
            yield pd.DataFrame(out, columns=["a", "b", "edits"])

    return joined.select("a", "b", "wa", "wb").mapInPandas(align, "a long, b long, edits int")


def _histograms(words: DataFrame) -> DataFrame:
    """rep, h: how many words fall in each of BINS classes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            h = [np.minimum(np.bincount(np.frombuffer(w, dtype=np.uint32) % BINS, minlength=BINS), 30_000).astype(np.int16).tobytes() for w in pdf["w"]]
            yield pd.DataFrame({"rep": pdf["rep"], "h": h})

    return words.mapInPandas(run, "rep long, h binary")


def _contested(reps: DataFrame, roots: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(bucket, cell, home, rep, n: rows of buckets that hold several classes, by the logarithm of their length; rep of crowded ones).

    Two texts alike are in the same or neighbouring cells; a row visits the next cell, where it meets those at home. A
    text so short that one like it may share no word pair stays in its crowded buckets too.
    """
    classed = reps.join(roots, reps.rep == roots.node, "left").select("rep", "s", "n", F.coalesce("root", "rep").alias("class"))
    rows = classed.select(F.explode(F.transform("s", lambda h, j: F.xxhash64(h, j))).alias("bucket"), "rep", "n", "class")
    several = rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low <> high").select("bucket", "rows")
    rows = cut(rows.join(several, "bucket").select("bucket", "rep", "n", "rows"))
    crowded = cut(rows.where(F.col("rows") > CROWDED).select("rep").distinct())
    cell = F.floor(F.log(F.col("n")) / -np.log(similar) + 1e-9)
    both = F.explode(F.array(F.struct(cell.alias("cell"), F.lit(True).alias("home")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("home"))))
    few = rows.where((F.col("rows") <= CROWDED) | (_least_shared(F.col("n"), similar) < 1))
    return few.withColumn("c", both).select("bucket", "c.cell", "c.home", "rep", "n"), crowded


def _least_shared(n, similar: float):
    """How many word pairs, at least, a text of n words shares with any like it that is not shorter; n: numbers or a column.

    Of m - 1 pairs of neighbouring words each of the (1 - similar) * m edits changes two at most; m >= n.
    """
    return (2 * similar - 1) * n - 1 + 0.999


def word_pairs(w: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words, told apart by their occurrence."""
    with np.errstate(over="ignore"):
        w = w.astype(np.uint64)
        g = (w[:-1] * _MIX ^ (w[:-1] >> np.uint64(7))) * _STEP + w[1:]
        g = (g ^ (g >> np.uint64(31))) * _MIX
        order = np.argsort(g, kind="stable")
        s = g[order]
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        occurrence = np.empty(len(g), dtype=np.uint64)
        occurrence[order] = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        g = g + occurrence * _STEP
        return ((g ^ (g >> np.uint64(29))) * _MIX).view(np.int64)


def _frequent(words: DataFrame, rows: int, sample: int = 20_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """(word pairs in order, how often they occur) of the most frequent ones in a sample: they only order pairs."""
    every = max(1, rows // sample)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"g": np.concatenate([np.zeros(0, np.int64), *(word_pairs(np.frombuffer(w, dtype=np.uint32)) for w in pdf["w"])])})

    some = words.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(every)) == 0).select("w").mapInPandas(run, "g long")
    counts = cut(some.groupBy("g").agg(F.count("*").cast("int").alias("times")).where("times > 2"))
    least, found = 2**31, 0
    for times, pairs in sorted(map(tuple, counts.groupBy(F.least("times", F.lit(1000)).alias("t")).count().collect()), reverse=True):
        found += pairs
        if found > most:
            break
        least = times
    found = counts.where(F.col("times") >= F.lit(least)).toArrow()
    g, times = found["g"].to_numpy(), found["times"].to_numpy()
    order = np.argsort(g)
    return g[order], times[order]


def _sharing(crowded: DataFrame, roots: DataFrame, words: DataFrame, similar: float) -> DataFrame:
    """a, b, shared: pairs of crowded rows in different classes that share the word pairs that texts alike must share.

    Word pairs have one order for all texts, rare ones first. If texts share t of N, then the first k they share are
    among the first N - t + k of each, so only those are joined; k is t in a short text, and grows with N as
    unlike texts share more by chance.
    """
    rows = crowded.count()
    if not rows:
        return crowded.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(0).cast("long").alias("shared"))
    mine = cut(words.join(F.broadcast(crowded) if rows <= 1_000_000 else crowded, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "w", F.coalesce("root", "rep").alias("class")))
    often, times = _frequent(mine, rows)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for rep, cls, w in zip(pdf["rep"], pdf["class"], pdf["w"]):
                g = word_pairs(np.frombuffer(w, dtype=np.uint32))
                least = max(0, int(_least_shared(len(g) + 1, similar)))
                need = max(1, min(SHARED + len(g) // 16, least))
                if len(often):
                    at = np.minimum(np.searchsorted(often, g), len(often) - 1)
                    g = g[np.lexsort((g, np.where(often[at] == g, times[at], 0)))]
                else:
                    g = np.sort(g)
                g = g[: max(0, len(g) - least + need)]
                out.append((g, np.full(len(g), rep), np.full(len(g), cls), np.full(len(g), len(w) // 4), np.full(len(g), need)))
            if out:
                yield pd.DataFrame(dict(zip(("g", "rep", "class", "n", "need"), map(np.concatenate, zip(*out)))))

    same = Window.partitionBy("g", "class")
    parted = mine.mapInPandas(first, "g long, rep long, class long, n int, need int").repartition("g").withColumn("same", F.count("*").over(same))
    whole = Window.partitionBy("g")
    top = F.max(F.struct("same", "class")).over(whole)
    met = parted.withColumns({"top": top, "size": F.count("*").over(whole)}).where("size > top.same")
    met = cut(met.select("g", "rep", "class", "n", "need", F.col("top.class").alias("top"), F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("parts")))
    # of two classes one at least is not the largest there; a large group's rows are spread over tasks
    x = met.where("class <> top").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    y = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "part", *[F.col(c).alias(f"{c}_y") for c in ("rep", "class", "n", "need", "top")])
    once = (F.col("class") != F.col("class_y")) & ((F.col("class_y") == F.col("top_y")) | (F.col("rep") < F.col("rep_y")))
    alike = F.least("n", "n_y") >= similar * F.greatest("n", "n_y") - 1e-9
    pairs = x.drop("parts", "top").join(y, ["g", "part"]).where(once & alike).select(F.least("rep", "rep_y").alias("a"), F.greatest("rep", "rep_y").alias("b"), F.least("need", "need_y").alias("need"))
    return cut(pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b", "shared"))


def _likeliest(near: DataFrame, roots: DataFrame, width: int) -> DataFrame:
    """a, b: of every two classes the `width` pairs that share most; a row (-1, -1) where some are left out."""
    for x in ("a", "b"):
        near = near.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r")), x, "left").withColumn(f"{x}r", F.coalesce(f"{x}r", x))
    order = Window.partitionBy(F.least("ar", "br"), F.greatest("ar", "br")).orderBy(F.desc("shared"), "a", "b")
    ranked = near.where("ar <> br").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= width + 1)
    return ranked.select(*[F.when(F.col("nth") <= width, F.col(x)).otherwise(-1).alias(x) for x in ("a", "b")])


def _runs(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames sorted by the columns `by`."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf])
        if not len(pdf):
            continue
        x = pdf[by].to_numpy()
        starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)])
        for a, z in zip(starts[:-1], starts[1:]):
            yield pdf.iloc[a:z]
        rest = pdf.iloc[starts[-1] :]
    if rest is not None and len(rest):
        yield rest


def _unlike(pdf: pd.DataFrame, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, least edits) of the pairs of a block in different classes that lengths and word counts do not rule out."""
    n, cls, home, side = (pdf[c].to_numpy() for c in ("n", "class", "home", "part"))
    h = np.frombuffer(b"".join(pdf["h"]), dtype=np.int16).reshape(len(pdf), BINS)
    diagonal = pdf["p"].iloc[0] == pdf["q"].iloc[0]
    ends = np.searchsorted(n, np.floor(n / similar + 1e-9), side="right")  # sorted by n
    out = []
    for i in range(len(n) - 1):
        j = slice(i + 1, ends[i])
        ok = (cls[j] != cls[i]) & (home[j] | home[i])
        if not diagonal:
            ok &= side[j] != side[i]
        js = np.flatnonzero(ok) + i + 1
        if not len(js):
            continue
        more = np.maximum(h[js] - h[i], 0).sum(1)
        least = np.maximum(more, more - (n[js] - n[i]))
        good = least <= (1 - similar) * n[js] + 1e-9
        if good.any():
            out.append((np.full(good.sum(), i), js[good], least[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 3


def _meeting(rows: DataFrame, roots: DataFrame, shapes: DataFrame, similar: float, width: int) -> DataFrame:
    """a, b of the pairs in a common bucket and different classes that may be alike; a row (-1, -1) where some are left out.

    Of one pair of classes a block gives its `width` likeliest pairs. A block is a pair of parts of a cell, so that a
    hot bucket is spread over tasks whose rows are bounded.
    """
    classed = rows.join(roots, rows.rep == roots.node, "left").withColumn("class", F.coalesce("root", "rep")).drop("node", "root")
    sizes = classed.groupBy("bucket", "cell").agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.min("class").alias("low"), F.max("class").alias("high"))
    sizes = sizes.where("low <> high and homes > 0").select("bucket", "cell", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("parts"))
    placed = classed.join(sizes, ["bucket", "cell"]).join(shapes, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = ["bucket", "cell", "p", "q"]
    spread = spread.select("bucket", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "n", "rep", "class", "home", "part", "h")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _runs(frames, by):
            i, j, least = _unlike(pdf, similar)
            if not len(i):
                continue
            rep, cls = pdf["rep"].to_numpy(), pdf["class"].to_numpy()
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            if len(i) > width:
                x, y = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
                order = np.lexsort((b, a, least, y, x))
                x, y, a, b = x[order], y[order], a[order], b[order]
                new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                nth = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
                if (nth >= width).any():
                    a, b = np.r_[a[nth < width], -1], np.r_[b[nth < width], -1]
            yield pd.DataFrame({"a": a, "b": b})

    return spread.repartition(*by).sortWithinPartitions(*by, "n", "rep").mapInPandas(meet, "a long, b long")


def _exact(reps: DataFrame, links: DataFrame, words: DataFrame, similar: float) -> DataFrame:
    """node, root of the components once no pair that shares a bucket and is in two classes may be alike and is unverified.

    Each round verifies the likeliest pairs of every two classes that meet, then merges classes; the last one leaves
    none out.
    """
    roots = components(links)
    rows, crowded = _contested(reps, roots, similar)
    near = _sharing(crowded, roots, words, similar)
    shapes = cut(_histograms(words.join(_few(cut(rows.select("rep").distinct())), "rep")))
    width = PIVOTS
    while True:
        found = cut(_meeting(rows, roots, shapes, similar, width).union(_likeliest(near, roots, 16 * width)).distinct())
        pairs = found.where("a >= 0")
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())  # few of all: spares shuffles of words
        linked = cut(_verified(pairs, words.join(_few(wanted), "rep"), similar).select("a", "b"))
        if not linked.isEmpty():
            roots = _merged(roots, linked)
        if found.where("a < 0").isEmpty():
            return roots
        width *= 8


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots with the classes that further links join; nodes that had no link yet come in."""
    for x in ("a", "b"):
        of = roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r"))
        links = links.join(of, x, "left").withColumn(f"{x}r", F.coalesce(f"{x}r", x))
    links = cut(links)
    tops = components(links.select(F.col("ar").alias("a"), F.col("br").alias("b"))).withColumnRenamed("root", "top")
    known = roots.join(tops.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti")
    return cut(known.union(nodes.join(tops, "node").select("node", "top")))


def _components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = [pdf.to_numpy(dtype=np.int64) for pdf in frames if len(pdf)]
    if links:
        nodes, at = np.unique(np.concatenate(links), return_inverse=True)  # sorted: the least place is the least node
        a, b = at.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while (root[a] != root[b]).any():
            low = np.minimum(root[a], root[b])
            for x in (a, b):
                np.minimum.at(root, root[x], low)
            while (root != root[root]).any():
                root = root[root]
        yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component), by spreading least labels and halving paths; links: a, b.

    Up to ONE_TASK rows of two numbers are one task on an executor: rounds of shuffles would load the driver more.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    if both.count() <= ONE_TASK:
        return cut(both.where("a <= b").coalesce(1).mapInPandas(_components, "node long, root long"))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    while True:
        labels = cut(labels)
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.least("root", "near").alias("up"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("up"), F.col("root").alias("top"))
        new = cut(nearer.join(jump, "up").select("node", F.least("up", "top").alias("root"), "was"))
        if new.where("root <> was").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _classes(docs: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """(rows: row, doc_id, v, key; classes: key, copies, class_id, first (the row that its class keeps))."""
    slim = stored(_sketched(docs), "sketches")
    # the least document stands for a key: one with an id before one without
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "v", "row")
    reps = cut(slim.groupBy("key").agg(F.min(order).alias("one"), F.min("s").alias("s"), F.min("n").alias("n"), F.count("*").alias("copies")).withColumn("rep", F.col("one.row")))
    usable = reps.where(F.col("s").isNotNull())
    pairs = cut(_candidates(usable))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    words = cut(slim.select(F.col("row").alias("rep"), "w").join(_few(wanted), "rep"))
    strongest = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
    best = pairs.withColumn("nth", strongest).where("nth = 1").select("a", "b")
    links = cut(_verified(best, words, similar).select("a", "b"))
    roots = _exact(usable.join(wanted, "rep"), links, words, similar)  # a row in no pair shares no bucket
    rooted = cut(reps.join(roots, reps.rep == roots.node, "left").select("key", "copies", "one", F.coalesce("root", "rep").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("one").alias("first"))
    classes = rooted.join(firsts, "root").select("key", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first"))
    return slim.select("row", "doc_id", "v", "key"), cut(classes)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), copies (rows with the same words), kept.

    Two documents are linked if their words are the same, or align with at most (1 - similar) of the longer one's
    words edited, and at least one of their sketches agrees or both are in crowded buckets; classes are the links' components. Texts without words,
    null ones too, are alike only if equal (null: empty). A class keeps exactly one row: that of its least doc_id (of
    rows that share an id, any one by text hash). Rows are told apart by themselves, not by their ids: repeated rows are
    copies, rows that share an id are judged by their own texts, and rows with a null doc_id are kept only where
    their class has no other; class_id is null where all its ids are. An empty table gives an empty result. Other
    columns of the input are ignored.
    """
    rows, classes = _classes(docs, similar)
    return rows.join(classes, "key").select("doc_id", "class_id", "copies", (F.col("row") == F.col("first")).alias("kept"))


def without_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs, with all its columns, less all rows but one of each class (see near_duplicates)."""
    rows, classes = _classes(docs, similar)
    kept = rows.join(classes.select(F.col("first").alias("row")), "row").select(F.coalesce("doc_id", F.lit(0)).alias("_near_id"), F.col("doc_id").isNull().alias("_near_none"), F.col("v").alias("_near_v"))
    key = {"_near_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_near_none": F.col("doc_id").isNull(), "_near_v": F.xxhash64(text_of())}
    # rows that repeat whole are one before they meet the kept ones
    once = docs.withColumns(key).dropDuplicates(list(key))
    return once.join(kept.distinct(), list(key), "left_semi").select(*docs.columns)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
