"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the documents' n-grams, summed per document.

Documents are grouped in blocks of bounded size. A block asks for each of its distinct n-grams once, with its own count
(a partial aggregation); the n-gram's hash partition adds the counts up and answers every block; the block joins the
answers to its documents' n-grams. Counts cover all documents, less those of the document that is scored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_of

WORDS = re.compile(r"[^\W_]+")
ORDER = 3
ALPHA = 0.4
BLOCK_CHARS = 12_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEP = np.uint64(0x9E3779B97F4A7C15)
Sorted = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _grams(texts: pd.Series, order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(document of each word, place of each word in it, for each k up to order: hash of the k words that end there, valid)."""
    lists = [WORDS.findall(t.lower()) for t in texts]
    n = np.array([len(x) for x in lists], dtype=np.int64)
    codes, names = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
    w = hashes[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(w)) - np.repeat(n.cumsum() - n, n)
    out = []
    g = w
    for k in range(1, order + 1):
        if k > 1:
            last = np.concatenate([g[:1], g[:-1]])
            with np.errstate(over="ignore"):
                g = ((last ^ (last >> np.uint64(29))) * _MIX + w) * _STEP
        with np.errstate(over="ignore"):
            spread = (g ^ (g >> np.uint64(32))) * _MIX
        out.append((spread, place >= k - 1))
    return doc, place, out


def _by_gram(g: np.ndarray, doc: np.ndarray) -> Sorted:
    """(order by n-gram, whether an n-gram begins there, index of the n-gram, count in the same document)."""
    order = np.argsort(g, kind="stable")  # documents stay in order within an n-gram
    s, d = g[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    run = new.copy()
    run[1:] |= d[1:] != d[:-1]
    starts = np.flatnonzero(run)
    lengths = np.diff(np.append(starts, len(s)))
    return order, new, new.cumsum() - 1, np.repeat(lengths, lengths)


def _packed(x: np.ndarray) -> bytes:
    """64-bit integers by place of the byte, deflated: the high bytes of small ones take next to nothing."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def lm_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of docs: doc_id, n_words, log_score (sum of natural logs), mean_log and backed_off (share of words).

    A word's score is f(n-gram) / f(context) at the highest order the rest of the corpus has, times alpha for each
    order below the highest possible; a word that no other document has counts as seen once, one order further down.
    Null and empty texts: no words, log_score 0, mean_log and backed_off null. Repeated rows are documents of their
    own, so that a copy makes a text likely. An empty table gives an empty result. Counts are 64-bit; n-grams are
    told apart by 64-bit hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    chars = texts.agg(F.sum(F.char_length("text") + 20)).first()[0] or 0
    blocks = buckets = int(max(1, -(-chars // block_chars)))
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, _, grams = _grams(pdf["text"], order)
        out = []
        for k, (g, valid) in enumerate(grams):
            g = np.sort(g[valid])
            new = np.ones(len(g), dtype=bool)
            new[1:] = g[1:] != g[:-1]
            starts = np.flatnonzero(new)
            counts, g = np.diff(np.append(starts, len(g))), g[starts]
            of = ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with g
            ends = np.searchsorted(of, np.arange(buckets + 1))
            for b in range(buckets):
                a, z = ends[b], ends[b + 1]
                if z > a:
                    out.append((b, int(pdf["block"].iloc[0]), k, _packed(np.diff(g[a:z], prepend=np.uint64(0)).view(np.int64)), _packed(counts[a:z])))
        return pd.DataFrame(out, columns=["bucket", "block", "k", "grams", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [_unpacked(x).view(np.uint64).cumsum(dtype=np.uint64) for x in pdf["grams"]]
        g = np.concatenate(grams)
        c = np.concatenate([_unpacked(x) for x in pdf["counts"]])
        at = np.argsort(g, kind="stable")
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[at][1:] != g[at][:-1]
        sums = np.add.reduceat(c[at], np.flatnonzero(new))
        total = np.empty(len(g), dtype=np.int64)
        total[at] = sums[new.cumsum() - 1]
        parts = np.split(total, np.cumsum([len(x) for x in grams])[:-1])
        return pd.DataFrame({"block": pdf["block"], "k": pdf["k"], "bucket": pdf["bucket"], "totals": [_packed(p) for p in parts]})

    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc, place, grams = _grams(pdf["text"], order)
        answers = answers.sort_values(["k", "bucket"])
        rest = []  # for each k, at each word: how often other documents have the k words that end there
        for k, (g, valid) in enumerate(grams):
            where = np.flatnonzero(valid)
            at, _, index, own = _by_gram(g[where], doc[where])
            total = np.concatenate([np.zeros(0, dtype=np.int64), *map(_unpacked, answers["totals"][answers["k"] == k])])
            count = np.zeros(len(g), dtype=np.int64)
            count[where[at]] = total[index] - own
            rest.append(count)
        log, low, done = np.zeros(len(doc)), np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
        possible = np.minimum(place + 1, order)
        for k in range(order, 0, -1):
            hit = ~done & (possible >= k) & (rest[k - 1] > 0)
            context = np.concatenate([[1], rest[k - 2][:-1]])[hit] if k > 1 else 1
            log[hit] = np.log(rest[k - 1][hit] / context) + (possible[hit] - k) * np.log(alpha)
            low[hit] = k == 1
            done |= hit
        log[~done] = possible[~done] * np.log(alpha)
        low |= ~done
        many = len(pdf)
        add = lambda x: np.bincount(doc, x, many)
        backed = add(low & (place > 0)).astype(np.int64)
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": np.bincount(doc, minlength=many), "log": add(log), "low": add(low).astype(np.int64), "off": backed})

    asked = blocked.groupBy("block").applyInPandas(ask, "bucket int, block int, k int, grams binary, counts binary")
    answered = asked.groupBy("bucket", "k").applyInPandas(answer, "block int, k int, bucket int, totals binary")
    by_block = blocked.groupBy("block").cogroup(answered.groupBy("block"))
    scored = cut(by_block.applyInPandas(score, "doc_id long, n long, log double, low long, off long"))
    words = scored.agg(F.sum("n")).first()[0] or 0
    # scores that end at single words are relative to how many words the other documents have
    log_score = F.col("log") - F.col("low") * F.log(F.greatest(F.lit(1.0), F.lit(float(words)) - F.col("n")))
    some = F.col("n") > 0
    return scored.select("doc_id", F.col("n").alias("n_words"), log_score.alias("log_score"),
        F.when(some, log_score / F.col("n")).alias("mean_log"), F.when(some, F.col("off") / F.col("n")).alias("backed_off"))


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
