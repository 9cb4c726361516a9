"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

A bounded sample of labelled rows is halved, and each half is judged by the other: the other's labels choose lexicon
words that vote, and give the share of toxic rows and a first guess of each voter's rates; of the rows that are judged
no label is looked at. There the label model estimates the voters' accuracies and correlations from how they vote
together, and its posteriors train a logistic regression over words, word beginnings and patterns.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, labelled_sample, slices, stored, table, text_of

SAMPLE = 12_000
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7, 8)

#: Voters that need no labels: lexicons by kind, and patterns of the whole lower-cased text.
LEXICONS = {
    "insult_person": "idiot moron loser clown scum imbecile cretin dimwit halfwit fool jerk lowlife scumbag",
    "insult_quality": "stupid dumb pathetic worthless disgusting useless vile repulsive brainless",
    "insult_thing": "trash garbage filth vermin crap",
    "insult_fr": "imbécile débile crétin abruti ordure connard salaud minable ridicule",
    "insult_de": "dummkopf idioten arschloch trottel abschaum widerlich erbärmlich",
    "insult_es": "imbécil estúpido basura asqueroso patético inútil gilipollas escoria",
    "threat": "kill die hurt destroy murder",
}
PATTERNS = {
    "you_are": re.compile(r"\byou(?:'re| are) (?:a |an |so |such )?(?:\w+ )?(?:idiot|moron|loser|clown|stupid|pathetic|worthless|trash|scum)"),
    "shut_up": re.compile(r"\bshut up\b|\bgo to hell\b|\bdrop dead\b"),
    "hate": re.compile(r"\bi hate (?:you|them|those|all)\b"),
}
MARK = "#"  # before the name of a pattern that is a feature; no word has it
GROUPS = {w: k for k, words in LEXICONS.items() for w in words.split()}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


@dataclass
class Model:
    """Words, word beginnings and patterns with weights; `seen` caches the weight of words, and is emptied when it is full."""

    weights: dict[str, float]
    bias: float
    voters: dict[str, tuple[float, float]] = field(default_factory=dict)
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def weight(self, word: str) -> float:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            get = self.weights.get
            got = get(word, 0.0) + sum(get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) >= k)
            self.seen[word] = got
        return got

    def score(self, text: str) -> float:
        low = text.lower()
        z = self.bias + sum(filter(None, map(self.weight, words_of(low))))
        z += sum(self.weights.get(MARK + k, 0.0) for k, p in PATTERNS.items() if p.search(low))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


def parts_of(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}


def least_rows(candidates: int, share: float, chance: float = 0.01) -> float:
    """How many marked rows a candidate needs, so that with probability 1 - chance none of them all gets there by luck."""
    return max(3.0, float(np.log(max(1, candidates) / chance) / -np.log(share)))


def mine_voters(documents: list[set[str]], y: np.ndarray, precision: float = 0.9, least: float = 3) -> list[str]:
    """Words and word beginnings that labelled rows nearly always mark, each covering marked rows the others miss.

    One is taken only if at least `least` marked rows have it (see least_rows), and if a tenth of them have fewer than
    three voters so far: how many are chosen is up to the rows.
    """
    all_, marked = Counter(), Counter()
    for parts, label in zip(documents, y):
        all_.update(parts)
        if label:
            marked.update(parts)
    good = {p for p, n in marked.items() if n >= least and n / all_[p] >= precision}
    rows: dict[str, set[int]] = {p: set() for p in good}
    for i, (parts, label) in enumerate(zip(documents, y)):
        if label:
            for p in parts & good:
                rows[p].add(i)
    chosen: list[str] = []
    times = Counter()
    for p in sorted(rows, key=lambda p: (-len(rows[p]), p.endswith("*"), -len(p), p)):
        alike = any(len(rows[p] & rows[c]) > 0.9 * len(rows[p] | rows[c]) for c in chosen)
        if not alike and sum(times[i] < 3 for i in rows[p]) >= 0.1 * len(rows[p]):
            chosen.append(p)
            times.update(rows[p])
    return chosen


def vote_matrix(texts: list[str], documents: list[set[str]], mined: list[str]) -> tuple[np.ndarray, list[str]]:
    """1 where a voter marks a row; lexicon groups, patterns, then each mined word or beginning."""
    names = [*LEXICONS, *PATTERNS, *mined]
    votes = np.zeros((len(texts), len(names)), dtype=np.int8)
    groups, column = list(LEXICONS), {m: len(LEXICONS) + len(PATTERNS) + k for k, m in enumerate(mined)}
    for i, (text, parts) in enumerate(zip(texts, documents)):
        for w in parts & GROUPS.keys():
            votes[i, groups.index(GROUPS[w])] = 1
        low = text.lower()
        for k, pattern in enumerate(PATTERNS.values()):
            votes[i, len(groups) + k] = pattern.search(low) is not None
        for p in parts & column.keys():
            votes[i, column[p]] = 1
    return votes, names


def label_model(votes: np.ndarray, prior: float, guess: np.ndarray, trust: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, accuracy of each voter, weight of each voter) from votes, by EM.

    A voter says toxic or abstains; its accuracy is how often a row that it votes for is toxic. No label of these rows
    is given: only the share of toxic rows, and a first guess of each accuracy from other rows, which counts as
    `trust` votes. Correlations of the voters, beyond what the posterior explains, are estimated as well; the voters'
    log odds are weighted by the inverse of that correlation matrix, so that voters that always vote together count as
    one. A voter that is right no more often than the share has no effect, and rows without votes stay at the share.
    """
    n, m = votes.shape
    v = votes.astype(float)
    logit = lambda p: np.log(p / (1 - p))
    prior = float(np.clip(prior, 0.005, 0.5))
    accuracy, weight, q = np.clip(guess, 1e-3, 1 - 1e-3), np.ones(m), np.full(n, prior)
    if not n or not m:
        return q, accuracy, weight
    for step in range(steps):
        z = logit(prior) + v @ (weight * (logit(accuracy) - logit(prior)))
        new = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-4, 1 - 1e-4)
        done = step > 0 and np.abs(new - q).max() < 1e-5
        q = new
        if done:
            break
        accuracy = np.clip((q @ v + trust * guess) / (v.sum(0) + trust), 1e-3, 1 - 1e-3)
        if step % 5 == 0:
            on, off = (q @ v) / q.sum(), ((1 - q) @ v) / (1 - q).sum()
            left = v - (np.outer(q, on) + np.outer(1 - q, off))
            cov = left.T @ left / n
            sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
            r = cov / np.outer(sd, sd)
            r = np.where(r > 3 / np.sqrt(n), np.clip(r, 0, 0.95), 0)
            np.fill_diagonal(r, 1.05)
            weight = np.clip(np.linalg.solve(r, np.ones(m)), 0.1, 1)
    return q, accuracy, weight


def accuracies(votes: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(how often labelled rows that a voter votes for are toxic, drawn to the share; votes that this rests on)."""
    v = votes.astype(float)
    return (y @ v + prior) / (v.sum(0) + 1), v.sum(0) + 1


def linear(documents: list[set[str]], targets: np.ndarray, names: list[str], rounds: int = 12, ridge: float = 0.3) -> tuple[dict[str, float], float]:
    """Logistic regression on soft targets over presence features: Newton steps by conjugate gradients; deterministic."""
    column = {p: k for k, p in enumerate(names)}
    pairs = [(i, column[p]) for i, parts in enumerate(documents) for p in sorted(parts & column.keys())]
    rows, cols = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    n, m = len(documents), len(names)
    at = lambda w: w[m] + np.bincount(rows, w[cols], n)
    back = lambda r: np.append(np.bincount(cols, r[rows], m), r.sum())
    decay = np.append(np.full(m, ridge), 1e-6)
    w = np.zeros(m + 1)
    w[m] = np.log((targets.mean() + 1e-4) / (1 - targets.mean() + 1e-4)) if n else -3.0
    for _ in range(rounds if n else 0):
        p = 1 / (1 + np.exp(-np.clip(at(w), -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-4)
        grad = back(targets - p) - decay * w
        scale = 1 / (back(curve) + decay)
        step, r = np.zeros(m + 1), grad.copy()
        z = scale * r
        d, rz = z.copy(), r @ z
        for _ in range(40):
            if rz < 1e-10:
                break
            hd = back(curve * at(d)) + decay * d
            a = rz / (d @ hd)
            step, r = step + a * d, r - a * hd
            z = scale * r
            new = r @ z
            d, rz = z + new / rz * d, new
        w = w + step * min(1.0, 8 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return {p: float(x) for p, x in zip(names, w) if abs(x) > 1e-6}, float(w[m])


def train(docs: DataFrame, labels: DataFrame, modulus: int | None = 5, held: int = 0, most: int = SAMPLE) -> Model:
    """Voters, label model and classifier from at most `most` labelled rows outside the held-out fold.

    That bound is the only one: what goes to the driver is counts and presence of parts of those rows that are frequent
    enough to tell anything. Repeated rows count each; without labels, the model is a constant below one half.
    """
    usable = F.lit(True) if modulus is None else fold(modulus) != held
    sample = labelled_sample(docs, labels, "toxic", usable, most).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(frames):  # each row's distinct words and the patterns it has, not its text
            texts = pdf["text"].str.lower()
            marks = [[k for k, p in PATTERNS.items() if p.search(t)] for t in texts]
            yield pd.DataFrame({"words": [" ".join(sorted(words_of(t))) for t in texts], "marks": marks, "label": pdf["label"], "half": pdf["half"]})

    rows = stored(sample.mapInPandas(words, "words string, marks array<string>, label int, half int").withColumn("row", F.monotonically_increasing_id()), "toxicity")

    def counts(part: DataFrame, weights: dict[int, float] | None) -> DataFrame:
        """part, n, marked: rows of each part, and of how many of them are marked by label, or by posterior."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                y = pdf["label"] if weights is None else pdf["row"].map(weights).fillna(0.0)
                for at in range(0, len(pdf), 500):
                    all_, marked = Counter(), Counter()
                    for text, label in zip(pdf["words"][at : at + 500], y[at : at + 500]):
                        parts = parts_of(set(text.split()))
                        all_.update(parts)
                        if label > 0.01:
                            for p in parts:
                                marked[p] += label
                    yield pd.DataFrame({"part": list(all_), "n": list(all_.values()), "marked": [float(marked[p]) for p in all_]})

        return cut(part.mapInPandas(run, "part string, n long, marked double").groupBy("part").agg(F.sum("n").alias("n"), F.sum("marked").alias("marked")))

    def restricted(part: DataFrame, known: set[str]) -> pd.DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                yield pd.DataFrame({"row": pdf["row"], "parts": [" ".join(sorted(parts_of(set(t.split())) & known)) for t in pdf["words"]], "marks": [" ".join(m) for m in pdf["marks"]], "label": pdf["label"]})

        got = part.mapInPandas(run, "row long, parts string, marks string, label int").toPandas()
        return got.sort_values(["parts", "marks", "label", "row"], kind="stable").reset_index(drop=True)

    known: dict[int, float] = {}
    voters: dict[str, tuple[float, float]] = {}
    for half in (0, 1):
        choose, judge = rows.where(F.col("half") != half), rows.where(F.col("half") == half)
        total = choose.agg(F.count("*").alias("n"), F.sum("label").alias("marked")).first()
        if not total["n"] or judge.isEmpty():
            continue
        prior = (total["marked"] + 1) / (total["n"] + 2)
        seen = counts(choose, None)
        least = least_rows(seen.count(), prior)
        good = seen.where((F.col("marked") >= least) & (F.col("marked") >= 0.9 * F.col("n")))
        chosen = restricted(choose, {r["part"] for r in good.select("part").collect()} | GROUPS.keys())
        y = chosen["label"].to_numpy(dtype=float)
        mined = mine_voters([set(p.split()) - GROUPS.keys() for p in chosen["parts"]], y, least=least)
        judged = restricted(judge, {*mined, *GROUPS})
        votes, names = _votes(judged, mined)
        posterior, accuracy, weight = label_model(votes, prior, *accuracies(_votes(chosen, mined)[0], y, prior))
        known |= dict(zip(judged["row"].tolist(), posterior.tolist()))
        voters |= {n: (float(x), float(z)) for n, x, z in zip(names, accuracy, weight)}
    if not known:
        return Model({}, -3.0)
    share = float(np.mean(list(known.values())))
    told = counts(rows, known)
    # parts whose rows have another mean posterior than all rows, by more than three standard errors
    apart = (F.abs(F.col("marked") - share * F.col("n")) > 3 * F.sqrt(F.col("n") * share * (1 - share) + 1)) & (F.col("n") >= 5)
    voting = {n for n in voters if n not in LEXICONS and n not in PATTERNS} | GROUPS.keys()
    features = restricted(rows, {r["part"] for r in told.where(apart).select("part").collect()} | voting)
    sets = [set(p.split()) | {MARK + m for m in marks.split()} for p, marks in zip(features["parts"], features["marks"])]
    targets = features["row"].map(known).fillna(share).to_numpy(dtype=float)
    weights, bias = linear(sets, targets, sorted(set().union(*sets)))
    return Model(weights, bias, voters)


def _votes(frame: pd.DataFrame, mined: list[str]) -> tuple[np.ndarray, list[str]]:
    votes, names = vote_matrix([""] * len(frame), [set(p.split()) for p in frame["parts"]], mined)
    for k, pattern in enumerate(PATTERNS):
        votes[:, len(LEXICONS) + k] = [pattern in m.split() for m in frame["marks"]]
    return votes, names


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text, row by row: equal texts score alike, repeated rows and null ids
    stay, null and empty texts get the model's base score. Other columns of the input are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in slices(frames):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [m.score(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(run, "doc_id long, score double")


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
