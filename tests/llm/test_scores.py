import math
import random
from collections import Counter

import numpy as np
import pytest
from llm_data import prose

from mosswing.llm import quality, toxicity
from mosswing.llm.lm_score import lm_scores, op1_stupid_backoff

WORD = __import__("re").compile(r"[^\W_]+")


def brute_scores(texts, order, alpha):
    lists = [WORD.findall((t or "").lower()) for t in texts]
    counts = [Counter(tuple(w[i : i + k]) for w in lists for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    n = sum(map(len, lists))
    for w in lists:
        own = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
        total = 0.0
        for i in range(len(w)):
            possible = min(order, i + 1)
            for k in range(possible, 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                c = counts[k - 1][g] - own[k - 1][g]
                if c:
                    below = max(1, n - len(w)) if k == 1 else counts[k - 2][g[:-1]] - own[k - 2][g[:-1]]
                    total += math.log(c / below) + (possible - k) * math.log(alpha)
                    break
            else:
                total += possible * math.log(alpha) - math.log(max(1, n - len(w)))
        yield len(w), total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_against_counters(spark, docs, order):
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    rows = sorted(df.collect(), key=lambda r: r["doc_id"])
    want = dict(zip([r["doc_id"] for r in rows], brute_scores([r["text"] for r in rows], order, 0.4)))
    out = lm_scores(df, order, block_chars=20_000).collect()
    assert len(out) == len(rows)
    for r in out:
        n, log = want[r["doc_id"]]
        assert r["n_words"] == n and abs(r["log_score"] - log) < 1e-6 * max(1, n), r
        assert (r["mean_log"] is None) == (n == 0) and (n == 0 or 0 <= r["backed_off"] <= 1)


def test_registered_order_tells_word_salad(spark, tmp_path):
    """Texts of natural word pairs, but senseless longer sequences, score less than those of the corpus."""
    rows = [(i, "red fox sees blue whale sees red fox sees blue whale") for i in range(4)] + [(i, "sees red whale and blue whale sees red whale") for i in range(4, 8)]
    rows += [(100, "fox sees blue whale sees"), (101, "fox sees red whale sees")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["log_score"] for r in op1_stupid_backoff(spark, str(tmp_path)).collect()}
    want = list(brute_scores([t for _, t in rows], 3, 0.4))
    assert all(abs(got[i] - w) < 1e-6 for (i, _), (_, w) in zip(rows, want)) and got[100] > got[101]


def test_backoff_odd_tables(docs, clashing, nothing):
    assert lm_scores(clashing).count() == docs.count() and lm_scores(nothing).count() == 0


def junk(seed, n):
    return " ".join(w + "###" for w in prose(seed, n).upper().split())


def labelled(spark, n=300):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.6, r.random() < 0.4
        text = prose(1000 + i, 80) if good else junk(1000 + i, 80)
        if toxic:
            text += " you idiot " + r.choice(["moron", "zorblax", "scum"])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int"), labels


def test_quality_held_out(spark, docs, clashing, nothing):
    d, l, truth = labelled(spark)  # noqa: E741
    model = quality.train(d, l)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in truth]) > 0.97
    out = quality.score(clashing, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert out.select(docs.columns).exceptAll(docs).isEmpty()
    assert quality.score(nothing, model).count() == 0
    empty = quality.train(nothing, l.limit(0))
    assert quality.score(docs, empty).select("score").distinct().count() == 1


def test_quality_learns_interactions():
    r = np.random.default_rng(1)
    x = r.uniform(size=(4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9 and (0, 1) in model.pairs
    assert quality.fit(x[:10], np.ones(10)).score(x[:2]).shape == (2,)


def test_toxicity_held_out(spark, docs, nothing):
    d, l, truth = labelled(spark)  # noqa: E741
    model = toxicity.train(d, l)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in truth]) > 0.97
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.train(nothing, l.limit(0)).score("x") < 0.5


def voters(seed, rates, n=4000, share=0.3):
    r = np.random.default_rng(seed)
    y = r.random(n) < share
    return y, np.stack([np.where(y, r.random(n) < a, r.random(n) < b) for a, b in rates], axis=1).astype(np.int8)


def test_label_model_finds_accuracies():
    true = ((0.8, 0.02), (0.6, 0.01), (0.3, 0.3))
    y, votes = voters(2, true)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter that copies another
    q, accuracy, weight = toxicity.label_model(votes, 0.3, np.array([0.85, 0.85, 0.3, 0.85]), votes.sum(0) * 1.0)
    true = [(votes[y, k]).sum() / votes[:, k].sum() for k in range(4)]
    assert all(abs(x - t) < 0.15 for x, t in zip(accuracy, true)), (accuracy, true)
    assert ((q > 0.5) == y).mean() > 0.9 and q[votes.sum(1) == 0].max() < 0.31
    assert weight[0] + weight[3] < 1.1 and weight[1] > 0.6  # the copy counts once


def test_noise_voters_tell_nothing():
    y, votes = voters(3, [(0.2, 0.2)] * 5)
    first, rest = slice(0, 2000), slice(2000, None)
    q, *_ = toxicity.label_model(votes[rest], 0.3, *toxicity.accuracies(votes[first], y[first].astype(float), 0.3))
    assert ((q > 0.5) == y[rest]).mean() <= (~y[rest]).mean() + 0.01 and abs(np.corrcoef(q, y[rest])[0, 1]) < 0.08


def test_toxicity_scores_by_hand(spark):
    """Every score is the logistic of the bias and the weights of the text's own words, beginnings and patterns."""
    d, l, _ = labelled(spark)  # noqa: E741
    model = toxicity.train(d, l)
    for r in toxicity.score(d, model).join(d.select("doc_id", "text"), "doc_id").collect():
        same = r["text"].lower()
        words = set(__import__("re").findall(r"[^\W\d_]+", same))
        z = model.bias + sum(model.weights.get(w, 0.0) + sum(model.weights.get(w[:k] + "*", 0.0) for k in range(4, 9) if len(w) >= k) for w in words)
        z += sum(model.weights.get("#" + k, 0.0) for k, p in toxicity.PATTERNS.items() if p.search(same))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9


def test_toxicity_odd_tables(docs, clashing):
    model = toxicity.Model({"x": 1.0}, -1.0)
    assert toxicity.score(clashing, model).columns == ["doc_id", "score"] and toxicity.score(clashing, model).count() == docs.count()


def test_quality_scores_by_hand(spark):
    d, l, _ = labelled(spark, 120)  # noqa: E741
    m = quality.train(d, l)
    for r in quality.score(d, m).collect():
        x = quality.features(r["text"])
        z = m.bias
        for f, t in enumerate(m.tables):
            z += t[sum(e <= x[f] for e in m.edges[f])]
        for (f, g), t in m.pairs.items():
            z += t[sum(e <= x[f] for e in m.coarse[f]), sum(e <= x[g] for e in m.coarse[g])]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
