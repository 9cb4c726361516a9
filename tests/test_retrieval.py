import math
import random

import pytest
from pyspark.sql import functions as F

from mosswing.functions.tokens import query_terms, tokens
from mosswing.operators.bm25 import batch_bm25, bm25
from mosswing.operators.fusion import Rrf, Weighted, fuse, ranked_leg
from mosswing.operators.knn import Pq, Sq8, batch_knn, choose_route, exact_knn, pq_knn, sq8_knn
from mosswing.operators.search import search
from mosswing.plans.request import parse_request
from mosswing.schema import Invalid, Schema

TEXTS = ["nuclear fish minister", "nuclear pond", "fish minister fish garden minister swims beside the fish", "the winter", None, "nuclear nuclear nuclear spoon"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i + 1, t, [float(i), 1.0] if i != 3 else None, "a" if i % 2 else None, i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, t string, v array<float>, g string, n long").cache()


def pairs(df, digits=6):
    return [(r["id"], round(r["score"], digits)) for r in df.collect()]


def brute_bm25(texts, query, match_all=False):
    docs = [query_terms_list(t) for t in texts]
    terms = query_terms(query)
    n, avg = len(docs), sum(map(len, docs)) / max(1, sum(bool(d) for d in docs))
    out = []
    for i, d in enumerate(docs):
        hit = [t for t in terms if t in d]
        if hit and (not match_all or len(hit) == len(terms)):
            s = 0.0
            for t in hit:
                df, tf = sum(t in x for x in docs), d.count(t)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
            out.append((i + 1, s))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def query_terms_list(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


@pytest.mark.parametrize("query, every", [("nuclear fish", False), ("nuclear fish", True), ("Minister", False), ("fish", True), ("nothing here", False), ("nuclear qqq", True), ("", False), ("...", False)])
def test_bm25(corpus, query, every):
    want = [(i, round(s, 6)) for i, s in brute_bm25(TEXTS, query, every)]
    assert pairs(bm25(corpus, "id", "t", query, 10, every)) == want


def test_bm25_filter_keeps_statistics(corpus):
    whole = dict(pairs(bm25(corpus, "id", "t", "nuclear", 10)))
    part = dict(pairs(bm25(corpus, "id", "t", "nuclear", 10, where=F.col("id") != 6)))
    assert part == {i: s for i, s in whole.items() if i != 6}


def test_batch_bm25(spark, corpus):
    queries = spark.createDataFrame([(1, "nuclear fish"), (2, "the")], "query_id long, text string")
    got = {(r["query_id"], r["id"]): round(r["score"], 6) for r in batch_bm25(corpus, "id", "t", queries, 10).collect()}
    assert got == {(q, i): round(s, 6) for q, t in ((1, "nuclear fish"), (2, "the")) for i, s in brute_bm25(TEXTS, t)}


def test_tokens(spark):
    df = spark.createDataFrame([("Bonjour, Marché! Étang profond-1999 ja_nein",), ("  ...  ",), (None,), ("ΟΔΟΣ",)], "t string")
    assert [r[0] for r in df.select(tokens("t")).collect()] == [["bonjour", "marché", "étang", "profond", "1999", "ja", "nein"], [], [], ["οδοσ"]]
    assert query_terms("b a B, ½") == ["a", "b", "½"]


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_knn(spark, corpus, metric):
    q = [2.0, 0.5]
    rows = [(r["id"], [float(x) for x in r["v"]]) for r in corpus.collect() if r["v"]]

    def d(v):
        if metric == "l2":
            return sum((a - b) ** 2 for a, b in zip(v, q))
        dot = sum(a * b for a, b in zip(v, q))
        return -dot if metric == "dot" else -dot / math.hypot(*v) / math.hypot(*q)

    want = sorted([(i, round(d(v), 6)) for i, v in rows], key=lambda x: (x[1], x[0]))
    assert pairs(exact_knn(corpus, "id", "v", q, metric, 10)) == want
    queries = spark.createDataFrame([(7, q)], "query_id long, vector array<double>")
    assert pairs(batch_knn(corpus, "id", "v", queries, metric, 3).orderBy("rank")) == want[:3]
    sq8 = Sq8.fit(corpus, "v")
    coded = corpus.withColumn("q8", sq8.codes("v"))
    assert pairs(sq8_knn(coded, sq8, "id", "v", q, metric, 3)) == want[:3]
    pq = Pq.fit(corpus, "v", width=1)
    assert metric == "cosine" or pairs(pq_knn(pq.encoded(corpus, "v"), pq, "id", "v", q, metric, 3)) == want[:3]


def test_zero_vectors_and_ties(spark):
    df = spark.createDataFrame([(2, [0.0, 0.0]), (1, [0.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<float>")
    assert pairs(exact_knn(df, "id", "v", [0.0, 0.0], "cosine", 3)) == [(1, 0.0), (2, 0.0), (3, 0.0)]
    assert pairs(exact_knn(df, "id", "v", [1.0, 0.0], "cosine", 3)) == [(3, -1.0), (1, 0.0), (2, 0.0)]


def leg(spark, n, rows, up):
    return ranked_leg(spark.createDataFrame(rows, "id long, score double"), n, up)


def test_fusion(spark):
    a, b = leg(spark, 0, [(1, 0.1), (2, 0.2), (3, 0.3)], False), leg(spark, 1, [(3, 9.0), (2, 5.0), (9, 1.0)], True)
    got = fuse([a, b], Rrf(), 10)
    assert pairs(got, 8) == [(3, 0.03226646), (2, 0.03225806), (1, 0.01639344), (9, 0.01587302)]
    assert got.where("id = 1").first()["legs"][1] is None and got.where("id = 3").first()["legs"][1]["rank"] == 0
    assert pairs(fuse([a, b], Weighted((0.7, 0.3)), 10)) == [(1, 0.7), (2, 0.5), (3, 0.3), (9, 0.0)]
    flat, up = leg(spark, 0, [(1, 0.5), (2, 0.5)], False), leg(spark, 1, [(2, 3.0), (1, 1.0)], True)
    assert pairs(fuse([flat, up], Weighted((1, 1)), 10)) == [(2, 1.0), (1, 0.0)]
    down, same = leg(spark, 0, [(1, 0.5), (2, 0.7)], False), leg(spark, 1, [(2, 3.0), (1, 3.0)], True)
    assert pairs(fuse([down, same], Weighted((1, 1)), 10)) == [(1, 2.0), (2, 1.0)]


SCHEMA = Schema.parse([{"name": "t", "kind": "text"}, {"name": "v", "kind": "vector", "dims": 2}, {"name": "g", "kind": "enum"}, {"name": "n", "kind": "i64"}])


def test_search_and_groups(corpus):
    body = {"vectors": [{"field": "v", "vector": [0, 1]}], "k": 10, "group_by": "g"}
    rows = search(corpus, parse_request(body, SCHEMA), SCHEMA).collect()
    assert [(r["id"], r["group"]) for r in rows] == [(1, None), (2, "a"), (3, None), (5, None)]
    assert rows[0]["doc"]["t"] == TEXTS[0]
    plain = search(corpus, parse_request({"k": 2, "filter": {"field": "n", "gt": 1}, "with_documents": False}, SCHEMA), SCHEMA).collect()
    assert [(r["id"], r["score"], r["legs"]) for r in plain] == [(3, 0.0, []), (4, 0.0, [])]


@pytest.mark.parametrize("body", [
    {"k": 0}, {"k": 10_001}, {"vectors": [{"field": "t", "vector": [1, 2]}]}, {"vectors": [{"field": "v", "vector": [1]}]}, {"text": {"field": "v", "query": "x"}},
    {"vectors": [{"field": "v", "vector": [1, 2]}], "fusion": {"weighted": [1, 2]}}, {"group_by": "v"}, {"group_by": "nope"}, {"fusion": {"x": 1}}])
def test_refused_requests(body):
    with pytest.raises(Invalid):
        parse_request(body, SCHEMA)


def test_oversample_is_clamped():
    assert parse_request({"oversample": 1000, "k": 3}, SCHEMA).depth == 192 and parse_request({"oversample": 0}, SCHEMA).depth == 10


def test_route():
    assert choose_route(10, 10**9) == "scan" and choose_route(10**8, 10**9) == "ivf"


def test_batch_bm25_shuffles_no_pairs(spark, monkeypatch):
    from mosswing.operators import bm25 as module

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 20))) for _ in range(60)] + ["a b", "a b", "a b", None]
    asked = {7: "a b zz", 3: "c, d e", 5: "", 9: "h"}
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, t string")
    queries = spark.createDataFrame([*asked.items(), (9, "h a")], "query_id long, text string")  # two rows are one query
    asked[9] = "h a"
    want = [(q, n + 1, i, s) for q, t in sorted(asked.items()) for n, (i, s) in enumerate(sorted([(i, round(s, 6)) for i, s in brute_bm25(texts, t)], key=lambda x: (-x[1], x[0]))[:3])]
    for block, pairs_ in ((1024, 1_000_000), (2, 5)):
        monkeypatch.setattr(module, "QUERY_BLOCK", block)
        monkeypatch.setattr(module, "PAIRS", pairs_)
        got = batch_bm25(df, "id", "t", queries, 3)
        assert [(x["query_id"], x["rank"], x["id"], round(x["score"], 6)) for x in got.orderBy("query_id", "rank").collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 2  # a block each: queries meet documents only within tasks


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_batch_knn_takes_exact_distances_of_few_pairs(spark, monkeypatch, metric):
    import numpy as np

    from mosswing.operators import knn as module

    r = np.random.default_rng(6)
    x = np.round(r.normal(size=(300, 3)) * 3) + (1e4 if metric == "l2" else 0)  # far from the origin, with many ties
    monkeypatch.setattr(module, "ROW_BLOCK", 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    queries = df.where("id % 50 = 1").selectExpr("id query_id", "v vector")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
    d = np.round(((x[:, None] - x) ** 2).sum(2) if metric == "l2" else -(unit @ unit.T), 6)
    want = [(q, n + 1, int(i), d[q, i]) for q in range(1, 300, 50) for n, i in enumerate(np.lexsort((np.arange(300), d[q]))[:7])]
    assert [(a["query_id"], a["rank"], a["id"], a["score"]) for a in batch_knn(df, "id", "v", queries, metric, 7).orderBy("query_id", "rank").collect()] == want
    at, _, _ = module._near(x[:1], x, metric, 7, np.full(1, np.inf), 6)
    assert len(at) < 150  # not a distance and a place in an order for each pair


def test_postings_of_repeated_ids_and_no_shuffle(spark):
    from mosswing.operators.bm25 import postings

    texts = [(1, "red blue Red"), (2, None), (3, "..."), (4, "él red"), (5, "blue")]
    plain = spark.createDataFrame(texts, "id long, t string")
    found = postings(plain, "id", "t")
    assert sorted(map(tuple, found.collect())) == [("blue", 1, 1, 3), ("blue", 5, 1, 1), ("red", 1, 2, 3), ("red", 4, 1, 2), ("él", 4, 1, 2)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # a posting never leaves its task
    twice = spark.createDataFrame([*texts, (1, "red"), (5, "blue"), (None, "x"), (None, "x y")], "id long, t string")
    assert sorted(map(str, map(tuple, postings(twice, "id", "t").collect()))) == sorted(map(str, [
        ("blue", 1, 1, 4), ("blue", 5, 2, 2), ("red", 1, 3, 4), ("red", 4, 1, 2), ("él", 4, 1, 2), ("x", None, 2, 3), ("y", None, 1, 3)]))
