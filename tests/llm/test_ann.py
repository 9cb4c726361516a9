import numpy as np
import pytest
from pyspark.sql import functions as F

from mosswing.llm.ann import rotation, scan, search


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.standard_normal((40, 24)), 50, axis=0) + 0.4 * r.standard_normal((2000, 24))
    x[:700] = x[0] + 0.01 * r.standard_normal((700, 24))  # a third of all rows in one list
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(3000, None), (3100, [0.0] * 24), (3200, [float("nan")] * 24), (3300, [None] * 24), (3400, [1.0]), (None, rows[0][1]), (3500, rows[7][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def test_recall_and_scores(vectors):
    out = search(vectors, F.col("vec_id") % 100 == 0, chunk=300).toPandas()
    usable = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 24 and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])]
    ids, x = np.array([i for i, _ in usable]), np.array([v for _, v in usable])
    hit, total = 0, 0
    assert set(out["query_id"]) == {i for i in ids if i % 100 == 0}
    for q, got in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        got = got.sort_values("rank")
        assert list(got["rank"]) == list(range(1, 11)) and got["score"].is_monotonic_increasing and q not in set(got["vec_id"])
        assert np.allclose(got["score"], [d[ids == i][0] for i in got["vec_id"]])
        hit, total = hit + len(set(ids[best]) & set(got["vec_id"])), total + 10
    assert hit / total >= 0.9


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["rank"], r["score"]) for r in rows] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert search(df.limit(0), F.lit(True)).count() == 0 and search(df, F.lit(False)).count() == 0


def test_scan_keeps_the_nearest():
    r = np.random.default_rng(5)
    t, found = rotation(32), 0
    assert np.allclose(t @ t.T, np.eye(32))
    centres = r.standard_normal((30, 32))
    x = (np.repeat(centres, 100, axis=0) + 0.3 * r.standard_normal((3000, 32))) @ t
    for i in range(20):
        q = (centres[i] + 0.3 * r.standard_normal(32)) @ t
        kept = scan(q, x, 10, np.ones(3000, dtype=bool), [slice(a, a + 8) for a in range(0, 32, 8)], 2.1)
        found += len(set(np.argsort(((x - q) ** 2).sum(1))[:10]) & set(kept))
        assert len(kept) < 300
    assert found >= 195


def test_far_clusters_and_repeated_ids(spark):
    """A query in a tiny cluster far off still gets its ten; rows that share an id are queries of their own."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.standard_normal((2000, 8)), 100 + 0.01 * r.standard_normal((3, 8)), -100 + 0.01 * r.standard_normal((3, 8))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(7, [float(c) for c in x[11]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = search(df, F.col("vec_id").isin(2000, 2003, 7, 5)).toPandas()
    assert {q: len(g) for q, g in out.groupby("query_id")} == {5: 10, 7: 20, 2000: 10, 2003: 10}
    far = out[out["query_id"] == 2000].sort_values("rank")
    assert set(far["vec_id"][:2]) == {2001, 2002} and far["score"].is_monotonic_increasing and list(far["rank"]) == list(range(1, 11))
    seven = out[out["query_id"] == 7]
    assert sorted(seven["rank"]) == sorted([*range(1, 11)] * 2) and (seven["score"] == 0.0).sum() == 1  # the copy of 11 finds 11
    assert (out["score"] >= 0).all()
