import numpy as np
import pytest

from mosswing.evaluate import mean_recall, mrr
from mosswing.sources.matrices import read_matrix, read_pairs, read_passages, read_spmat
from mosswing.sources.synth import attributes, takedowns


def test_matrices(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in x))
    (tmp_path / "a.fbin").write_bytes(np.array([4, 3], dtype="<u4").tobytes() + x.tobytes())
    (tmp_path / "a.ibin").write_bytes(np.array([4, 3], dtype="<u4").tobytes() + x.astype("<i4").tobytes())
    (tmp_path / "a.u8bin").write_bytes(np.array([4, 3], dtype="<u4").tobytes() + x.astype("u1").tobytes())
    (tmp_path / "a.ivecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in x.astype("<i4")))
    for name in ("fvecs", "fbin", "ibin", "u8bin", "ivecs"):
        rows = read_matrix(spark, str(tmp_path / f"a.{name}")).orderBy("row").collect()
        assert [r["row"] for r in rows] == [0, 1, 2, 3] and [list(r["vector"]) for r in rows] == x.tolist(), name
        assert read_matrix(spark, str(tmp_path / f"a.{name}"), limit=2).count() == 2
    with pytest.raises(ValueError):
        read_matrix(spark, str(tmp_path / "a.xyz"))


def test_other_files(spark, tmp_path):
    at, tags = np.array([0, 2, 2, 3], dtype="<i8"), np.array([5, 7, 1], dtype="<i4")
    (tmp_path / "m.spmat").write_bytes(np.array([3, 9, 3], dtype="<i8").tobytes() + at.tobytes() + tags.tobytes())
    assert [list(r["tags"]) for r in read_spmat(spark, str(tmp_path / "m.spmat")).orderBy("row").collect()] == [[5, 7], [], [1]]
    (tmp_path / "p.tsv").write_text('1\tsome "quoted text\n2\tmore\n')
    assert [tuple(r) for r in read_pairs(spark, str(tmp_path / "p.tsv")).collect()] == [(1, 'some "quoted text'), (2, "more")]
    (tmp_path / "p.jsonl").write_text('{"id": 1, "text": "x"}\n')
    assert [tuple(r) for r in read_passages(spark, str(tmp_path / "p.jsonl")).collect()] == [(1, "x")]


def test_generators(spark):
    a = attributes(spark, 5000, seed=4).cache()
    assert a.exceptAll(attributes(spark, 5000, seed=4)).isEmpty() and not a.exceptAll(attributes(spark, 5000, seed=5)).isEmpty()
    share = a.selectExpr("avg(int(flag_50)) a", "avg(int(flag_10)) b", "avg(int(flag_1)) c", "max(channel) d", "min(channel) e").first()
    assert abs(share["a"] - 0.5) < 0.03 and abs(share["b"] - 0.1) < 0.02 and share["c"] < 0.02 and (share["d"], share["e"]) == (11, 0)
    clusters = attributes(spark, 5000, correlated=True).groupBy("cluster").agg({"flag_50": "count"}).count()
    assert clusters == 100
    t = takedowns(spark, 1000, 50, 10_000).toPandas()
    assert t["id"].is_unique and len(t) == 50 and t["at_ms"].max() < 10_000


def test_measures(spark):
    truth = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20), (2, 2, 21)], "query_id long, rank int, id long")
    found = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (2, 1, 20), (2, 2, 21)], "query_id long, rank int, id long")
    assert mean_recall(found, truth, 2).first()[0] == 0.75
    relevant = spark.createDataFrame([(1, 12), (2, 20), (3, 5)], "query_id long, id long")
    assert abs(mrr(found, relevant).first()[0] - (0.5 + 1) / 3) < 1e-9
