import pytest

from mosswing.integrations import NodeStore, TextStore
from mosswing.schema import Schema
from mosswing.sources.commandlog import CommandLog
from mosswing.store import Collection, Conflict

SCHEMA = Schema.parse([{"name": "text", "kind": "text"}, {"name": "embedding", "kind": "vector", "dims": 2, "metric": "l2"}, {"name": "parent", "kind": "enum"}, {"name": "n", "kind": "i64"}])


def embed(texts):
    return [[float(t.count("a")), float(t.count("b"))] for t in texts]


def test_text_store(spark, tmp_path):
    store = TextStore(Collection(spark, str(tmp_path), SCHEMA), embed)
    ids = store.add_texts(["aa b", "bbb", "ab ab"], [{"n": 1}, {"n": 2}, {"n": 2}], [1, 2, "three"])
    assert ids == [1, 2, "three"] and len(store.add_texts(["zz"])) == 1
    best = store.similarity_search_with_score("aa b", 2)
    assert best[0][0].page_content == "aa b" and best[0][1] == 0.0 and best[0][0].metadata == {"n": 1} and best[0][0].id == 1
    assert [d.id for d in store.similarity_search("b", 5, {"n": 2})] == [2, "three"]
    assert store.similarity_search_with_relevance_scores("aa b", 1)[0][1] == 1.0
    assert store.hybrid_search("bbb", 1)[0][0].id == 2 and store.get_by_ids([2, 99])[0].page_content == "bbb"
    assert store.delete(where={"n": 2}) == 2 and store.delete([1]) == 1 and len(store.similarity_search_by_vector([0.0, 0.0])) == 1


def test_node_store(spark, tmp_path):
    store = NodeStore(Collection(spark, str(tmp_path), SCHEMA))
    store.add([{"id": f"n{i}", "text": f"word{i} all", "embedding": [float(i), 0.0], "parent": "p" if i < 3 else "q", "metadata": {"n": i}} for i in range(5)])
    got = store.query([0.0, 0.0], k=2, filters=[("n", ">", 0)])
    assert [(i, s) for i, s, _ in got] == [("n1", 0.5), ("n2", 0.2)]
    assert [i for i, _, _ in store.query(text="word3")] == ["n3"] and store.query([1.0, 0.0], "word3 word1", 1)[0][0] == "n1"
    assert {i for i, _, _ in store.query([0.0, 0.0], k=9, filters=[("n", "==", 0), ("n", "in", [4])], any_of=True)} == {"n0", "n4"}
    assert store.delete("p") == 3 and store.delete_nodes(["n3"]) == 1 and len(store.query([0.0, 0.0], k=9)) == 1


def test_command_log(spark, tmp_path):
    log = CommandLog(spark, str(tmp_path))
    assert log.read_range(0) is None and log.last == -1
    for a in (0, 10, 20):
        log.append(spark.createDataFrame([(a + i, f"op{a + i}") for i in range(10)], "seq long, op string"))
    assert log.last == 29 and sorted(r["seq"] for r in log.read_range(8, 21).collect()) == list(range(8, 22))
    with pytest.raises(ValueError):
        log.append(spark.createDataFrame([(29, "x")], "seq long, op string"))
    with pytest.raises(Conflict):
        log.files.create(f"segments/{2:012d}.json", "{}")
    assert log.truncate(20) == 2 and log.read_range(0).count() == 10
    folder = log.segments()[0]["folder"]
    spark.createDataFrame([(25, "changed", 1)], "seq long, op string, _crc long").write.mode("append").parquet(f"{tmp_path}/{folder}")
    with pytest.raises(Exception, match="checksum"):
        log.read_range(0).collect()
