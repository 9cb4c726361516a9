import random

import pytest
from pyspark.sql import functions as F

from mosswing.catalog import AuditTrail, Catalog, Keys
from mosswing.schema import Invalid, Schema
from mosswing.store import Collection, Conflict, Manifest, merge_tokens, parse_token, verify
from mosswing.streaming.ingest import apply_batch

SPEC = [{"name": "n", "kind": "i64"}, {"name": "kind", "kind": "enum"}, {"name": "until", "kind": "date"}]
SCHEMA = Schema.parse(SPEC)


@pytest.fixture
def docs(spark, tmp_path):
    return Collection(spark, str(tmp_path / "c"), SCHEMA, shard=3, expires="until", clock=lambda: 100)


def state(c):
    return {(r["_id"] if r["_id"] is not None else r["_key"]): (r["n"], r["kind"]) for r in c.snapshot().collect()}


def test_tokens():
    assert parse_token("1.5,2.3,1.9") == {1: 9, 2: 3} and merge_tokens("2.1", "1.4,2.7", None) == "1.4,2.7"
    with pytest.raises(Invalid):
        parse_token("1-2")


def test_model(spark, docs):
    """A random sequence of writes against a dictionary, reopened now and then; a removed id is never seen again."""
    r, model = random.Random(3), {}
    ids = [1, 2, 3, "a", "b", "c"]
    for step in range(14):
        op = r.choice(["upsert", "upsert", "delete", "where", "patch", "compact", "reopen"])
        some = r.sample(ids, r.randrange(1, 4))
        if op == "upsert":
            docs.upsert([{"id": i, "n": step, "kind": r.choice("xy")} for i in some for _ in (0,)])
            model |= {k: v for k, v in state(docs).items() if k in some}
            assert set(some) <= set(model) and all(model[i][0] == step for i in some)
        elif op == "delete":
            assert docs.delete(some)["count"] == len(some)
            for i in some:
                model.pop(i, None)
        elif op == "where":
            gone = [k for k, v in model.items() if v[1] == "x"]
            assert docs.delete_where({"field": "kind", "eq": "x"})["count"] == len(gone)
            for i in gone:
                del model[i]
        elif op == "patch":
            there = [i for i in some if i in model]
            assert docs.patch([{"id": i, "set": {"kind": "z"}} for i in some])["patched"] == len(there)
            model |= {i: (model[i][0], "z") for i in there}
        elif op == "compact":
            docs.compact(force=True)
        else:
            docs = Collection(spark, docs.root, SCHEMA, 3, "until", clock=lambda: 100)
        assert state(docs) == model, (step, op)


def test_order_and_rewritten_text_ids(docs):
    docs.upsert([{"id": "a", "n": 1}, {"id": "b", "n": 1}, {"id": 9, "n": 1}, {"id": 2, "n": 1}, {"id": 2, "n": 7}])
    docs.upsert([{"id": "a", "n": 2}])
    rows = docs.search({"k": 10}).collect()
    assert [r["_id"] if r["_id"] is not None else r["_key"] for r in rows] == [2, 9, "b", "a"] and docs.get(2)["n"] == 7


def test_consistency(spark, docs):
    token = docs.upsert([{"id": 1, "n": 1}])["consistency_token"]
    assert token == "3.1"
    other = Collection(spark, docs.root, SCHEMA, 3)
    other.manifest()
    token = docs.delete([1], after="7.4")["consistency_token"]
    assert token == "3.2,7.4"
    assert other.snapshot("stale").count() == 1 and other.snapshot("read_your_writes", token).count() == 0
    with pytest.raises(Invalid):
        other.snapshot("read_your_writes", "3.99")
    with pytest.raises(Conflict):
        docs._publish(Manifest(2))


def test_delete_where_only_removes_what_is_there(docs):
    docs.upsert([{"id": 1, "kind": "x"}, {"id": 2, "kind": "x"}, {"id": 3, "kind": "x"}])
    assert docs.delete_where({"field": "kind", "eq": "x"}, ids=[1, 2])["count"] == 2
    docs.upsert([{"id": 1, "kind": "x"}])
    assert set(state(docs)) == {1, 3}
    for bad in (None, {"and": []}):
        with pytest.raises(Invalid):
            docs.delete_where(bad)
    with pytest.raises(Invalid):
        docs.delete_where({"field": "kind", "eq": "x"}, ids=[])
    assert docs.delete_by_parent("kind", "x")["count"] == 2


def test_patches(docs):
    docs.upsert([{"id": 1, "n": 1, "kind": "x"}, {"id": "k", "n": 1}, {"id": 5, "n": 1, "until": 50}])
    got = docs.patch([{"id": 1, "set": {"n": 2}}, {"id": 1, "set": {"kind": None}}, {"id": 99, "set": {"n": 3}}, {"id": 5, "set": {"n": 9}}])
    assert got["patched"] == 1 and state(docs)[1] == (2, None)
    for bad in ([], [{"id": 1, "set": {"nope": 1}}], [{"id": 1, "set": {"_tenant": "x"}}], [{"id": 1, "n": 2}]):
        with pytest.raises(Invalid):
            docs.patch(bad)


def test_retention(docs):
    docs.upsert([{"id": 1, "until": 100}, {"id": 2, "until": 101}, {"id": 3}])
    assert set(state(docs)) == {2, 3} and docs.get(1) is None
    assert docs.sweep()["count"] == 1 and docs.sweep()["count"] == 0
    assert docs.snapshot(expired=True).count() == 2


def test_tenants(docs):
    a, b = docs.for_tenant("a"), docs.for_tenant("b")
    a.upsert([{"id": 1, "n": 1}])
    b.upsert([{"id": 1, "n": 2}, {"id": "x", "n": 3}])
    assert state(a) == {1: (1, None)} and b.get(1)["n"] == 2 and docs.get(1) is None
    a.delete([1])
    assert state(b) == {1: (2, None), "x": (3, None)}
    assert docs.erase_tenant("b")["count"] == 2 and docs.snapshot().count() == 0
    with pytest.raises(Invalid):
        docs.for_tenant("no spaces")
    with pytest.raises(Invalid):
        a.erase_tenant("b")


def test_proof_and_vacuum(docs):
    docs.upsert([{"id": 1}, {"id": 2}, {"id": "k"}])
    token = docs.delete([1, "k"])["consistency_token"]
    report = docs.deletion_report([1, 2, "k", 77], token, b"secret")
    assert [d["verdict"] for d in report["documents"]] == ["deleted", "not proven", "deleted", "deleted"] and report["overall"] == "not proven"
    assert verify(report, b"secret") and not verify(report | {"overall": "deleted everywhere"}, b"secret") and not verify(report, b"other")
    assert docs.deletion_report([1], token)["overall"] == "deleted everywhere"
    assert docs.compact(force=True) and docs.vacuum() == 2 and state(docs) == {2: (None, None)}
    assert not docs.compact()


def test_revisions(docs):
    docs.upsert([{"id": 1, "kind": "p", "n": 1}, {"id": 2, "kind": "p", "n": 1}])
    docs.replace_revision([{"id": 3, "kind": "p", "n": 2}], "kind", "p", "n", 2)
    assert set(state(docs)) == {3}


def test_frames_leave_out_what_is_invalid(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "v"), Schema.parse([{"name": "v", "kind": "vector", "dims": 2}, {"name": "s", "kind": "set"}]))
    rows = [(1, [1.0, 2.0], ["b", "a", "b"]), (2, [1.0], None), (3, [1.0, float("nan")], None), (None, None, None), (4, None, None)]
    c.upsert_frame(spark.createDataFrame(rows, "id long, v array<float>, s array<string>"))
    assert {r["_id"]: r["s"] for r in c.snapshot().collect()} == {1: ["a", "b"], 4: None}


def test_a_batch_that_comes_again_changes_nothing(spark, docs):
    rows = [(1, 1, "upsert", 5), (2, 2, "upsert", 6), (1, 3, "delete", 0), (2, 1, "delete", 0)]
    df = spark.createDataFrame(rows, "id long, seq long, op string, n long").selectExpr("*", "cast(null as string) kind", "cast(null as long) until")
    apply_batch(docs, df, "s", 0)
    version = docs.manifest().version
    apply_batch(docs, df, "s", 0)
    assert docs.manifest().version == version and state(docs) == {2: (6, None)}


def test_catalog_keys_and_audit(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.create("default", SPEC)
    cat.create("b-1", SPEC, expires="until").upsert([{"id": 1}])
    assert cat.list() == ["b-1", "default"]
    for name in ("b-1",):
        with pytest.raises(Conflict):
            cat.create(name, SPEC)
    for name in ("UPPER", "", "x" * 65):
        with pytest.raises(Invalid):
            cat.create(name, SPEC)
    cat.drop("b-1")
    assert cat.create("b-1", SPEC).snapshot().count() == 0
    with pytest.raises(Invalid):
        cat.drop("default")
    with pytest.raises(KeyError):
        cat.open("none")
    keys = Keys({"k1": ("write", "t1"), "k2": ("admin", None)})
    assert keys.authorize("k1", "read") == "t1" and keys.authorize("k2", "admin", "t2") == "t2"
    for args in (("k1", "admin"), ("k1", "read", "t2"), ("zz", "read")):
        with pytest.raises(PermissionError):
            keys.authorize(*args)
    trail = AuditTrail(spark, str(tmp_path))
    trail.add("k2", "b-1", "delete", {"count": 2, "consistency_token": "1.1"})
    assert trail.read().select(F.sum("count")).first()[0] == 2


TEXT = [{"name": "t", "kind": "text"}, {"name": "v", "kind": "vector", "dims": 2, "metric": "l2"}, {"name": "kind", "kind": "enum"}]


@pytest.fixture
def texts(spark, tmp_path):
    return Collection(spark, str(tmp_path / "t"), Schema.parse(TEXT))


def test_all_tenants_are_kept_apart(texts):
    a, b = texts.for_tenant("a"), texts.for_tenant("b")
    a.upsert([{"id": 1, "t": "red apple", "kind": "x", "v": [0.0, 0.0]}])
    b.upsert([{"id": 1, "t": "red red pear", "kind": "x", "v": [3.0, 4.0]}])
    rows = texts.search({"text": {"field": "t", "query": "red"}}).collect()
    assert sorted((r["_tenant"], r["_id"], r["doc"]["t"]) for r in rows) == [("a", 1, "red apple"), ("b", 1, "red red pear")]
    assert len({r["legs"][0]["score"] for r in rows}) == 2
    near = texts.search({"vectors": [{"field": "v", "vector": [0, 0]}]}).collect()
    assert [(r["_tenant"], r["legs"][0]["score"]) for r in near] == [("a", 0.0), ("b", 25.0)]
    assert texts.search({"filter": {"field": "kind", "eq": "x"}}).count() == 2
    assert [r["_tenant"] for r in a.search({"text": {"field": "t", "query": "pear red"}}).collect()] == ["a"]


def test_text_ids_sort_by_commit(spark, docs):
    for n, ids in enumerate((["m", "k"], ["a", "z"], ["k"])):
        df = spark.createDataFrame([(i, n) for i in ids], "id string, n long").repartition(3).selectExpr("*", "cast(null as string) kind", "cast(null as long) until")
        assert docs.upsert_frame(df)["count"] == len(ids)
    found = [(r["_key"], r["doc"]["n"]) for r in docs.search({"k": 10}).collect()]
    assert found[0] == ("m", 0) and {x for x, _ in found[1:3]} == {"a", "z"} and found[3] == ("k", 2)


def test_a_dead_writer_blocks_nobody(docs):
    docs.upsert([{"id": 1, "n": 1}])
    for left in ("manifest-2.json.lock", ".deadbeef"):  # what a writer may leave
        with open(f"{docs.root}/{left}", "w"):
            pass
    docs.upsert([{"id": 2, "n": 2}])
    assert set(state(docs)) == {1, 2}


def test_one_version_a_batch(spark, docs):
    docs.upsert([{"id": 1, "n": 1}, {"id": 2, "n": 1}])
    df = spark.createDataFrame([(1, 5, "delete", 0), (2, 6, "upsert", 9), (3, 7, "upsert", 9)], "id long, seq long, op string, n long")
    apply_batch(docs, df.selectExpr("*", "cast(null as string) kind", "cast(null as long) until"), "s", 4)
    assert docs.manifest().version == 2 and docs.manifest().batches == {"s": 4} and set(state(docs)) == {2, 3}


def test_small_compactions_leave_the_base(docs):
    docs.upsert([{"id": i, "n": 0} for i in range(100)])
    docs.compact(force=True)
    base = docs.manifest().bases
    for i in range(4):
        docs.upsert([{"id": i, "n": 1}])
    docs.delete([3, 50])
    want = state(docs)
    assert docs.changes(docs.manifest().version - 1)[1].count() == 2
    assert docs.compact(deltas=2) and docs.manifest().bases == base and len(docs.manifest().deltas) == 1
    assert state(docs) == want and 3 not in want and 50 not in want and want[2] == (1, None)
    docs.upsert([{"id": 50, "n": 7}])
    assert state(docs) == want | {50: (7, None)} and docs.changes(0) is None


def test_point_reads_reach_the_scan(docs):
    docs.upsert([{"id": i, "n": 0} for i in range(50)])
    docs.compact(force=True)
    docs.upsert([{"id": 7, "n": 1}])
    docs.delete([8])
    plan = docs.snapshot().where("_id = 9")._jdf.queryExecution().executedPlan().toString()
    base = plan.split("FileScan parquet")[1]  # the bases come first; nothing of them is shuffled
    assert "EqualTo(_id,9)" in base and "Exchange" not in plan.split("FileScan parquet")[0].replace("BroadcastExchange", "") and docs.get(9)["n"] == 0 and docs.get(7)["n"] == 1 and docs.get(8) is None


def test_text_search_by_postings(texts):
    from test_retrieval import brute_bm25

    words = ["red", "blue", "green", "tall", "small"]
    r = random.Random(1)
    known = {i: " ".join(r.choice(words) for _ in range(r.randrange(0, 9))) for i in range(1, 41)}
    texts.upsert([{"id": i, "t": t or None, "kind": "xy"[i % 2]} for i, t in known.items()])
    texts.compact(force=True)
    texts.upsert([{"id": 5, "t": "blue blue red"}, {"id": 41, "t": "tall red"}])
    texts.delete([9])
    texts.delete_where({"field": "kind", "eq": "y"}, ids=[11])
    known |= {5: "blue blue red", 41: "tall red"}
    live = [i for i in sorted(known) if i not in (9, 11)]
    for query, every in (("red blue", False), ("Red tall", True), ("nothing", False)):
        want = [(live[i - 1], round(s, 6)) for i, s in brute_bm25([known[i] for i in live], query, every)]
        got = [(x["_id"], round(x["legs"][0]["score"], 6)) for x in texts.search({"text": {"field": "t", "query": query, "all_terms": every}, "k": 100, "oversample": 1}).collect()]
        assert got == want
        only = [(x["_id"], round(x["legs"][0]["score"], 6)) for x in texts.search({"text": {"field": "t", "query": query, "all_terms": every}, "k": 100, "filter": {"field": "kind", "eq": "x"}}).collect()]
        assert only == [(i, s) for i, s in want if i % 2 == 0 and i != 41]


def test_lists_of_vectors(spark, texts):
    r = random.Random(2)
    rows = [(i, None, [r.random(), r.random()] if i % 10 else None, "x") for i in range(1, 400)]
    texts.upsert_frame(spark.createDataFrame(rows, "id long, t string, v array<float>, kind string"))
    texts.cluster("v", 8)
    assert texts.manifest().lists["lists"] == 8
    texts.upsert([{"id": 1000, "v": [0.5, 0.5]}])
    texts.delete([rows[0][0]])
    query = {"vectors": [{"field": "v", "vector": [0.5, 0.5]}], "k": 5, "with_documents": False}
    exact = [x["_id"] for x in texts.search(query | {"exact": True}).collect()]
    assert exact[0] == 1000
    import mosswing.store as module

    route, module.choose_route = module.choose_route, lambda passing, total: "ivf"
    try:
        assert [x["_id"] for x in texts.search(query).collect()] == exact
        plan = texts.search(query)._jdf.queryExecution().optimizedPlan().toString()
        assert "_list" in plan
    finally:
        module.choose_route = route
    texts.compact(force=True)
    assert texts.manifest().lists["lists"] == 8 and [x["_id"] for x in texts.search(query).collect()] == exact


def test_frames_of_patches_and_presence(spark, docs):
    docs.upsert([{"id": i, "n": i, "kind": "x"} for i in range(5)])
    patches = spark.createDataFrame([(1, 1, True, 10), (1, 2, True, 11), (2, 1, True, None), (9, 1, True, 1)], "id long, seq long, set_n boolean, n long")
    assert docs.patch_frame(patches)["patched"] == 2
    assert state(docs) == {0: (0, "x"), 1: (11, "x"), 2: (None, "x"), 3: (3, "x"), 4: (4, "x")}
    docs.delete([0])
    got = docs.presence(spark.createDataFrame([(0,), (1,), (77,)], "id long")).collect()
    assert {r["id"]: r["verdict"] for r in got} == {0: "deleted", 1: "not proven", 77: "deleted"}


def test_client_checks_roles_and_keeps_a_trail(spark, tmp_path):
    from mosswing.client import Client

    cat, trail = Catalog(spark, str(tmp_path)), AuditTrail(spark, str(tmp_path))
    keys = Keys({"r": ("read", None), "w": ("write", "t1"), "d": ("takedown", None), "a": ("admin", None)})
    Client(cat, keys, "a").create("c", SPEC)
    w, r, d = (Client(cat, keys, k, trail) for k in "wrd")
    w.upsert("c", [{"id": 1, "n": 1}, {"id": 2, "n": 2}])
    assert w.get("c", 1)["n"] == 1 and r.get("c", 1) is None and r.for_tenant("t1").get("c", 2)["n"] == 2
    for call in (lambda: r.upsert("c", [{"id": 3}]), lambda: w.delete("c", [1]), lambda: d.erase_tenant("c", "t1"), lambda: w.for_tenant("t2").get("c", 1)):
        with pytest.raises(PermissionError):
            call()
    assert d.for_tenant("t1").delete("c", [1])["count"] == 1 and w.search("c", {}).count() == 1
    assert d.for_tenant("t1").deletion_report("c", [1])["overall"] == "deleted everywhere"
    assert Client(cat, keys, "a", trail).erase_tenant("c", "t1")["count"] == 1
    assert sorted((x["what"], x["count"]) for x in trail.read().collect()) == [("delete", 1), ("erase_tenant", 1)]


def test_one_write_becomes_the_base_as_it_is(spark, texts):
    texts.upsert_frame(spark.createDataFrame([(i, "red blue red" if i % 2 else "blue") for i in range(20)], "id long, t string").selectExpr("id", "t", "cast(null as array<float>) v", "'x' kind"))
    delta, terms = texts.manifest().deltas, texts.manifest().terms
    texts.compact(force=True)
    assert texts.manifest().bases == delta and texts.manifest().terms == terms and not texts.manifest().deltas  # nothing is written twice
    assert [x["_id"] for x in texts.search({"text": {"field": "t", "query": "red"}, "k": 3}).collect()] == [1, 3, 5]
    texts.upsert([{"id": 1, "t": "blue"}])
    texts.compact(force=True)
    assert texts.manifest().bases != delta and [x["_id"] for x in texts.search({"text": {"field": "t", "query": "red"}, "k": 3}).collect()] == [3, 5, 7]


def test_an_id_twice_in_one_write_is_ranked(texts):
    texts.upsert([{"id": 1, "t": "red"}, {"id": 1, "t": "blue"}, {"id": 2, "t": "blue"}])
    texts.compact(force=True)
    assert texts.search({"text": {"field": "t", "query": "red"}}).count() == 0 and texts.snapshot().count() == 2


def test_postings_of_many_small_tasks(spark, texts, monkeypatch):
    from mosswing.operators import textindex
    from mosswing.store import META

    r = random.Random(3)
    known = {i: [r.choice("él red ωβ ½ a b c d e f g h".split()) for _ in range(r.randrange(0, 30))] for i in range(60)}
    monkeypatch.setattr(textindex, "TASK_WORDS", 5)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in known.items()], "id long, t string")
    texts.upsert_frame(df.selectExpr("id", "t", "cast(null as array<float>) v", "'x' kind"))
    m = texts.manifest()
    found = textindex.read(spark, [f"{texts.root}/{f}" for f in m.terms.values()], "t", None, META).collect()
    assert sorted((x["_id"], x["term"], x["tf"], x["len"]) for x in found) == sorted((i, t, w.count(t), len(w)) for i, w in known.items() for t in set(w))


def test_lists_keep_the_postings(spark, texts):
    r = random.Random(4)
    rows = [(i, "red" if i == 7 else "blue", [r.random(), r.random()] if i % 5 == 0 else None, "x") for i in range(300)]
    texts.upsert_frame(spark.createDataFrame(rows, "id long, t string, v array<float>, kind string"))
    terms = list(texts.manifest().terms.values())
    texts.cluster("v", 4)
    assert list(texts.manifest().terms.values()) == terms and texts.snapshot().count() == 300  # rows moved, postings name them still
    texts.vacuum()
    assert [x["_id"] for x in texts.search({"text": {"field": "t", "query": "red"}}).collect()] == [7]
