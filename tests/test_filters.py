import random

import pytest
from pyspark.sql import Row

from mosswing.plans.filters import And, Not, Or, all_of, condition, parse_filter, unexpired
from mosswing.schema import Invalid, Schema

SCHEMA = Schema.parse([
    {"name": "year", "kind": "i64"}, {"name": "channel", "kind": "enum"}, {"name": "tags", "kind": "set"}, {"name": "ok", "kind": "bool"},
    {"name": "score", "kind": "f64"}, {"name": "title", "kind": "text"}, {"name": "v", "kind": "vector", "dims": 2}])


def some(r, value, share=0.15):
    return None if r.random() < share else value


def documents(n=150, seed=1):
    r = random.Random(seed)
    return [
        {
            "id": i, "year": some(r, r.randrange(1990, 2000)), "channel": some(r, f"ch{r.randrange(4)}"), "ok": some(r, r.random() < 0.5), "v": None,
            "tags": some(r, sorted(r.sample(["t0", "t1", "t2", "t3"], r.randrange(4)))), "score": some(r, r.uniform(-10, 10)), "title": some(r, "x"),
        }
        for i in range(n)
    ]


def random_filter(r, depth=0):
    if depth < 3 and r.random() < 0.45:
        kind = r.choice(["and", "or", "not"])
        return {"not": random_filter(r, depth + 1)} if kind == "not" else {kind: [random_filter(r, depth + 1) for _ in range(r.randrange(4))]}
    return r.choice([
        lambda: {"field": "year", "eq": r.randrange(1990, 2000)}, lambda: {"field": "year", "gte": r.randrange(1990, 2000), "lt": r.randrange(1990, 2002)},
        lambda: {"field": "channel", "in": r.sample(["ch0", "ch1", "ch2", "zz"], r.randrange(4))}, lambda: {"field": "tags", "eq": r.choice(["t0", "t9"])},
        lambda: {"field": "tags", "in": r.sample(["t0", "t1", "t9"], r.randrange(3))}, lambda: {"field": "ok", "eq": r.random() < 0.5},
        lambda: {"field": "score", "gt": r.uniform(-10, 10)}, lambda: {"field": r.choice(["year", "title", "v", "tags"]), "is_null": r.random() < 0.5}])()


def test_plans_agree_with_the_evaluator(spark):
    docs = documents()
    types = "id long, year long, channel string, ok boolean, v array<float>, tags array<string>, score double, title string"
    df = spark.createDataFrame([Row(**d) for d in docs], types).cache()
    r = random.Random(5)
    filters = [parse_filter(random_filter(r), SCHEMA) for _ in range(60)]
    got = df.select("id", *[p.column().alias(f"f{i}") for i, p in enumerate(filters)]).orderBy("id").collect()
    for i, p in enumerate(filters):
        assert [bool(row[f"f{i}"]) for row in got] == [p.matches(d) for d in docs], p


def test_edges():
    assert parse_filter({"and": []}, SCHEMA) == And(()) and parse_filter({"or": []}, SCHEMA) == Or(())
    assert parse_filter(None, SCHEMA).matches({})
    assert Not(parse_filter({"field": "year", "eq": 1}, SCHEMA)).matches({"year": None})
    assert not parse_filter({"field": "year", "gte": 3, "lte": 1}, SCHEMA).matches({"year": 2})
    assert parse_filter({"field": "year", "gt": 5, "gte": 3}, SCHEMA).matches({"year": 3})
    assert unexpired("year", 5).matches({"year": None}) and not unexpired("year", 5).matches({"year": 5})


@pytest.mark.parametrize("spec", [
    {}, {"field": "nope", "eq": 1}, {"field": "title", "eq": "x"}, {"field": "v", "eq": [1, 2]}, {"field": "ok", "gt": True}, {"field": "channel", "lt": "a"},
    {"field": "tags", "gte": "a"}, {"field": "year", "eq": "x"}, {"field": "year", "eq": None}, {"field": "_tenant", "eq": "x"}, {"field": "year"}, {"and": {}}, 3])
def test_refused(spec):
    with pytest.raises(Invalid):
        parse_filter(spec, SCHEMA)


def test_helpers():
    doc = {"channel": "ch1", "year": 3, "tags": ["a", "b"]}
    for spec, want in [
        (all_of({"channel": "ch1", "year": 3}), True), (condition("year", "!=", 3), False), (condition("year", ">=", 3), True), (condition("tags", "all", ["a", "b"]), True),
        (condition("tags", "any", ["z"]), False), (condition("channel", "nin", ["ch2"]), True), (condition("tags", "contains", "a"), True), (condition("year", "is_empty", None), False)]:
        assert parse_filter(spec, SCHEMA).matches(doc) is want
    with pytest.raises(Invalid):
        condition("year", "~", 3)


def test_bare_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id AS year").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(parse_filter({"field": "year", "eq": 3}, SCHEMA).column())._jdf.queryExecution().toString()
    assert "EqualTo(year,3)" in plan
