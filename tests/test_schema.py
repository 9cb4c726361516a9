import pytest

from mosswing.schema import Invalid, Schema, check_id, path_id

SCHEMA = Schema.parse([
    {"name": "img", "kind": "vector", "dims": 3, "metric": "l2"}, {"name": "title", "kind": "text"}, {"name": "year", "kind": "i64"},
    {"name": "score", "kind": "f64"}, {"name": "tags", "kind": "set"}, {"name": "raw", "kind": "blob"}, {"name": "ok", "kind": "bool"}])


@pytest.mark.parametrize("spec", [
    [{"name": "", "kind": "i64"}], [{"name": "a", "kind": "i64"}, {"name": "a", "kind": "text"}], [{"name": "_a", "kind": "i64"}],
    [{"name": "v", "kind": "vector", "dims": 0}], [{"name": "v", "kind": "map"}], [{"name": "v", "kind": "vector", "dims": 2, "metric": "l1"}]])
def test_bad_schemas(spec):
    with pytest.raises(Invalid):
        Schema.parse(spec)


def test_documents_are_completed_and_normalised():
    doc = SCHEMA.document({"id": 1, "tags": ["b", "a", "b"], "raw": "aGk=", "year": 5})
    assert doc == {"id": 1, "img": None, "title": None, "year": 5, "score": None, "tags": ["a", "b"], "raw": b"hi", "ok": None}


@pytest.mark.parametrize("doc", [
    {}, {"id": 1, "other": 2}, {"id": 1, "_tenant": "x"}, {"id": 1, "img": [1, 2]}, {"id": 1, "img": [1, 2, float("nan")]}, {"id": 1, "year": 1.0},
    {"id": 1, "year": True}, {"id": 1, "title": 3}, {"id": 1, "score": float("inf")}, {"id": 1, "tags": "a"}, {"id": 1, "raw": "*"}, {"id": 1, "ok": 1}])
def test_bad_documents(doc):
    with pytest.raises(Invalid):
        SCHEMA.document(doc)


def test_ids():
    assert check_id(0) == 0 and check_id("a") == "a" and path_id("12") == 12 and path_id("12", True) == "12" and path_id("x1") == "x1"
    for bad in (-1, 2**63, "", "a\x1fb", "x" * 1025, 1.5, None, True):
        with pytest.raises(Invalid):
            check_id(bad)
    assert Schema.parse(SCHEMA.to_spec()) == SCHEMA
