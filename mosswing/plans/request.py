"""A search request: vector legs, at most one text leg, one filter, fusion, grouping; parsed from JSON or built."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from ..operators.fusion import Rrf, Weighted
from ..schema import FILTERABLE, Invalid, Schema
from .filters import Everything, Predicate, parse_filter

MAX_K = 10_000


@dataclass(frozen=True)
class VectorLeg:
    field: str
    vector: tuple[float, ...]
    ef: int = 0


@dataclass(frozen=True)
class TextLeg:
    field: str
    query: str
    match_all: bool = False


@dataclass(frozen=True)
class SearchRequest:
    vectors: tuple[VectorLeg, ...] = ()
    text: TextLeg | None = None
    where: Predicate = Everything()
    k: int = 10
    oversample: int = 4
    fusion: Rrf | Weighted = Rrf()
    group_by: str | None = None
    with_documents: bool = True
    exact: bool = False

    @property
    def depth(self) -> int:
        """Candidates of each leg."""
        return max(self.oversample, 1) * self.k

    def widened(self, k: int) -> SearchRequest:
        return replace(self, k=k)

    def check(self, schema: Schema) -> SearchRequest:
        if not 1 <= self.k <= MAX_K:
            raise Invalid(f"k is 1 to {MAX_K}")
        for leg in self.vectors:
            if schema[leg.field].kind != "vector":
                raise Invalid(f"{leg.field} is no vector field")
            schema.value(leg.field, list(leg.vector))
        if self.text and schema[self.text.field].kind != "text":
            raise Invalid(f"{self.text.field} is no text field")
        if isinstance(self.fusion, Weighted) and len(self.fusion.weights) != len(self.vectors) + bool(self.text):
            raise Invalid("one weight for each leg is needed, vectors first")
        if self.group_by is not None and schema[self.group_by].kind not in (FILTERABLE | {"text"}) - {"set"}:
            raise Invalid(f"{self.group_by}: results are grouped by a scalar field")
        self.where.check(schema)
        return self


def parse_request(body: dict[str, Any], schema: Schema) -> SearchRequest:
    """The JSON body of a search: vectors [{field, vector, ef}], text {field, query, all_terms}, filter, k, oversample,
    fusion {"rrf": {"k": 60}} or {"weighted": [...]}, group_by, with_documents, exact."""
    vectors = tuple(VectorLeg(v["field"], tuple(v["vector"]), int(v.get("ef", 0))) for v in body.get("vectors", []))
    t = body.get("text")
    text = TextLeg(t["field"], t["query"], bool(t.get("all_terms", False))) if t else None
    spec = body.get("fusion") or {"rrf": {}}
    if "rrf" in spec:
        fusion: Rrf | Weighted = Rrf(float((spec["rrf"] or {}).get("k", 60)))
    elif "weighted" in spec:
        fusion = Weighted(tuple(float(w) for w in spec["weighted"]))
    else:
        raise Invalid("fusion is rrf or weighted")
    request = SearchRequest(
        vectors, text, parse_filter(body.get("filter"), schema), int(body.get("k", 10)), min(64, max(1, int(body.get("oversample", 4)))),
        fusion, body.get("group_by"), bool(body.get("with_documents", True)), bool(body.get("exact", False)))
    return request.check(schema)
