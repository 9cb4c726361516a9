"""The filter algebra: a small tree, its JSON form, a two-valued evaluator, and its Catalyst expression.

Comparisons stay bare where a null would drop the row anyway, so that Parquet scans can use them; only below a `Not`
are unknowns made false.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FILTERABLE, RANGED, Invalid, Schema


class Predicate:
    """A condition on one document; unknown values make a comparison false, and `Not` is its exact complement."""

    def matches(self, doc: Mapping[str, Any]) -> bool:
        raise NotImplementedError

    def column(self) -> Column:
        raise NotImplementedError

    def check(self, schema: Schema) -> None:
        pass


@dataclass(frozen=True)
class Everything(Predicate):
    def matches(self, doc: Mapping[str, Any]) -> bool:
        return True

    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def matches(self, doc: Mapping[str, Any]) -> bool:
        return all(p.matches(doc) for p in self.parts)

    def column(self) -> Column:
        return reduce(Column.__and__, [p.column() for p in self.parts]) if self.parts else F.lit(True)

    def check(self, schema: Schema) -> None:
        for p in self.parts:
            p.check(schema)


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def matches(self, doc: Mapping[str, Any]) -> bool:
        return any(p.matches(doc) for p in self.parts)

    def column(self) -> Column:
        return reduce(Column.__or__, [p.column() for p in self.parts]) if self.parts else F.lit(False)

    def check(self, schema: Schema) -> None:
        for p in self.parts:
            p.check(schema)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def matches(self, doc: Mapping[str, Any]) -> bool:
        return not self.part.matches(doc)

    def column(self) -> Column:
        return ~F.coalesce(self.part.column(), F.lit(False))

    def check(self, schema: Schema) -> None:
        self.part.check(schema)


def _typed(schema: Schema, name: str, value: Any) -> None:
    kind = schema[name].kind
    if kind == "set":
        if not isinstance(value, str):
            raise Invalid(f"{name}: a set is compared with strings")
    elif value is None:
        raise Invalid(f"{name}: null is asked for by is_null")
    else:
        schema.value(name, value)


@dataclass(frozen=True)
class Eq(Predicate):
    field: str
    value: Any
    in_set: bool = False

    def matches(self, doc: Mapping[str, Any]) -> bool:
        got = doc.get(self.field)
        return got is not None and (self.value in got if self.in_set else got == self.value)

    def column(self) -> Column:
        return F.array_contains(self.field, self.value) if self.in_set else F.col(self.field) == F.lit(self.value)

    def check(self, schema: Schema) -> None:
        if schema[self.field].kind not in FILTERABLE:
            raise Invalid(f"{self.field}: fields of this kind can't be compared")
        _typed(schema, self.field, self.value)


@dataclass(frozen=True)
class In(Predicate):
    field: str
    values: tuple
    in_set: bool = False

    def matches(self, doc: Mapping[str, Any]) -> bool:
        got = doc.get(self.field)
        return got is not None and (bool(set(got) & set(self.values)) if self.in_set else got in self.values)

    def column(self) -> Column:
        if not self.values:
            return F.lit(False)
        return F.arrays_overlap(self.field, F.array(*map(F.lit, self.values))) if self.in_set else F.col(self.field).isin(*self.values)

    def check(self, schema: Schema) -> None:
        for v in self.values:
            Eq(self.field, v, self.in_set).check(schema)
        Eq(self.field, None, self.in_set) if self.values else schema[self.field]


@dataclass(frozen=True)
class Range(Predicate):
    field: str
    low: Any = None
    high: Any = None
    low_open: bool = False
    high_open: bool = False

    def matches(self, doc: Mapping[str, Any]) -> bool:
        got = doc.get(self.field)
        if got is None:
            return False
        above = self.low is None or (got > self.low if self.low_open else got >= self.low)
        return above and (self.high is None or (got < self.high if self.high_open else got <= self.high))

    def column(self) -> Column:
        c, parts = F.col(self.field), []
        if self.low is not None:
            parts.append(c > F.lit(self.low) if self.low_open else c >= F.lit(self.low))
        if self.high is not None:
            parts.append(c < F.lit(self.high) if self.high_open else c <= F.lit(self.high))
        return reduce(Column.__and__, parts) if parts else c.isNotNull()

    def check(self, schema: Schema) -> None:
        if schema[self.field].kind not in RANGED:
            raise Invalid(f"{self.field}: fields of this kind have no order")
        for v in (self.low, self.high):
            if v is not None:
                _typed(schema, self.field, v)


@dataclass(frozen=True)
class IsNull(Predicate):
    field: str

    def matches(self, doc: Mapping[str, Any]) -> bool:
        return doc.get(self.field) is None

    def column(self) -> Column:
        return F.col(self.field).isNull()

    def check(self, schema: Schema) -> None:
        schema[self.field]


def parse_filter(spec: Any, schema: Schema) -> Predicate:
    """JSON to a checked tree. Of and, or, not and field the first present counts; several tests of a field all hold."""
    if spec is None:
        return Everything()
    if not isinstance(spec, dict):
        raise Invalid("a filter is an object")
    for name, kind in (("and", And), ("or", Or)):
        if name in spec:
            if not isinstance(spec[name], list):
                raise Invalid(f"{name} takes a list")
            return kind(tuple(parse_filter(s, schema) for s in spec[name]))
    if "not" in spec:
        return Not(parse_filter(spec["not"], schema))
    if "field" not in spec:
        raise Invalid("a filter needs and, or, not or field")
    name = spec["field"]
    if not isinstance(name, str) or name.startswith("_"):
        raise Invalid(f"{name!r} can't be filtered by")
    in_set = schema[name].kind == "set"
    parts: list[Predicate] = []
    if "eq" in spec:
        parts.append(Eq(name, spec["eq"], in_set))
    if "in" in spec:
        parts.append(In(name, tuple(spec["in"]), in_set))
    if spec.keys() & {"gt", "gte", "lt", "lte"}:
        low, high = spec.get("gte", spec.get("gt")), spec.get("lte", spec.get("lt"))
        parts.append(Range(name, low, high, "gte" not in spec and "gt" in spec, "lte" not in spec and "lt" in spec))
    if "is_null" in spec:
        parts.append(IsNull(name) if spec["is_null"] else Not(IsNull(name)))
    if not parts:
        raise Invalid(f"{name}: no test is given")
    out = parts[0] if len(parts) == 1 else And(tuple(parts))
    out.check(schema)
    return out


def unexpired(field: str, now: int) -> Predicate:
    """Rows whose time in `field` lies after now; those without one never expire."""
    return Not(Range(field, high=now))


def all_of(spec: Mapping[str, Any]) -> dict[str, Any]:
    """The short form {field: value}: all are equal."""
    return {"and": [{"field": k, "eq": v} for k, v in spec.items()]}


OPERATORS = {"==": "eq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "in": "in", "any": "in", "contains": "eq"}


def condition(field: str, operator: str, value: Any) -> dict[str, Any]:
    """One comparison by the operator names that retrieval frameworks use."""
    if operator == "!=":
        return {"not": {"field": field, "eq": value}}
    if operator == "nin":
        return {"not": {"field": field, "in": list(value)}}
    if operator == "all":
        return {"and": [{"field": field, "eq": v} for v in value]}
    if operator == "is_empty":
        return {"field": field, "is_null": True}
    if operator not in OPERATORS:
        raise Invalid(f"no operator {operator!r}")
    return {"field": field, OPERATORS[operator]: value}
