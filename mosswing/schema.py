"""Collection schemas: nine field kinds, their Spark types, and validation of documents."""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

METRICS = ("l2", "dot", "cosine")
SCALARS = {"text": T.StringType(), "i64": T.LongType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "date": T.LongType(), "enum": T.StringType(), "blob": T.BinaryType()}
FILTERABLE = {"i64", "f64", "bool", "date", "enum", "set"}
RANGED = {"i64", "f64", "date"}
MAX_ID = 2**63


class Invalid(ValueError):
    """A schema, document, filter or request that is refused before any plan is built."""


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    dims: int = 0
    metric: str = "l2"

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "vector":
            return T.ArrayType(T.FloatType())
        return T.ArrayType(T.StringType()) if self.kind == "set" else SCALARS[self.kind]


@dataclass(frozen=True)
class Schema:
    """An ordered list of fields, fixed for the life of a collection."""

    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise Invalid("a field name occurs twice")
        for f in self.fields:
            if not f.name or f.name.startswith("_"):
                raise Invalid(f"field name {f.name!r} is empty or reserved")
            if f.kind not in {*SCALARS, "set", "vector"}:
                raise Invalid(f"{f.name}: no kind {f.kind!r}")
            if f.kind == "vector" and (f.dims < 1 or f.metric not in METRICS):
                raise Invalid(f"{f.name}: a vector needs dimensions and a metric of {METRICS}")

    @classmethod
    def parse(cls, spec: list[dict[str, Any]]) -> Schema:
        return cls(tuple(Field(s["name"], s["kind"].lower(), int(s.get("dims", 0)), s.get("metric", "l2").lower()) for s in spec))

    def to_spec(self) -> list[dict[str, Any]]:
        return [{"name": f.name, "kind": f.kind} | ({"dims": f.dims, "metric": f.metric} if f.kind == "vector" else {}) for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise Invalid(f"no field {name!r}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, True, {"kind": f.kind, "dims": f.dims, "metric": f.metric}) for f in self.fields])

    def value(self, name: str, value: Any) -> Any:
        """A checked value; sets come back sorted without repeats, blobs as bytes."""
        f = self[name]
        if value is None:
            return None
        whole = isinstance(value, int) and not isinstance(value, bool)
        if f.kind == "vector":
            if not isinstance(value, (list, tuple)) or len(value) != f.dims:
                raise Invalid(f"{name}: {f.dims} numbers are needed")
            if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in value):
                raise Invalid(f"{name}: components must be finite numbers")
            return [float(x) for x in value]
        if f.kind in ("i64", "date"):
            if not whole or not -(2**63) <= value < 2**63:
                raise Invalid(f"{name}: a 64-bit integer is needed")
            return value
        if f.kind == "f64":
            if not whole and not isinstance(value, float) or not math.isfinite(value):
                raise Invalid(f"{name}: a finite number is needed")
            return float(value)
        if f.kind == "bool":
            if not isinstance(value, bool):
                raise Invalid(f"{name}: a boolean is needed")
            return value
        if f.kind == "set":
            if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
                raise Invalid(f"{name}: a list of strings is needed")
            return sorted(set(value))
        if f.kind == "blob":
            try:
                return bytes(value) if isinstance(value, (bytes, bytearray)) else base64.b64decode(value, validate=True)
            except (ValueError, TypeError) as e:
                raise Invalid(f"{name}: base64 is needed") from e
        if not isinstance(value, str):
            raise Invalid(f"{name}: a string is needed")
        return value

    def document(self, doc: dict[str, Any]) -> dict[str, Any]:
        """A checked document: every field present, None where it is missing; `id` is checked as well."""
        if "id" not in doc:
            raise Invalid("a document needs an id")
        for name in doc:
            if name != "id":
                self[name]
        return {"id": check_id(doc["id"])} | {f.name: self.value(f.name, doc.get(f.name)) for f in self.fields}


def check_id(value: Any) -> int | str:
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < MAX_ID:
        return value
    if isinstance(value, str) and 1 <= len(value.encode()) <= 1024 and "\x1f" not in value:
        return value
    raise Invalid(f"{value!r} is neither an integer under 2^63 nor a text of 1 to 1024 bytes")


def path_id(text: str, as_text: bool = False) -> int | str:
    """An id in a path: digits are a number unless they are meant as text."""
    return check_id(int(text) if text.isascii() and text.isdigit() and not as_text else text)
