"""Named collections with schemas that never change, access roles, and a trail of takedowns."""

from __future__ import annotations

import hashlib
import json
import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .schema import Invalid, Schema
from .store import Collection, Conflict, Files

NAME = re.compile(r"[a-z0-9_-]{1,64}")
ROLES = {"read": 0, "write": 1, "takedown": 2, "admin": 3}


class Catalog:
    """Definitions are JSON files, one a collection id; ids are never used again, and a dropped name may be."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _defs(self) -> list[dict[str, Any]]:
        names = self.files.names("catalog")
        gone = {n[:-5] for n in names if n.endswith(".drop")}
        found = [json.loads(self.files.read(f"catalog/{n}")) for n in names if n.endswith(".json") and not n.startswith(".")]
        return [d | {"dropped": str(d["id"]) in gone} for d in sorted(found, key=lambda d: d["id"])]

    def create(self, name: str, schema: list[dict[str, Any]], expires: str | None = None) -> Collection:
        if not NAME.fullmatch(name):
            raise Invalid(f"{name!r} is no collection name")
        Schema.parse(schema)
        defs = self._defs()
        if any(d["name"] == name and not d["dropped"] for d in defs):
            raise Conflict(f"{name} exists")
        new = max((d["id"] for d in defs), default=0) + 1
        self.files.create(f"catalog/{new}.json", json.dumps({"id": new, "name": name, "schema": schema, "expires": expires}))
        return self.open(name)

    def list(self) -> list[str]:
        return sorted(d["name"] for d in self._defs() if not d["dropped"])

    def open(self, name: str, clock=None) -> Collection:
        for d in self._defs():
            if d["name"] == name and not d["dropped"]:
                return Collection(self.spark, f"{self.root}/collections/{d['id']}", Schema.parse(d["schema"]), d["id"], d["expires"], clock=clock)
        raise KeyError(name)

    def drop(self, name: str) -> None:
        if name == "default":
            raise Invalid("the default collection can't be dropped")
        for d in self._defs():
            if d["name"] == name and not d["dropped"]:
                self.files.create(f"catalog/{d['id']}.drop", "")
                return
        raise KeyError(name)


class Keys:
    """Access keys by digest: each has a role and may be bound to a tenant."""

    def __init__(self, keys: dict[str, tuple[str, str | None]]) -> None:
        self.by_digest = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in keys.items()}

    def name(self, key: str) -> str:
        """What stands for a key in an audit trail: the begin of its digest."""
        return hashlib.sha256(key.encode()).hexdigest()[:12]

    def authorize(self, key: str, role: str, tenant: str | None = None) -> str | None:
        """The tenant to act for; PermissionError if the role is too low or the tenant is another."""
        own = self.by_digest.get(hashlib.sha256(key.encode()).hexdigest())
        if own is None or ROLES[own[0]] < ROLES[role]:
            raise PermissionError(role)
        if own[1] is not None and tenant not in (None, own[1]):
            raise PermissionError("another tenant")
        return own[1] or tenant


class AuditTrail:
    """Takedowns as an append-only table."""

    SCHEMA = "at_ms long, who string, collection string, what string, count long, token string"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/audit"

    def add(self, who: str, collection: str, what: str, result: dict[str, Any]) -> None:
        row = (int(time.time() * 1000), who, collection, what, result["count"], result["consistency_token"])
        self.spark.createDataFrame([row], self.SCHEMA).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)
