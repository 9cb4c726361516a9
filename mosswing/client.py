"""Calls under an access key: roles are checked, tokens remembered, takedowns put on the audit trail."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from .catalog import AuditTrail, Catalog, Keys
from .store import Collection, merge_tokens


class TokenBox:
    """The newest consistency token of a session, shared by all its collections' and tenants' views."""

    def __init__(self) -> None:
        self.tokens: dict[str, str] = {}

    def note(self, collection: str, token: str) -> None:
        self.tokens[collection] = merge_tokens(self.tokens.get(collection), token)


class Client:
    """What a caller with one key may do; each read sees at least the caller's own writes."""

    def __init__(self, catalog: Catalog, keys: Keys, key: str, trail: AuditTrail | None = None, tenant: str | None = None, box: TokenBox | None = None) -> None:
        self.catalog, self.keys, self.key, self.trail, self.tenant = catalog, keys, key, trail, tenant
        self.box = box or TokenBox()

    def for_tenant(self, name: str) -> Client:
        return Client(self.catalog, self.keys, self.key, self.trail, name, self.box)

    def _open(self, collection: str, role: str) -> Collection:
        tenant = self.keys.authorize(self.key, role, self.tenant)
        found = self.catalog.open(collection)
        return found if tenant is None else found.for_tenant(tenant)

    def _written(self, collection: str, result: dict[str, Any], takedown: str | None = None) -> dict[str, Any]:
        self.box.note(collection, result["consistency_token"])
        if takedown and self.trail:
            self.trail.add(self.keys.name(self.key), collection, takedown, result)
        return result

    # role read

    def search(self, collection: str, request: dict[str, Any]) -> DataFrame:
        return self._open(collection, "read").search(request, after=self.box.tokens.get(collection))

    def get(self, collection: str, id_: Any) -> dict[str, Any] | None:
        return self._open(collection, "read").get(id_, "read_your_writes", self.box.tokens.get(collection))

    def status(self, collection: str) -> dict[str, Any]:
        return self._open(collection, "read").status()

    # role write

    def upsert(self, collection: str, documents: list[dict[str, Any]]) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "write").upsert(documents))

    def patch(self, collection: str, patches: list[dict[str, Any]]) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "write").patch(patches))

    # role takedown

    def delete(self, collection: str, ids: list[Any]) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "takedown").delete(ids), "delete")

    def delete_where(self, collection: str, spec: Any, ids: list[Any] | None = None) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "takedown").delete_where(spec, ids), "delete_where")

    def delete_by_parent(self, collection: str, parent_field: str, parent: Any) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "takedown").delete_by_parent(parent_field, parent), "delete_by_parent")

    def deletion_report(self, collection: str, ids: list[Any], secret: bytes | None = None) -> dict[str, Any]:
        return self._open(collection, "takedown").deletion_report(ids, self.box.tokens.get(collection), secret)

    # role admin

    def erase_tenant(self, collection: str, name: str) -> dict[str, Any]:
        return self._written(collection, self._open(collection, "admin").erase_tenant(name), "erase_tenant")

    def create(self, name: str, schema: list[dict[str, Any]], expires: str | None = None) -> Collection:
        self.keys.authorize(self.key, "admin", self.tenant)
        return self.catalog.create(name, schema, expires)

    def drop(self, name: str) -> None:
        self.keys.authorize(self.key, "admin", self.tenant)
        self.catalog.drop(name)

    def compact(self, collection: str, force: bool = False) -> bool:
        return self._open(collection, "admin").compact(force=force)
