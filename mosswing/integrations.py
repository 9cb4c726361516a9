"""Vector stores in the shapes that retrieval frameworks expect, without depending on any of them.

Embeddings come from a function of a list of texts; metadata are the collection's other fields.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from .functions.distance import relevance, similarity
from .plans.filters import all_of, condition
from .store import Collection

Embed = Callable[[list[str]], list[list[float]]]


@dataclass
class Document:
    """A text with its metadata, as chains pass it on."""

    page_content: str
    metadata: dict[str, Any] = field(default_factory=dict)
    id: Any = None


class TextStore:
    """Adds, deletes and finds texts; a filter is the engine's JSON or the short form {field: value}."""

    def __init__(self, collection: Collection, embed: Embed, text_field: str = "text", vector_field: str = "embedding") -> None:
        self.collection, self.embed, self.text, self.vector = collection, embed, text_field, vector_field
        self.metric = collection.schema[vector_field].metric

    def add_texts(self, texts: Iterable[str], metadatas: list[dict[str, Any]] | None = None, ids: list[Any] | None = None) -> list[Any]:
        texts = list(texts)
        ids = ids or [uuid.uuid4().hex for _ in texts]
        more = metadatas or [{}] * len(texts)
        vectors = self.embed(texts)
        self.collection.upsert([m | {"id": i, self.text: t, self.vector: v} for i, t, v, m in zip(ids, texts, vectors, more, strict=True)])
        return ids

    def delete(self, ids: list[Any] | None = None, where: dict[str, Any] | None = None) -> int:
        if ids is not None and where is None:
            return self.collection.delete(ids)["count"]
        return self.collection.delete_where(_spec(where), ids)["count"]

    def get_by_ids(self, ids: list[Any]) -> list[Document]:
        found = ((i, self.collection.get(i)) for i in ids)
        return [self._document(i, d) for i, d in found if d is not None]

    def similarity_search(self, query: str, k: int = 4, filter: dict[str, Any] | None = None) -> list[Document]:
        return [d for d, _ in self.similarity_search_with_score(query, k, filter)]

    def similarity_search_by_vector(self, vector: list[float], k: int = 4, filter: dict[str, Any] | None = None) -> list[Document]:
        return [d for d, _ in self._search({"vectors": [{"field": self.vector, "vector": vector}], "k": k}, filter, "score")]

    def similarity_search_with_score(self, query: str, k: int = 4, filter: dict[str, Any] | None = None) -> list[tuple[Document, float]]:
        """With the leg's distance."""
        return self._search({"vectors": [{"field": self.vector, "vector": self.embed([query])[0]}], "k": k}, filter, "distance")

    def similarity_search_with_relevance_scores(self, query: str, k: int = 4, filter: dict[str, Any] | None = None) -> list[tuple[Document, float]]:
        return self._search({"vectors": [{"field": self.vector, "vector": self.embed([query])[0]}], "k": k}, filter, "relevance")

    def hybrid_search(self, query: str, k: int = 4, filter: dict[str, Any] | None = None, fusion: dict[str, Any] | None = None, group_by: str | None = None) -> list[tuple[Document, float]]:
        body = {"vectors": [{"field": self.vector, "vector": self.embed([query])[0]}], "text": {"field": self.text, "query": query}, "k": k, "group_by": group_by}
        return self._search(body | ({"fusion": fusion} if fusion else {}), filter, "score")

    def _search(self, body: dict[str, Any], where: dict[str, Any] | None, score: str) -> list[tuple[Document, float]]:
        found = self.collection.search(body | ({"filter": _spec(where)} if where else {}))
        raw = F.col("legs")[0]["score"]
        shown = {"score": F.col("score"), "distance": raw, "relevance": relevance(self.metric, raw), "similarity": similarity(self.metric, raw)}[score]
        rows = found.withColumn("_shown", shown).collect()  # at most k
        return [(self._document(r["_id"] if r["_id"] is not None else r["_key"], r["doc"].asDict()), r["_shown"]) for r in rows]

    def _document(self, id_: Any, fields: dict[str, Any]) -> Document:
        rest = {k: v for k, v in fields.items() if k not in (self.text, self.vector, "id") and v is not None}
        return Document(fields[self.text] or "", rest, id_)


class NodeStore:
    """Nodes of parent documents: (id, text, embedding, parent, metadata); filters are (field, operator, value)."""

    def __init__(self, collection: Collection, text_field: str = "text", vector_field: str = "embedding", parent_field: str = "parent") -> None:
        self.collection, self.text, self.vector, self.parent = collection, text_field, vector_field, parent_field
        self.metric = collection.schema[vector_field].metric

    def add(self, nodes: list[dict[str, Any]]) -> list[Any]:
        rename = {"text": self.text, "embedding": self.vector, "parent": self.parent}
        self.collection.upsert([{rename.get(k, k): v for k, v in (n | n.get("metadata", {})).items() if k != "metadata"} for n in nodes])
        return [n["id"] for n in nodes]

    def delete(self, parent: Any) -> int:
        return self.collection.delete_by_parent(self.parent, parent)["count"]

    def delete_nodes(self, ids: list[Any]) -> int:
        return self.collection.delete(ids)["count"]

    def query(self, vector: list[float] | None = None, text: str | None = None, k: int = 2, filters: list[tuple[str, str, Any]] = (), any_of: bool = False) -> list[tuple[Any, float, dict[str, Any]]]:
        """(id, similarity or fused score, fields): by vector, by text, or by both."""
        tests = [condition(*f) for f in filters]
        body: dict[str, Any] = {"k": k} | ({"filter": {"or" if any_of else "and": tests}} if tests else {})
        if vector is not None:
            body["vectors"] = [{"field": self.vector, "vector": vector}]
        if text is not None:
            body["text"] = {"field": self.text, "query": text}
        raw = F.col("legs")[0]["score"]
        shown = F.col("score") if text is not None and vector is not None else raw if text is not None else similarity(self.metric, raw)
        rows = self.collection.search(body).withColumn("_shown", shown).collect()  # at most k
        return [(r["_id"] if r["_id"] is not None else r["_key"], r["_shown"], r["doc"].asDict()) for r in rows]


def _spec(where: dict[str, Any] | None) -> dict[str, Any] | None:
    if where is None or where.keys() & {"and", "or", "not", "field"}:
        return where
    return all_of(where)
