"""Versioned Parquet snapshots behind an ordered log of commits. A delete is final for every version from its commit on.

A commit writes Parquet files of upserts, their postings and tombstones, then publishes `manifest-<version>.json` by
one exclusive rename; a reader lists files only through a manifest, so it never sees half a commit, and a writer that
dies leaves nothing that blocks the next. All paths go through the Hadoop file system of the session, local or not.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.tokens import query_terms, tokens
from .operators import textindex
from .operators.bm25 import batch_scored
from .operators.knn import choose_route, exact_knn, ivf_centres, ivf_list, nearest_centres
from .operators.logfold import apply_patches
from .operators.search import search
from .plans.filters import And, Everything, Predicate, parse_filter, unexpired
from .plans.request import SearchRequest, parse_request
from .schema import Invalid, Schema, check_id

META = T.StructType([
    T.StructField("_tenant", T.StringType()), T.StructField("_id", T.LongType()), T.StructField("_key", T.StringType()),
    T.StructField("_seq", T.LongType(), False), T.StructField("_pos", T.LongType(), False)])
IDENTITY = ["_tenant", "_id", "_key"]
PLACE = [*IDENTITY, "_seq", "_pos"]
SMALL = 1_000_000  # ids that are broadcast at most; their number is read from the manifest
TASK_ROWS = 20_000  # of a clustered base
TOMBSTONE = T.StructType([*META.fields[:3], META["_seq"]])


class Conflict(RuntimeError):
    """Another writer published this version first, or a name is taken."""


class Files:
    """The few file system calls that commits need."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = self.jvm = spark.sparkContext._jvm
        self.gateway = spark.sparkContext._gateway
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root.rstrip("/")

    def create(self, name: str, text: str) -> None:
        """Writes under a temporary name, then publishes by one exclusive link or rename; fails if the name is taken."""
        target, temporary = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/.{uuid.uuid4().hex}")
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # its renames overwrite
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
                context.rename(temporary, target, self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            raise Conflict(name) from e
        finally:
            self.fs.delete(temporary, False)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        where = self.path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


@dataclass
class Manifest:
    """Folders of one version, the rows of each, the postings of each, and the lists that the bases' vectors are in."""

    version: int = 0
    bases: list[str] = field(default_factory=list)
    deltas: list[str] = field(default_factory=list)
    tombstones: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    terms: dict[str, str] = field(default_factory=dict)
    lists: dict[str, Any] = field(default_factory=dict)

    def count(self, folders: list[str]) -> int:
        return sum(self.rows.get(f, 0) for f in folders)


def parse_token(text: str | None) -> dict[int, int]:
    """`shard.index,...` as {shard: index}."""
    out: dict[int, int] = {}
    for part in filter(None, (text or "").split(",")):
        shard, dot, index = part.partition(".")
        if not dot or not shard.isdigit() or not index.isdigit():
            raise Invalid(f"{part!r} is no consistency token")
        out[int(shard)] = max(out.get(int(shard), 0), int(index))
    return out


def merge_tokens(*tokens: str | None) -> str:
    """The least token that is not older than any of these."""
    pairs = sorted(pair for t in tokens for pair in parse_token(t).items())
    return ",".join(f"{shard}.{index}" for shard, index in dict(pairs).items())  # the last of a shard is its greatest


class Collection:
    """One collection's documents: ordered writes, searches on a pinned version, patches, retention, proofs."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema, shard: int = 0, expires: str | None = None, tenant: str | None = None, clock=None) -> None:
        if expires is not None and schema[expires].kind not in ("date", "i64"):
            raise Invalid("a retention field is a date or an integer")
        self.spark, self.root, self.schema, self.shard, self.expires, self.tenant = spark, root.rstrip("/"), schema, shard, expires, tenant
        self.files = Files(spark, root)
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._seen: Manifest | None = None

    def for_tenant(self, name: str) -> Collection:
        """A view on one tenant: its ids are its own, and every read and write is restricted to it."""
        if not 1 <= len(name) <= 128 or not all(c.isalnum() and c.isascii() or c in "_.-" for c in name):
            raise Invalid(f"{name!r} is no tenant name")
        return Collection(self.spark, self.root, self.schema, self.shard, self.expires, name, self.clock)

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names() if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, consistency: str = "linearizable", after: str | None = None) -> Manifest:
        """linearizable: the newest; read_your_writes: not older than the token; stale: what was last seen."""
        if consistency not in ("linearizable", "read_your_writes", "stale"):
            raise Invalid(f"no consistency {consistency!r}")
        wanted = parse_token(after).get(self.shard, 0)
        seen = self._seen
        if seen is None or consistency == "linearizable" or consistency == "read_your_writes" and seen.version < wanted:
            newest = max(self.versions(), default=0)
            seen = Manifest(**json.loads(self.files.read(f"manifest-{newest}.json"))) if newest else Manifest()
            self._seen = seen
        if seen.version < wanted and consistency == "read_your_writes":
            raise Invalid(f"token {after} lies ahead of this collection")
        return seen

    def _publish(self, new: Manifest) -> str:
        self.files.create(f"manifest-{new.version}.json", json.dumps(new.__dict__))
        self._seen = new
        return f"{self.shard}.{new.version}"

    def row_type(self) -> T.StructType:
        return T.StructType([*META.fields, *self.schema.struct().fields])

    def _texts(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.kind == "text"]

    def _stored_type(self, clustered: bool = False) -> T.StructType:
        more = [T.StructField(f"_len_{t}", T.IntegerType()) for t in self._texts()] + [T.StructField("_list", T.IntegerType())] * clustered
        return T.StructType([*self.row_type().fields, *more])

    def _read(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def _live(self, m: Manifest) -> DataFrame:
        """The rows of one version, with _list (null outside the bases).

        Only the deltas are ranked; a base row needs no more than that no later write or delete names it, so filters
        reach the base's scan and nothing of it is shuffled while what was written since is small.
        """
        clustered = bool(m.lists)
        base = self._read(m.bases, self._stored_type(clustered))
        base = base if clustered else base.withColumn("_list", F.lit(None).cast("int"))
        if not m.deltas and not m.tombstones:
            return base
        deltas = self._read(m.deltas, self._stored_type())
        last = Window.partitionBy(*IDENTITY).orderBy(F.desc("_seq"), F.desc("_pos"))
        fresh = deltas.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn("_list", F.lit(None).cast("int"))
        gone = self._read(m.tombstones, TOMBSTONE)
        small = m.count([*m.deltas, *m.tombstones]) <= SMALL
        sized = F.broadcast if small else (lambda df: df)
        if m.tombstones:
            late = sized(gone.groupBy(*IDENTITY).agg(F.max("_seq").alias("_gone")))
            fresh = fresh.join(late, [*[fresh[c].eqNullSafe(late[c]) for c in IDENTITY], late["_gone"] > fresh["_seq"]], "left_anti")
        touched = sized(deltas.select(*IDENTITY).unionAll(gone.select(*IDENTITY)))
        kept = base.join(touched, [base[c].eqNullSafe(touched[c]) for c in IDENTITY], "left_anti")
        return kept.unionByName(fresh)

    def _own(self) -> Column | None:
        return None if self.tenant is None else F.col("_tenant") == self.tenant

    def _visible(self, m: Manifest, expired: bool = False) -> DataFrame:
        rows = self._live(m)
        if (own := self._own()) is not None:
            rows = rows.where(own)
        if self.expires and not expired:
            rows = rows.where(unexpired(self.expires, self.clock()).column())
        return rows.withColumn("_ord", self._order())

    def _order(self) -> Column:
        """Integer ids by value, then text ids by their last write; the tenant and the key make it unique."""
        keyed = F.col("_key").isNotNull()
        return F.struct(
            keyed.alias("keyed"), F.when(keyed, self.shard).otherwise(0).alias("shard"), F.when(keyed, F.col("_seq")).otherwise(F.col("_id")).alias("n"),
            F.when(keyed, F.col("_pos")).otherwise(0).alias("pos"), F.coalesce("_tenant", F.lit("")).alias("tenant"), F.coalesce("_key", F.lit("")).alias("key"))

    def snapshot(self, consistency: str = "linearizable", after: str | None = None, expired: bool = False) -> DataFrame:
        """Live rows of one version, with _ord to sort by. Without a tenant: those of all tenants, told apart by _tenant."""
        return self._visible(self.manifest(consistency, after), expired)

    # writes

    def _write_rows(self, rows: DataFrame, folder: str, new: Manifest, clustered: bool = False) -> None:
        """Rows with the lengths of their texts, then the postings of those texts, read from the rows just written; none
        are written where the manifest has them already."""
        lengths = {f"_len_{t}": F.size(tokens(t)) for t in self._texts() if f"_len_{t}" not in rows.columns}
        out = rows.withColumns(lengths) if lengths else rows
        writer = out.select(*self._stored_type(clustered).names).write
        (writer.partitionBy("_list") if clustered else writer).parquet(f"{self.root}/{folder}")
        written = self._read([folder], self._stored_type(clustered))
        new.rows[folder], *words = written.agg(F.count("*"), *[F.sum(f"_len_{t}").alias(f"_{i}") for i, t in enumerate(self._texts())]).first()
        if self._texts() and folder not in new.terms:
            terms = folder.rsplit("-", 1)[0] + "-terms"
            textindex.write(written, PLACE, {t: n or 0 for t, n in zip(self._texts(), words)}, f"{self.root}/{terms}")
            new.terms[folder] = terms

    def _next(self, m: Manifest) -> tuple[Manifest, str]:
        new = Manifest(m.version + 1, list(m.bases), list(m.deltas), list(m.tombstones), dict(m.batches), dict(m.rows), dict(m.terms), dict(m.lists))
        return new, f"data/{m.version + 1}-{uuid.uuid4().hex[:12]}"

    def _commit(self, rows: DataFrame | None, gone: DataFrame | None, after: str | None, batch: tuple[str, int] | None = None) -> str:
        """One version with upserts, deletes of earlier rows, or both."""
        new, folder = self._next(self.manifest())
        if rows is not None:
            self._write_rows(rows.withColumn("_seq", F.lit(new.version).cast("long")), f"{folder}-rows", new)
            new.deltas.append(f"{folder}-rows")
        if gone is not None:
            gone.select(*IDENTITY, F.lit(new.version).cast("long").alias("_seq")).write.parquet(f"{self.root}/{folder}-gone")
            new.tombstones.append(f"{folder}-gone")
            new.rows[f"{folder}-gone"] = self._read([f"{folder}-gone"], TOMBSTONE).count()
        if batch:
            new.batches[batch[0]] = batch[1]
        return merge_tokens(self._publish(new), after)

    def upsert(self, documents: list[dict[str, Any]], after: str | None = None) -> dict[str, Any]:
        """Whole documents; one that comes twice counts last. Integer ids are logged before text ids."""
        if not documents:
            raise Invalid("no documents are given")
        checked = [self.schema.document(d) for d in documents]
        checked = [d for d in checked if isinstance(d["id"], int)] + [d for d in checked if isinstance(d["id"], str)]
        rows = [
            {"_tenant": self.tenant, "_id": d["id"] if isinstance(d["id"], int) else None, "_key": d["id"] if isinstance(d["id"], str) else None, "_seq": 0, "_pos": i}
            | {k: v for k, v in d.items() if k != "id"}
            for i, d in enumerate(checked)
        ]
        token = self._commit(self.spark.createDataFrame([tuple(r[n] for n in self.row_type().names) for r in rows], self.row_type()), None, after)
        return {"count": len(documents), "consistency_token": token}

    def upsert_frame(
        self, df: DataFrame, id_col: str = "id", order: str | None = None, after: str | None = None, batch: tuple[str, int] | None = None,
        tenant_col: str | None = None, gone: DataFrame | None = None) -> dict[str, Any]:
        """Documents of a DataFrame with the schema's columns; the id is an integer or a string column.

        count is how many were written, rejected how many were not: those with a null id, a vector of another length
        or components that are not finite. `order` decides between rows of one id, and where text ids sort; equal ones
        are told apart by their place. tenant_col, on a view of all tenants, names the column with each row's tenant.
        """
        if tenant_col and self.tenant is not None:
            raise Invalid("a tenant's own view writes that tenant's rows")
        text_id = isinstance(df.schema[id_col].dataType, T.StringType)
        ok = F.col(id_col).isNotNull()
        for f in self.schema.fields:
            if f.kind == "vector":
                finite = F.forall(f.name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                ok = ok & (F.col(f.name).isNull() | ((F.size(f.name) == f.dims) & finite))
        columns = {f.name: (F.array_sort(F.array_distinct(f.name)) if f.kind == "set" else F.col(f.name)).cast(f.spark_type) for f in self.schema.fields}
        seen = Observation()
        counted = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).observe(seen, F.count_if("_ok").alias("good"), F.count_if(~F.col("_ok")).alias("bad"))
        rows = counted.where("_ok").select(
            (F.col(tenant_col) if tenant_col else F.lit(self.tenant)).cast("string").alias("_tenant"),
            (F.lit(None) if text_id else F.col(id_col)).cast("long").alias("_id"), (F.col(id_col) if text_id else F.lit(None)).cast("string").alias("_key"),
            (F.col(order).cast("long") if order else F.monotonically_increasing_id()).alias("_pos"), *[c.alias(n) for n, c in columns.items()])
        token = self._commit(rows, gone, after, batch)
        return {"count": seen.get["good"], "rejected": seen.get["bad"], "consistency_token": token}

    def _identities(self, ids: Iterable[Any]) -> DataFrame:
        rows = [(self.tenant, i if isinstance(i, int) else None, i if isinstance(i, str) else None, 0) for i in map(check_id, ids)]
        return self.spark.createDataFrame(rows, TOMBSTONE)

    def delete(self, ids: list[Any], after: str | None = None) -> dict[str, Any]:
        """count is how many ids were given, whether they existed or not."""
        if not ids:
            raise Invalid("no ids are given")
        return {"count": len(ids), "consistency_token": self._commit(None, self._identities(ids), after)}

    def delete_where(self, spec: Any, ids: list[Any] | None = None, after: str | None = None) -> dict[str, Any]:
        """Rows that match now; later writes are not touched. count is how many were removed."""
        if ids is not None and not ids:
            raise Invalid("no ids are given")
        predicate = spec if isinstance(spec, Predicate) else parse_filter(spec, self.schema)
        if ids is None and (isinstance(predicate, Everything) or predicate == And(())):
            raise Invalid("a delete needs a filter that isn't everything")
        rows = self.snapshot(expired=True).where(predicate.column())
        if ids is not None:
            named = self._identities(ids).select(*IDENTITY)
            rows = rows.join(named, [rows[c].eqNullSafe(named[c]) for c in IDENTITY], "left_semi")
        return self._remove(rows, after)

    def _remove(self, rows: DataFrame, after: str | None) -> dict[str, Any]:
        gone = rows.select(*IDENTITY).cache()
        count = gone.count()
        token = self._commit(None, gone, after) if count else merge_tokens(f"{self.shard}.{self.manifest().version}", after)
        gone.unpersist()
        return {"count": count, "consistency_token": token}

    def delete_by_parent(self, parent_field: str, parent: Any, after: str | None = None) -> dict[str, Any]:
        return self.delete_where({"field": parent_field, "eq": parent}, after=after)

    def replace_revision(self, documents: list[dict[str, Any]], parent_field: str, parent: Any, rev_field: str, rev: Any) -> str:
        """A parent's new parts, then the removal of all its parts of another revision; the parent is never missing."""
        token = self.upsert(documents)["consistency_token"]
        old = {"and": [{"field": parent_field, "eq": parent}, {"not": {"field": rev_field, "eq": rev}}]}
        return self.delete_where(old, after=token)["consistency_token"]

    def erase_tenant(self, name: str) -> dict[str, Any]:
        if self.tenant is not None:
            raise Invalid("a tenant's own view can't erase tenants")
        return self._remove(self.for_tenant(name).snapshot(expired=True), None)

    def patch(self, patches: list[dict[str, Any]], after: str | None = None) -> dict[str, Any]:
        """Each {id, set: {field: value or null}} in order; missing and expired documents are skipped."""
        if not patches:
            raise Invalid("no patches are given")
        merged: dict[Any, dict[str, Any]] = {}
        for p in patches:
            if set(p) - {"id", "set"}:
                raise Invalid("a patch has an id and set")
            values = {k: self.schema.value(k, v) for k, v in p.get("set", {}).items()}
            merged.setdefault(check_id(p["id"]), {}).update(values)
        names = [f.name for f in self.schema.fields]
        fields = [T.StructField(f"set_{n}", T.BooleanType()) for n in names] + [T.StructField(f"new_{n}", self.schema[n].spark_type) for n in names]
        rows = [(self.tenant, i if isinstance(i, int) else None, i if isinstance(i, str) else None, at, *[n in v for n in names], *[v.get(n) for n in names]) for at, (i, v) in enumerate(merged.items())]
        wanted = self.spark.createDataFrame(rows, T.StructType([*META.fields[:3], T.StructField("_pos", T.LongType()), *fields]))
        live = self.snapshot().drop("_pos")
        joined = live.join(F.broadcast(wanted), [live[c].eqNullSafe(wanted[c]) for c in IDENTITY])  # as many rows as patches
        new = joined.select(*[live[c] for c in IDENTITY], "_pos", *[F.when(F.col(f"set_{n}"), F.col(f"new_{n}")).otherwise(live[n]).alias(n) for n in names]).cache()
        count = new.count()
        token = self._commit(new, None, after) if count else merge_tokens(f"{self.shard}.{self.manifest().version}", after)
        new.unpersist()
        return {"patched": count, "consistency_token": token}

    def patch_frame(self, patches: DataFrame, id_col: str = "id", seq: str = "seq", after: str | None = None) -> dict[str, Any]:
        """Patches of a DataFrame (see apply_patches): columns id, seq, and set_f with f for each field f it names."""
        names = [f.name for f in self.schema.fields if f"set_{f.name}" in patches.columns]
        who = "_key" if isinstance(patches.schema[id_col].dataType, T.StringType) else "_id"
        named = patches.where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, who)
        mine = self.snapshot().where(F.lit(True) if self.tenant else F.col("_tenant").isNull())
        live = mine.join(named.select(who).distinct(), who, "left_semi")
        new = apply_patches(live, named, who, names, seq)
        before = self.manifest().version
        token = self._commit(new.select(*self.row_type().names), None, after)
        m = self.manifest("stale")
        return {"patched": m.rows[m.deltas[-1]] if m.version > before else 0, "consistency_token": token}

    def sweep(self, now: int | None = None) -> dict[str, Any]:
        """Removes what has expired; writes nothing if nothing has."""
        if not self.expires:
            return {"count": 0, "consistency_token": f"{self.shard}.{self.manifest().version}"}
        late = self.snapshot(expired=True).where(F.col(self.expires) <= (self.clock() if now is None else now))
        return self._remove(late, None)

    def compact(self, share: float = 0.3, deltas: int = 8, force: bool = False) -> bool:
        """Rewrites the live rows as one base if what was written since is more than `share` of all rows.

        Else, if there are more than `deltas` folders of writes or deletes, merges only those, and leaves the bases as
        they are. Old files stay for older versions.
        """
        m = self.manifest()
        since = m.count([*m.deltas, *m.tombstones])
        if force or since > share * max(1, m.count([*m.bases, *m.deltas])):
            self._rewrite(m, m.lists)
            return True
        if len(m.deltas) <= deltas and len(m.tombstones) <= deltas:
            return False
        new, folder = self._next(m)
        new.deltas, new.tombstones = [], []
        if m.deltas:
            fresh = self._live(Manifest(m.version, [], m.deltas, m.tombstones, rows=m.rows))
            self._write_rows(fresh.select(*self.row_type().names), f"{folder}-rows", new)
            new.deltas = [f"{folder}-rows"]
        if m.tombstones or m.deltas:
            # what the merged deltas no longer hold must stay hidden in the bases
            gone = self._read(m.tombstones, TOMBSTONE).groupBy(*IDENTITY).agg(F.max("_seq").alias("_seq"))
            gone.write.parquet(f"{self.root}/{folder}-gone")
            new.tombstones = [f"{folder}-gone"]
            new.rows[f"{folder}-gone"] = self._read(new.tombstones, TOMBSTONE).count()
        self._publish(self._named(new))
        return True

    def _named(self, m: Manifest) -> Manifest:
        folders = {*m.bases, *m.deltas, *m.tombstones}
        m.rows = {f: n for f, n in m.rows.items() if f in folders}
        m.terms = {f: t for f, t in m.terms.items() if f in folders}
        return m

    def _rewrite(self, m: Manifest, lists: dict[str, Any]) -> None:
        m = self._settled(m)
        new, folder = self._next(m)
        new.bases, new.deltas, new.tombstones, new.lists = [f"{folder}-base"], [], [], lists
        whole = len(m.bases) == 1 and not m.deltas and not m.tombstones
        if whole and not lists and not m.lists:
            new.bases = m.bases  # its files are this base
        else:
            rows = self._live(m)
            if lists:
                at = ivf_list(lists["field"], self._centres(lists), self.schema[lists["field"]].metric)
                # some TASK_ROWS a task, of rows without a vector too; lists are split as far as one holds four times its share
                count, n = m.count([*m.bases, *m.deltas]), lists["lists"]
                plain, parts = 1 + count // TASK_ROWS, 1 + 4 * count // (n * TASK_ROWS)
                part = lambda of: F.pmod(F.xxhash64(*IDENTITY), F.lit(of)).cast("int")
                place = F.when(F.col("_list") < 0, part(plain)).otherwise(plain + F.col("_list") * parts + part(parts))
                tasks = min(plain + n * parts, 1 + count // 1000)
                rows = rows.withColumn("_list", at).repartitionById(tasks, F.pmod(place, F.lit(tasks)))
            if whole and m.bases[0] in m.terms:
                new.terms[f"{folder}-base"] = m.terms[m.bases[0]]  # the same rows in the same places
            self._write_rows(rows, f"{folder}-base", new, bool(lists))
        self._publish(self._named(new))

    def _settled(self, m: Manifest) -> Manifest:
        """m, or where it is one write and no id comes twice in that, the same with it as the base: nothing is to rank."""
        if m.bases or m.tombstones or len(m.deltas) != 1:
            return m
        ids = self._read(m.deltas, META).groupBy(*IDENTITY).count()
        return replace(m, bases=m.deltas, deltas=[]) if ids.where("count > 1").isEmpty() else m

    def cluster(self, field: str, lists: int, sample: int = 50_000) -> None:
        """Rewrites the base by inverted lists of a vector field: centres from a bounded sample, a folder a list.

        Vector legs on that field then read the lists nearest to the query, and all rows written since.
        """
        f = self.schema[field]
        if f.kind != "vector":
            raise Invalid(f"{field} is no vector field")
        m = self._settled(self.manifest())
        centres = ivf_centres(self._live(m), field, f.metric, lists, sample)
        if not centres:
            return
        where = f"data/{m.version + 1}-{uuid.uuid4().hex[:12]}-centres"
        self.spark.createDataFrame(list(enumerate(centres)), "list int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/{where}")
        self._rewrite(m, {"field": field, "centres": where, "lists": len(centres)})

    def _centres(self, lists: dict[str, Any]) -> list[list[float]]:
        rows = self.spark.read.parquet(f"{self.root}/{lists['centres']}").orderBy("list").collect()  # as many as lists
        return [list(r["centre"]) for r in rows]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes files that none of the newest `keep` versions names; only then are removed rows gone from disk."""
        versions = self.versions()
        kept = [Manifest(**json.loads(self.files.read(f"manifest-{v}.json"))) for v in versions[-keep:]]
        named = {f.split("/")[1] for m in kept for f in (*m.bases, *m.deltas, *m.tombstones, *m.terms.values(), *([m.lists["centres"]] if m.lists else []))}
        old = [n for n in self.files.names("data") if n not in named]
        for name in old:
            self.files.delete(f"data/{name}")
        for v in versions[:-keep]:
            self.files.delete(f"manifest-{v}.json")
        return len([n for n in old if not n.endswith(("-terms", "-centres"))])

    def changes(self, since: int) -> tuple[DataFrame, DataFrame] | None:
        """(rows, deletes) written after version `since`, for a follower; None if a compaction has merged some of them,
        so that it has to begin with a snapshot."""
        m = self.manifest()
        first = lambda f: int(f.split("/")[1].split("-")[0])
        if any(first(f) > since for f in m.bases) or since > m.version:
            return None
        rows = self._read([f for f in m.deltas if first(f) > since], self._stored_type())
        return rows.where(F.col("_seq") > since), self._read([f for f in m.tombstones if first(f) > since], TOMBSTONE).where(F.col("_seq") > since)

    # reads

    def get(self, id_: Any, consistency: str = "linearizable", after: str | None = None) -> dict[str, Any] | None:
        id_ = check_id(id_)
        rows = self.snapshot(consistency, after).where(F.col("_id") == id_ if isinstance(id_, int) else F.col("_key") == id_)
        row = rows.where(F.lit(True) if self.tenant else F.col("_tenant").isNull()).first()
        return None if row is None else {"id": id_} | {f.name: row[f.name] for f in self.schema.fields}

    def search(self, request: SearchRequest | dict[str, Any], consistency: str | None = None, after: str | None = None, digits: int | None = None) -> DataFrame:
        """Hits with _id, _key and _tenant. Text legs read the stored postings of their terms; vector legs, unless the
        request is exact, the lists nearest to the query if the base is clustered and the filter passes many rows."""
        request = request if isinstance(request, SearchRequest) else parse_request(request, self.schema)
        m = self.manifest(consistency or ("read_your_writes" if after else "linearizable"), after)
        rows = self._visible(m)
        by_terms = lambda leg, depth, where, digits: self._text_leg(m, rows, leg, depth, where, digits)
        by_lists = lambda leg, depth, where, digits: self._vector_leg(m, rows, leg, depth, where, digits, request.exact)
        found = search(rows, request, self.schema, "_ord", digits=digits, text_leg=by_terms, vector_leg=by_lists)
        ids = rows.select(F.col("_ord").alias("id"), "_id", "_key", "_tenant")
        return ids.join(F.broadcast(found), "id").orderBy(F.desc("score"), "id").drop("id")  # at most k hits

    def _text_leg(self, m: Manifest, rows: DataFrame, leg: Any, depth: int, where: Column | None, digits: int | None) -> DataFrame:
        folders = [f"{self.root}/{m.terms[f]}" for f in (*m.bases, *m.deltas) if f in m.terms]
        terms = query_terms(leg.query)
        if not folders or not terms:
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", rows.schema["_ord"].dataType), T.StructField("score", T.DoubleType())]))
        found = textindex.read(self.spark, folders, leg.field, terms, META)
        length = F.col(f"_len_{leg.field}")
        passes = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        if not m.deltas and not m.tombstones and self.tenant is None and not self.expires and where is None:
            found = found.withColumns({"id": self._order(), "passes": F.lit(True)})  # every posting is of a live row
        else:
            live = rows.select(*[F.col(c).alias(f"l{c}") for c in PLACE], F.col("_ord").alias("id"), passes.alias("passes"))
            found = found.join(live, [F.col(c).eqNullSafe(F.col(f"l{c}")) for c in PLACE])
        stats = rows.agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.count_if(length > 0)).alias("some"), F.sum(length.cast("long")).alias("all"))
        return textindex.scored(found, stats, depth, len(terms) if leg.match_all else 1, digits=digits)

    def batch_text(self, field: str, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
        """query_id, rank, id, score for a table of queries (query_id, text) by the stored postings; integer ids only."""
        m = self.manifest()
        rows = self._visible(m).where("_id is not null")
        found = textindex.read(self.spark, [f"{self.root}/{t}" for t in m.terms.values()], field, None, META)
        if m.deltas or m.tombstones or self.tenant is not None or self.expires:
            live = rows.select(*[F.col(c).alias(f"l{c}") for c in PLACE])
            found = found.join(live, [F.col(c).eqNullSafe(F.col(f"l{c}")) for c in PLACE], "left_semi")
        length = F.col(f"_len_{field}")
        stats = rows.agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.count_if(length > 0)).alias("some"), F.sum(length.cast("long")).alias("all"))
        return batch_scored(found.withColumnRenamed("_id", "id"), stats, queries, k, digits=digits)

    def _vector_leg(self, m: Manifest, rows: DataFrame, leg: Any, depth: int, where: Column | None, digits: int | None, exact: bool) -> DataFrame:
        metric = self.schema[leg.field].metric
        if m.lists and m.lists["field"] == leg.field and not exact:
            passing = rows.where(where).count() if where is not None else m.count([*m.bases, *m.deltas])
            if choose_route(passing, m.count([*m.bases, *m.deltas])) == "ivf":
                near = nearest_centres(self._centres(m.lists), list(leg.vector), metric, probes(leg.ef or max(64, depth), m.lists["lists"]))
                rows = rows.where(F.col("_list").isin(near) | F.col("_list").isNull())
        return exact_knn(rows, "_ord", leg.field, list(leg.vector), metric, depth, where, digits)

    def status(self) -> dict[str, Any]:
        m = self.manifest()
        return {"version": m.version, "bases": len(m.bases), "deltas": len(m.deltas), "tombstones": len(m.tombstones)}

    # proofs

    def presence(self, ids: DataFrame, id_col: str = "id", m: Manifest | None = None) -> DataFrame:
        """id, verdict of each id of a DataFrame: 'not proven' if the newest version still shows it in any layer."""
        who = "_key" if isinstance(ids.schema[id_col].dataType, T.StringType) else "_id"
        live = self._live(m or self.manifest()).where(F.col("_tenant").eqNullSafe(F.lit(self.tenant))).select(F.col(who).alias("_there")).where("_there is not null")
        joined = ids.join(live, ids[id_col] == F.col("_there"), "left")
        return joined.select(ids[id_col].alias("id"), F.when(F.col("_there").isNotNull(), "not proven").otherwise("deleted").alias("verdict"))

    def deletion_report(self, ids: list[Any], after: str | None = None, secret: bytes | None = None) -> dict[str, Any]:
        """For each id whether any layer of the newest version (not older than the token) still shows it.

        Signed, if a secret is given, by HMAC-SHA256 over the sorted compact JSON: whoever verifies holds the secret.
        """
        if not 1 <= len(ids) <= 10_000:
            raise Invalid("1 to 10000 ids are needed")
        m = self.manifest("linearizable", after)
        if m.version < parse_token(after).get(self.shard, 0):
            raise Invalid("the token lies ahead of this collection")
        present: set[Any] = set()
        for kind, spark_type in ((int, "long"), (str, "string")):
            some = [(i,) for i in map(check_id, ids) if isinstance(i, kind)]
            if some:
                found = self.presence(self.spark.createDataFrame(some, f"id {spark_type}"), m=m).where("verdict <> 'deleted'")
                present |= {r["id"] for r in found.select("id").distinct().collect()}
        verdicts = [{"id": i, "verdict": "not proven" if i in present else "deleted"} | ({"reason": "the document is live"} if i in present else {}) for i in ids]
        report: dict[str, Any] = {"documents": verdicts, "overall": "not proven" if present else "deleted everywhere", "token": f"{self.shard}.{m.version}"}
        return report if secret is None else report | {"hmac_sha256": sign(report, secret)}


def probes(ef: int, lists: int) -> int:
    """How many lists stand for a beam of `ef` candidates: one for every eight, at least four."""
    return min(lists, max(4, -(-ef // 8)))


def sign(report: dict[str, Any], secret: bytes) -> str:
    body = {k: v for k, v in report.items() if k != "hmac_sha256"}
    return hmac.new(secret, json.dumps(body, sort_keys=True, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()


def verify(report: dict[str, Any], secret: bytes) -> bool:
    return hmac.compare_digest(report.get("hmac_sha256", ""), sign(report, secret))
