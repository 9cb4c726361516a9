"""A durable log of commands: segments of Parquet, each published by one exclusive manifest, with a checksum a row."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import Files


class CommandLog:
    """Rows have a position `seq` that rises from segment to segment; a segment is visible whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def segments(self) -> list[dict]:
        names = sorted(n for n in self.files.names("segments") if n.endswith(".json") and not n.startswith("."))
        return [json.loads(self.files.read(f"segments/{n}")) | {"name": n} for n in names]

    @property
    def last(self) -> int:
        return max((s["last"] for s in self.segments()), default=-1)

    def append(self, commands: DataFrame, seq: str = "seq") -> int:
        """Writes a segment; its positions must lie after all others. Returns the last position."""
        folder = f"data/{uuid.uuid4().hex}"
        commands.withColumn("_crc", _crc(commands)).write.parquet(f"{self.root}/{folder}")
        low, high = self.spark.read.parquet(f"{self.root}/{folder}").agg(F.min(seq), F.max(seq)).first()
        if low is None:
            self.files.delete(folder)
            return self.last
        before = self.segments()
        if before and low <= before[-1]["last"]:
            self.files.delete(folder)
            raise ValueError(f"position {low} is not after {before[-1]['last']}")
        number = int(before[-1]["name"][:12]) + 1 if before else 0
        self.files.create(f"segments/{number:012d}.json", json.dumps({"folder": folder, "first": low, "last": high, "seq": seq}))
        return high

    def read_range(self, first: int, last: int | None = None, check: bool = True) -> DataFrame | None:
        """Commands at positions first to last; segments outside are not opened. A row that fails its checksum ends the job."""
        held = [s for s in self.segments() if s["last"] >= first and (last is None or s["first"] <= last)]
        if not held:
            return None
        rows = self.spark.read.parquet(*[f"{self.root}/{s['folder']}" for s in held]).where(F.col(held[0]["seq"]) >= first)
        rows = rows if last is None else rows.where(F.col(held[0]["seq"]) <= last)
        good = F.when(F.col("_crc") == _crc(rows.drop("_crc")), True).otherwise(F.raise_error(F.lit("a command fails its checksum")).cast("boolean"))
        return (rows.where(good) if check else rows).drop("_crc")

    def truncate(self, before: int) -> int:
        """Drops whole segments that end before a position; returns how many."""
        old = [s for s in self.segments() if s["last"] < before]
        for s in old:
            self.files.delete(f"segments/{s['name']}")
            self.files.delete(s["folder"])
        return len(old)


def _crc(df: DataFrame) -> Column:
    return F.crc32(F.to_json(F.struct(*df.columns)))
