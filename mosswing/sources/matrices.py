"""Readers of the matrix files that vector benchmarks use: fvecs, ivecs, bvecs, fbin, ibin, u8bin, spmat; and TSV pairs.

Files are cut into ranges of whole rows, so that a large one is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

VECS = {"fvecs": ("<f4", 4), "ivecs": ("<i4", 4), "bvecs": ("u1", 1)}
BINS = {"fbin": ("<f4", 4), "ibin": ("<i4", 4), "u8bin": ("u1", 1), "i8bin": ("i1", 1)}
ROWS = 50_000


def _shape(path: str, kind: str) -> tuple[int, int, int]:
    """(rows, columns, bytes a row)."""
    import os

    with open(path, "rb") as f:
        head = np.frombuffer(f.read(8), dtype="<u4")
    if kind in BINS:
        return int(head[0]), int(head[1]), int(head[1]) * BINS[kind][1]
    width = 4 + int(head[0]) * VECS[kind][1]
    return os.path.getsize(path) // width, int(head[0]), width


def read_matrix(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """row (from 0) and vector; the file lies on a disk that all executors see."""
    kind = kind or path.rsplit(".", 1)[-1]
    if kind not in VECS | BINS:
        raise ValueError(f"no matrix format {kind!r}")
    rows, columns, width = _shape(path, kind)
    rows = rows if limit is None else min(rows, limit)
    dtype = (VECS | BINS)[kind][0]
    element = "float" if dtype.endswith("f4") else "int"
    starts = spark.range(0, max(1, -(-rows // ROWS))).repartition(max(1, -(-rows // ROWS)))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block in pdf["id"]:
                a, z = block * ROWS, min(rows, (block + 1) * ROWS)
                if a >= z:
                    continue
                with open(path, "rb") as f:
                    f.seek((8 if kind in BINS else 0) + a * width)
                    raw = np.frombuffer(f.read((z - a) * width), dtype=np.uint8).reshape(z - a, width)
                body = np.ascontiguousarray(raw[:, 4:] if kind in VECS else raw).view(dtype).reshape(z - a, columns)
                yield pd.DataFrame({"row": np.arange(a, z), "vector": list(body.astype(np.float32 if element == "float" else np.int32))})

    return starts.mapInPandas(load, f"row long, vector array<{element}>")


def read_spmat(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """row and tags of a sparse matrix in CSR form: sizes, row offsets, column indices."""
    with open(path, "rb") as f:
        n, _, _ = np.frombuffer(f.read(24), dtype="<i8")
    rows = int(n) if limit is None else min(int(n), limit)
    blocks = spark.range(0, max(1, -(-rows // ROWS)))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block in pdf["id"]:
                a, z = block * ROWS, min(rows, (block + 1) * ROWS)
                if a >= z:
                    continue
                with open(path, "rb") as f:
                    f.seek(24 + 8 * a)
                    at = np.frombuffer(f.read(8 * (z - a + 1)), dtype="<i8")
                    f.seek(24 + 8 * (int(n) + 1) + 4 * int(at[0]))
                    tags = np.frombuffer(f.read(4 * int(at[-1] - at[0])), dtype="<i4")
                yield pd.DataFrame({"row": np.arange(a, z), "tags": np.split(tags, (at[1:-1] - at[0]))})

    return blocks.mapInPandas(load, "row long, tags array<int>")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """id and text of tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="id long, text string", quote="")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """id and text of JSON lines."""
    return spark.read.schema("id long, text string").json(path)
