"""What the operators of this subpackage share: checkpoint folder, labelled samples, bounded batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; one of its own only on
    a single machine where it is unset, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="mosswing-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again; for wide rows of which later steps read a few columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/mosswing-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory of this process to the system: Spark's workers outlive their tasks, and what one operator
    left would add to the next one's needs."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def text_of(name: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled rows that `usable` admits, chosen by a hash of doc_id.

    Only this sample, never a score, uses labels. Its bound makes the broadcast of its ids safe.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "label")


def slices(frames: Iterator[pd.DataFrame], chars: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Frames with a column text cut into frames of about `chars` characters, whatever a batch holds; no text is cut."""
    for pdf in frames:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        at = np.cumsum(pdf["text"].str.len().to_numpy(dtype=np.int64)) // chars
        if at[-1] == at[0]:
            yield pdf
        else:
            for _, part in pdf.groupby(at):
                yield part.reset_index(drop=True)
