"""Commands as a stream: each micro-batch becomes one commit, and a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..store import IDENTITY, Collection


def apply_batch(collection: Collection, commands: DataFrame, source: str, batch_id: int, id_col: str = "id", seq: str = "seq", op: str = "op") -> None:
    """commands: id, seq, op ('upsert' or 'delete') and the schema's columns. Each id's last command by seq decides it."""
    if collection.manifest().batches.get(source, -1) >= batch_id:
        return
    last = commands.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc(seq)))).where("_n = 1").drop("_n").persist()
    text = dict(last.dtypes)[id_col] == "string"
    gone = last.where(F.col(op) == "delete").select(
        F.lit(collection.tenant).cast("string").alias("_tenant"), (F.lit(None) if text else F.col(id_col)).cast("long").alias("_id"),
        (F.col(id_col) if text else F.lit(None)).cast("string").alias("_key"))
    collection.upsert_frame(last.where(F.col(op) == "upsert"), id_col, seq, batch=(source, batch_id), gone=gone.select(*IDENTITY))
    last.unpersist()


def follow(commands: DataFrame, collection: Collection, checkpoint: str, source: str = "commands", **columns: str) -> StreamingQuery:
    """Starts the stream; trigger availableNow, so that it ends with what is there."""
    run = lambda df, n: apply_batch(collection, df, source, n, **columns)
    return commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep_every(spark: SparkSession, collection: Collection, checkpoint: str, seconds: int) -> StreamingQuery:
    """Removes what has expired, time and again, until the query is stopped; a sweep that finds nothing writes nothing."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, n: collection.sweep() and None).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
