"""Best-fit packing planned on a length histogram; pieces take planned slots by their rank within a length."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, stored, table, text_of

END = 2
TOKENIZER = "byte_bpe_50k"
PLAN = ["length", "low", "high", "first", "offset"]
BROADCAST = 4_000_000
IDS = 1_000_000

_OTHER = re.compile("[ɐ-\U0010ffff]|<\\|")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str):
    """The tokenizer that defines the ids, and a faster one with the same vocabulary (see _plain)."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Tokenizer.from_file(json_path), tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _plain(text: str) -> bool:
    """Letters up to Latin Extended-B and no special token: there both libraries split words alike, in any version."""
    return "<|" not in text if text.isascii() else not _OTHER.search(text)


def token_ids(text: str, json_path: str, ranks_path: str) -> np.ndarray:
    """The ids of a whole text, then END."""
    exact, fast = _encoders(json_path, ranks_path)
    ids = fast.encode_ordinary(text) if _plain(text) else exact.encode(text, add_special_tokens=False).ids
    ids.append(END)
    return np.frombuffer(array("I", ids), dtype=np.uint32).astype("<u4", copy=False)


def piece_starts(length: int, limit: int) -> list[int]:
    """Only longer ones are cut; all pieces but the first have `limit` ids."""
    first = (length - 1) % limit + 1
    return [0, *range(first, length, limit)]


def pieces(docs: DataFrame, limit: int, keep_ids: bool = False, name: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document; a null text is empty and has one id.

    _task and _nth: the task that cut a piece, and how many of its length that task cut before.
    """
    paths = tokenizer_path(f"{name}.json"), tokenizer_path(f"{name}.tiktoken")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long" + ", ids array<int>" * keep_ids

    def cut_up(batches: Iterator) -> Iterator:
        give_back()
        task = TaskContext.get().partitionId()
        rows = ((doc, text.as_py()) for batch in batches for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")))
        yield from piece_batches(((doc, token_ids(text, *paths)) for doc, text in rows), limit, task, keep_ids)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut_up, schema)


def piece_batches(docs: Iterable[tuple[int | None, np.ndarray]], limit: int, task: int, keep_ids: bool, most: int = IDS) -> Iterator:
    """Arrow batches of the pieces of (doc_id, its ids), each of at most `most` ids and one piece, also within a document."""
    import pyarrow as pa

    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "_task": pa.int32(), "_nth": pa.int64()}
    seen: Counter = Counter()
    rows: list[tuple] = []
    held: list[np.ndarray] = []
    many = 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())]
        if keep_ids:
            ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=[*kinds, *["ids"] * keep_ids])

    for doc, ids in docs:
        for k, start in enumerate(starts := piece_starts(len(ids), limit)):
            part = ids[start : starts[k + 1] if k + 1 < len(starts) else None]
            rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
            seen[len(part)] += 1
            many += len(part)
            if keep_ids:
                held.append(part)
            if many >= most:
                yield batch()
                rows, held, many = [], [], 0
    if rows:
        yield batch()


def plan_best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, low, high, first, offset).

    The pieces of that length ranked low <= r < high go to sequence first + r - low, at offset. Equal sequences form
    one class; a step takes whole classes or splits one, so steps number at most limit^2 / 2, whatever the counts.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free room: classes as (first sequence, how many)
    free: list[int] = []
    made = 0

    def put_back(left: int, first: int, many: int) -> None:
        if left and many:
            if left not in room:
                room[left] = []
                insort(free, left)
            heapq.heappush(room[left], (first, many))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            k = bisect_left(free, length)
            if k < len(free):
                left = free[k]
                first, many = heapq.heappop(room[left])
                if not room[left]:
                    del room[left]
                    del free[k]
            else:
                left, first, many = limit, made, -(-todo // (limit // length))
                made += many
            used = min(many, todo)
            plan.append((length, rank, rank + used, first, limit - left))
            rank, todo = rank + used, todo - used
            put_back(left - length, first, used)
            put_back(left, first + used, many - used)
    return plan


def plan_table(spark: SparkSession, plan: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The plan as rows that the JVM holds: from a list of tuples, Spark would start Python workers on the executors."""
    import pyarrow as pa

    columns = zip(*(plan or [(0, 0, 0, 0, 0)]))
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=PLAN))


def pack(parts: DataFrame, limit: int = 1024) -> DataFrame:
    """parts, as from pieces (length: 1..limit), with sequence_id and offset; other columns are kept.

    The driver sees one count a length. A piece's rank within its length is its number within (length, task) after
    those of the tasks before, so no piece is ranked by a shuffle: ids stay where they were stored, and meet small
    tables of numbers. The counts of (length, task) are broadcast while they are at most BROADCAST; beyond, pieces
    are shuffled to them. An empty table gives an empty result.
    """
    spark = parts.sparkSession
    parts = stored(parts, "pieces")
    sizes = cut(parts.groupBy("length", "_task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, limit)
    planned = plan_table(spark, plan)
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    if sizes.count() <= BROADCAST:
        of_task = starts.groupBy("_task").agg(F.map_from_entries(F.collect_list(F.struct("length", "_before"))).alias("_starts"))
        ranked = parts.join(F.broadcast(of_task), "_task").withColumn("_rank", F.col("_nth") + F.col("_starts")[F.col("length")]).drop("_starts")
    else:
        ranked = parts.join(starts, ["length", "_task"]).withColumn("_rank", F.col("_nth") + F.col("_before"))
    # an interval of ranks for each rank: at most limit^2 / 2 rows in the plan, whatever the table's size
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high"))
    placed = ranked.join(F.broadcast(planned.withColumnRenamed("length", "_length")), fits)
    kept = [c for c in parts.columns if c not in ("_task", "_nth")]
    return placed.select(*kept, (F.col("first") + F.col("_rank") - F.col("low")).alias("sequence_id"), "offset")


def best_fit_pack(docs: DataFrame, limit: int = 1024, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces packed into sequences of at most `limit` ids, with each piece's ids if keep_ids."""
    return pack(pieces(docs, limit, keep_ids), limit)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents").select("doc_id", "text"), 1024, keep_ids=False)
