"""A stored inverted index: postings in folders by term bucket, sorted by term, so that a query reads only its terms."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokens import tokens
from .bm25 import B, K1, counted, idf, part, runs, spread

BUCKETS = 32
MARK = 64  # a word's bucket before it, as one character: '@' and what follows
TASK_WORDS = 1_000_000


def bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def write(rows: DataFrame, keys: list[str], words: dict[str, int], path: str) -> None:
    """Postings of the text fields, whose words are given by number: field and bucket (a folder each), term, the keys, tf, len.

    A document's words of one bucket are shuffled as one sorted line, counted behind it. A task has some TASK_WORDS
    words: buckets are split by document as well, so that no word is a single task and no task sorts more as tables grow.
    """
    for name, total in words.items():
        tasks = max(1, -(-total // TASK_WORDS))
        parts = -(-tasks // BUCKETS)
        marked = F.transform(tokens(name), lambda w: F.concat(F.char(bucket(w) + MARK), w))  # sorted by bucket, then word
        split = spread(rows.select(*keys, name)).select(*keys, F.explode(F.array(F.sort_array(marked))).alias("_t")).where(F.size("_t") > 0)
        spans = split.select(*keys, F.size("_t").alias("len"), "_t", F.inline(runs("_t", F.ascii)).alias("_first", "_last"))
        line = F.array_join(F.slice("_t", F.col("_first") + 1, F.col("_last") - F.col("_first") + 1), " ")
        lines = spans.select(*keys, "len", (F.ascii(F.get("_t", F.col("_first"))) - MARK).alias("bucket"), line.alias("line"))
        place = F.col("bucket") * parts + F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        placed = lines.repartitionById(min(tasks, BUCKETS) * parts, F.pmod(place, F.lit(min(tasks, BUCKETS) * parts)))
        each = counted(placed.select(*keys, "len", "bucket", F.explode(F.array(F.split("line", " "))).alias("_t")), "_t", *keys, "len", "bucket")
        out = each.select(F.expr("substring(term, 2)").alias("term"), *keys, F.col("tf").cast("int").alias("tf"), "len", "bucket")
        out.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/field={name}")


def read(spark: SparkSession, folders: list[str], field: str, terms: list[str] | None, keys: T.StructType) -> DataFrame:
    """term, the keys, tf, len of the query's terms (None: of all): other buckets' folders are pruned, other terms' row
    groups skipped."""
    names = {"term": T.StringType(), "tf": T.IntegerType(), "len": T.IntegerType(), "field": T.StringType(), "bucket": T.IntegerType()}
    schema = T.StructType([*keys.fields, *[T.StructField(n, t) for n, t in names.items()]])
    found = None
    for folder in folders:
        one = spark.read.schema(schema).parquet(folder)
        found = one if found is None else found.unionByName(one)
    found = found.where(F.col("field") == field)
    if terms is not None:
        found = found.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("term").isin(terms))
    return found.select("term", *keys.names, "tf", "len")


def scored(found: DataFrame, stats: DataFrame, k: int, least: int, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """id, score of the k best; found: term, id, tf, len and passes (of live rows; what does not pass still counts).

    One row a term of document frequencies and one row of statistics are broadcast.
    """
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.where("passes").join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    score = F.sum(idf(F.col("n"), F.col("df")) * part(F.col("tf").cast("double"), F.col("len"), F.col("all") / F.col("some"), k1, b))
    total = rows.groupBy("id").agg((score if digits is None else F.round(score, digits)).alias("score"), F.count("*").alias("terms"))
    return total.where(F.col("terms") >= least).select("id", "score").orderBy(F.desc("score"), "id").limit(k)
