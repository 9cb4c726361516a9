import zlib

from pyspark.sql import functions as F

from mosswing.llm.sharding import _key_columns, _splitters, histogram_sort_shards


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))


def test_every_row_once_and_bytes_near_equal(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one text that a third of all rows have").otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 7).cast("int"))).alias("text"))
    out = histogram_sort_shards(df, 8, cell_rows=50).collect()
    check(out, 8)
    assert sorted(r["doc_id"] for r in out) == list(range(4000))
    sizes = [sum(len((r["text"] or "").encode()) + 1 for r in out if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * (0.005 * sum(sizes) / 8 + 400), sizes


def test_equal_texts_stay_together(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2((F.col("id") % 900).cast("string"), 512)).alias("text"))
    out = histogram_sort_shards(df, 8, tolerance=0.05).collect()
    by = {}
    for r in out:
        by.setdefault(zlib.crc32(r["text"].encode()), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())


def test_odd_rows(docs, clashing, nothing):
    out = histogram_sort_shards(docs, 3).collect()
    check(out, 3)
    assert len(out) == docs.count() and {r["size"] for r in out if r["text"] is None} == {1}
    other = histogram_sort_shards(clashing, 3)
    assert other.count() == docs.count() and other.select("split").distinct().count() == 1 and dict(other.dtypes)["slot"] == "bigint"
    assert histogram_sort_shards(nothing).count() == 0


def test_splitters_against_a_full_sort(spark):
    """Bytes below each splitter, counted over all keys in order, are within tolerance of the target or at its row's edge."""
    df = spark.range(2500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text in a third of all rows").otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 9).cast("int"))).alias("text"))
    keys = _key_columns(df)
    rows = sorted((r[0], r[1], r[2]) for r in keys.select("_hs_k1", "_hs_k2", "_hs_size").collect())
    for tolerance in (0.005, 0.05):
        cuts, _ = _splitters(keys.select("_hs_k1", "_hs_k2", "_hs_size"), 8, tolerance)
        total = sum(n for *_, n in rows)
        assert cuts == sorted(cuts)
        for i, c in enumerate(cuts, 1):
            below = sum(n for a, b, n in rows if (a, b) < c)
            assert abs(below - total * i / 8) <= max(tolerance * total / 8, max(n for *_, n in rows))
        out = histogram_sort_shards(df, 8, tolerance).collect()
        want = {}
        for a, b, n in rows:
            want.setdefault(sum((a, b) >= c for c in cuts), []).append(n)
        assert {k: sorted(v) for k, v in want.items()} == {k: sorted(r["size"] for r in out if r["shard"] == k) for k in {r["shard"] for r in out}}


def test_columns_of_the_input_stay(spark):
    out = histogram_sort_shards(spark.createDataFrame([(1, "a", "x", 7), (2, "b", "y", 8)], "doc_id long, text string, _k1 string, _size long"), 2)
    assert {(r["_k1"], r["_size"]) for r in out.collect()} == {("x", 7), ("y", 8)}
