import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from mosswing.llm import packing
from mosswing.llm.packing import best_fit_pack, piece_starts, plan_best_fit, token_ids, tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


def check(rows, limit):
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(at)


def test_round_trip(docs, clashing):
    exact = Tokenizer.from_file(PATHS[0])
    source = {}
    for r in docs.collect():
        source.setdefault(r["doc_id"], []).append([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    out = best_fit_pack(docs, 64).collect()
    check(out, 64)
    got = Counter(i for r in out for i in r["ids"])
    assert got == Counter(i for texts in source.values() for ids in texts for i in ids)
    for doc, texts in source.items():
        if doc is not None and len(texts) == 1:
            parts = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["piece"])
            assert [i for r in parts for i in r["ids"]] == texts[0] and [r["start"] for r in parts] == piece_starts(len(texts[0]), 64)
            assert all(r["length"] == 64 for r in parts[1:])
    assert best_fit_pack(clashing, 64, False).count() == len(out)


def test_no_documents(nothing):
    assert best_fit_pack(nothing).count() == 0


def test_both_libraries_agree():
    exact = Tokenizer.from_file(PATHS[0])
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice("abc ABC éÀß ñ012 \n\t'.,!|-_$&Ɏ  's 're") for _ in range(r.randrange(60)))
        assert token_ids(text, *PATHS).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 2]


def brute(counts, limit):
    """Best fit decreasing, one piece after the other."""
    free = []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(limit - length)
    return len(free)


def test_plan_is_best_fit():
    r = random.Random(2)
    for _ in range(60):
        limit = r.randrange(4, 60)
        counts = {n: r.randrange(1, 30) for n in r.sample(range(1, limit + 1), r.randrange(1, min(limit, 12)))}
        plan = plan_best_fit(counts, limit)
        used = {}
        for length, low, high, first, offset in plan:
            for k in range(high - low):
                used.setdefault(first + k, []).append((offset, length))
        for n, c in counts.items():
            ranks = sorted(x for length, low, high, *_ in plan if length == n for x in range(low, high))
            assert ranks == list(range(c))
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= limit
        assert len(used) <= brute(counts, limit) + 1 and len(used) >= -(-sum(n * c for n, c in counts.items()) // limit)


def test_plan_does_not_grow_with_counts():
    counts = {n: 10**9 + n for n in range(1, 1025)}
    assert len(plan_best_fit(counts, 1024)) < 20_000 and np.isfinite(len(counts))


def test_ids_stay_where_they_were_stored(spark, docs, monkeypatch):
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = docs.repartition(7).cache()
        out = best_fit_pack(spread, 64)
        moves = [line for line in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("\n") if "SortMergeJoin" in line]
        assert not moves
        rows = out.collect()
        monkeypatch.setattr(packing, "BROADCAST", 0)
        shuffled = best_fit_pack(spread, 64).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)
    sequences = check(rows, 64)
    assert check(shuffled, 64) == sequences
    assert Counter(tuple(r["ids"]) for r in rows) == Counter(tuple(r["ids"]) for r in shuffled)
    plan = plan_best_fit(Counter(r["length"] for r in rows), 64)
    assert sequences == max(first + high - low for _, low, high, first, _ in plan)


def test_workers_hold_few_ids_and_plan_needs_none(spark):
    r = np.random.default_rng(3)
    docs = [(1, r.integers(0, 50_000, 5000).astype("<u4")), (None, np.array([2], "<u4")), (3, r.integers(0, 50_000, 700).astype("<u4"))]
    batches = list(packing.piece_batches(iter(docs), 64, 5, True, most=256))
    assert len(batches) > 20 and all(sum(b.column("length").to_pylist()) < 256 + 64 for b in batches)
    rows = [x for b in batches for x in b.to_pylist()]
    for doc, ids in docs:
        own = [x for x in rows if x["doc_id"] == doc]
        assert [i for x in own for i in x["ids"]] == ids.tolist() and [x["start"] for x in own] == piece_starts(len(ids), 64)
        assert all(x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and x["length"] == len(x["ids"]) and x["_task"] == 5 for x in own)
    for n in {x["length"] for x in rows}:
        assert [x["_nth"] for x in rows if x["length"] == n] == list(range(sum(x["length"] == n for x in rows)))
    bare = [x for b in packing.piece_batches(iter(docs), 64, 5, False, most=256) for x in b.to_pylist()]
    assert bare == [{k: v for k, v in x.items() if k != "ids"} for x in rows]
    assert not list(packing.piece_batches(iter([]), 64, 5, True))
    shown = packing.plan_table(spark, plan_best_fit({3: 5, 7: 2}, 10))._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in shown and "RDD" not in shown
