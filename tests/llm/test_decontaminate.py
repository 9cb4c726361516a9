import random

import numpy as np
from llm_data import prose

from mosswing.llm.decontaminate import BUDGET, Q, best_place, find_leaks, gram_hashes, normal, without_leaks


def brute(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_alignment_against_the_whole_table():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randrange(3) for _ in range(r.randrange(1, 14))]
        b = [r.randrange(3) for _ in range(r.randrange(0, 18))]
        e, want = r.randrange(0, 5), brute(a, b)
        got = best_place(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), e)
        assert (got and got[0]) == (want if want <= e else None)
        if got:
            assert whole(a, b[got[1] : got[2]]) == got[0]


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_hashes_are_of_whole_grams():
    p = normal("abcdefghijklmnopqrstuvw abcdefghijklmnopqrstuvw")[0]
    h = gram_hashes(p)
    assert len(set(h[:12])) == 12 and (h[:12] == h[24:36]).all() and len(gram_hashes(p[:5])) == 0


def swapped(text, n, seed):
    r, c = random.Random(seed), list(text)
    for i in r.sample(range(len(c)), n):
        c[i] = "#" if r.random() < 0.5 else "q"
    return "".join(c)


def test_planted(spark, docs, clashing, nothing):
    items = {1: prose(91, 30), 2: prose(92, 25), 3: "tiny", 4: prose(93, 40)}
    bench = spark.createDataFrame([*items.items(), (5, None)], "item_id long, text string")
    long = prose(7, 4000)
    planted = [
        (201, long + " " + items[1] + " " + long), (202, items[2].upper().replace(" ", "\n\n")), (203, prose(8, 50) + swapped(items[4], 3, 1) + prose(9, 50)),
        (204, swapped(items[4], 60, 2)), (205, items[1] + items[2]), (206, items[1][: len(items[1]) // 2]), (207, (items[1] + " ") * 3)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    out = find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(201, 1), (202, 2), (203, 4), (205, 1), (205, 2), (207, 1)}
    assert sum(r["doc_id"] == 207 for r in out) == 3 and [r["edits"] for r in out if r["doc_id"] == 203] == [min(3, [r["edits"] for r in out if r["doc_id"] == 203][0])]
    place = next(r for r in out if r["doc_id"] == 201)
    assert items[1] in planted[0][1][place["start"] : place["end"]]
    assert without_leaks(df, bench).count() == df.count() - 5
    assert find_leaks(clashing.withColumnRenamed("item_id", "edits"), bench).count() == 0
    assert find_leaks(nothing, bench).count() == 0 and find_leaks(df, bench.limit(0)).count() == 0


def test_replaced_words_cut_ends_and_short_items(spark):
    words = prose(94, 24).split()
    other = [*words[:6], "zzzzzz", *words[7:]]
    item = " ".join(words)
    bench = spark.createDataFrame([(1, item), (2, "Tiny it")], "item_id long, text string")
    rows = [(1, prose(8, 50) + " " + " ".join(other) + " " + prose(9, 50)), (2, prose(10, 50) + " " + item[: int(len(item) * 0.92)]), (3, "a tiny, IT is"), (4, "tiny item"), (5, item[: len(item) // 2])]
    out = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 1), (2, 1), (3, 2)}
    assert [rows[2][1][r["start"] : r["end"]] for r in out if r["doc_id"] == 3] == ["tiny, IT"]


def test_against_brute_force(spark):
    """Every document against every item over the whole table of edits: the same pairs, and places with those edits."""
    r = random.Random(4)
    items = {i: prose(600 + i, r.choice([3, 6, 12, 20])) for i in range(8)}
    docs = {}
    for i in range(60):
        item = items[r.randrange(8)]
        within = swapped(item, min(len(item), r.choice([0, 1, 2, 4, 8, 14])), i)
        docs[i] = "\u0130" * r.randrange(3) + prose(700 + i, r.randrange(12)) + "\n" + within + " - " + prose(800 + i, r.randrange(12))
    out = find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    trim = lambda t: [c for c in "".join(map(chr, normal(t)[0])).strip(" ")]
    want = set()
    for d, text in docs.items():
        for i, item in items.items():
            p = trim(item)
            if brute(p, trim(text)) <= min(int(BUDGET * len(p)), (len(p) - Q) // Q):
                want.add((d, i))
    assert {(x["doc_id"], x["item_id"]) for x in out} == want and len(want) > 25
    for x in out:
        assert whole(trim(items[x["item_id"]]), trim(docs[x["doc_id"]][x["start"] : x["end"]])) == x["edits"]


def test_rows_are_judged_one_by_one(spark):
    """A leak among rows that share an id, or have none, takes only itself; items' blocks change nothing."""
    item = prose(95, 30)
    rows = [(None, item), (None, "clean"), (1, "clean too"), (1, item), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    left = without_leaks(df, bench)
    assert left.schema == df.schema
    assert sorted(map(str, left.collect())) == sorted(map(str, df.where("text is null or text not like '% %' or text like 'clean%'").collect()))
    assert find_leaks(df, bench).count() == 2
