import random

import numpy as np
from llm_data import edited, prose

from mosswing.llm import near_dedup
from mosswing.llm.alignment import band_distance, whole_distance
from mosswing.llm.near_dedup import components, near_duplicates, sketch, word_list


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_alignment_against_the_whole_table():
    r = random.Random(2)
    for _ in range(4000):
        k = r.choice([2, 3, 50])
        a = [r.randrange(k) for _ in range(r.randrange(0, 40))]
        b = [x for x in a if r.random() > 0.1]
        for _ in range(r.randrange(0, 6)):
            b.insert(r.randrange(len(b) + 1), r.randrange(k))
        e, want = r.randrange(0, 9), brute(a, b)
        assert band_distance(a, b, e) == (want if want <= e else None) and whole_distance(a, b) == want


def test_classes_against_all_pairs(spark, docs, clashing, nothing):
    more = []
    for g in range(12):
        text = prose(300 + g, 60 + 20 * g)
        more += [(1000 + 40 * g + k, edited(text, k, k % 7) if k else text) for k in range(8 if g else 30)]
    shared = prose(999, 55)
    more += [(5000 + k, prose(400 + k, 90) + " " + shared + " " + prose(500 + k, 90)) for k in range(30)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    out = near_duplicates(df).collect()
    assert len(out) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect() if r["doc_id"] is not None}
    words = {i: word_list(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    got = {r["doc_id"]: r["class_id"] for r in out if r["doc_id"] is not None}
    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    links, lost = 0, []
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = max(len(words[a]), len(words[b]))
            alike = band_distance(words[a], words[b], int(0.2 * n + 1e-9)) is not None if words[a] and words[b] else texts[a] == texts[b]
            if alike:
                i, j = sorted((top(a), top(b)))
                root[j] = i
                links += 1
                if got[a] != got[b]:
                    lost.append(len(grams[a] & grams[b]) / len(grams[a] | grams[b]))
    # links at the very edge may share no sketch; none of those with a shingle similarity of a half is lost
    assert links > 500 and len(lost) < 0.01 * links and all(j < 0.5 for j in lost), lost
    assert all(top(a) == top(got[a]) for a in ids)
    kept = [r["doc_id"] for r in out if r["kept"] and r["doc_id"] is not None]
    assert sorted(kept) == sorted(set(got.values()))
    nameless = [r for r in out if r["doc_id"] is None]
    assert sorted((r["class_id"] is None, r["kept"]) for r in nameless) == [(False, False), (True, True)]
    assert near_duplicates(clashing).count() == docs.count() and near_duplicates(nothing).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 105), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 105: 100}


def test_star_of_a_large_bucket(spark):
    """Copies near the original and far from each other: the original stands anywhere in its buckets."""
    base, n = prose(77, 100).split(), 1000
    r, rows = random.Random(5), [(n // 2, " ".join(base))]
    for i in [i for i in range(n) if i != n // 2]:
        words = list(base)
        for at in r.sample(range(15, 100), 14):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    texts = {i: word_list(t) for i, t in rows}
    sketches = {i: sketch(w) for i, w in texts.items()}
    meet = [i for i in texts if i != n // 2 and (sketches[i] == sketches[n // 2]).any()]
    assert len(meet) > 0.8 * n
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in meet} == {got[n // 2]}


def test_a_passage_of_many_texts_is_not_compared_by_pairs(spark, monkeypatch):
    """Long texts that share a passage: lengths and word counts rule none out, and only copies are to be aligned."""
    monkeypatch.setattr(near_dedup, "CROWDED", 10, raising=False)
    counted, whole = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest: counted.append(pairs.count()) or whole(pairs, *rest))
    passage, rows = prose(1, 150), []
    for i in range(160):
        rows.append((i, prose(100 + i, 350) + " " + passage + " " + prose(900 + i, 350)))
    rows += [(1000 + i, edited(rows[i][1], i, 40)) for i in range(0, 160, 4)]
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert sum(counted) < 5 * len(rows), counted


def test_crowded_rows_against_all_pairs(spark):
    r, rows, shared = random.Random(4), [], prose(9, 12).split()
    for g in range(40):
        base = [*shared[: r.randrange(13)], *(r.choice("abcdefghij") * r.randrange(1, 3) for _ in range(r.randrange(1, 40)))]
        rows += [word_list(edited(" ".join(base), 10 * g + k, k * len(base) // 20)) for k in range(6)]
    ids = [near_dedup._hashes[w] & 0xFFFFFFFF for words in rows for w in words]
    parts = np.split(np.array(ids, dtype=np.uint32), np.cumsum([len(x) for x in rows])[:-1])
    words = spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(parts)], "rep long, w binary")
    for similar in (0.8, 0.7):
        got = {(x["a"], x["b"]) for x in near_dedup._sharing(words.select("rep"), spark.createDataFrame([], "node long, root long"), words, similar).collect()}
        links = 0
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                n = max(len(a), len(rows[j]))
                if near_dedup._least_shared(n, similar) >= 1 and band_distance(a, rows[j], int((1 - similar) * n + 1e-9)) is not None:
                    links += 1
                    assert (i, j) in got, (a, rows[j])
        assert links > 300


def test_components_in_one_task_and_in_many(spark, monkeypatch):
    r = random.Random(6)
    links = spark.createDataFrame([(r.randrange(3000), r.randrange(3000)) for _ in range(1400)], "a long, b long")
    one = {x["node"]: x["root"] for x in components(links).collect()}
    monkeypatch.setattr(near_dedup, "ONE_TASK", 0)
    assert one == {x["node"]: x["root"] for x in components(links).collect()} and len(set(one.values())) > 100
