from llm_data import texts_with_notices

from mosswing.llm.licenses import BASE, TEMPLATES, scan_licenses, words_of


def brute(text):
    words, places, labels = words_of(text or ""), [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places(spark, docs, clashing):
    df = docs.select("doc_id", "text").union(spark.createDataFrame(texts_with_notices(), "doc_id long, text string"))
    source = {r["doc_id"]: r["text"] for r in df.where("doc_id is not null").collect()}
    out = scan_licenses(df).collect()
    assert len(out) == df.count()
    for r in out:
        if r["doc_id"] is not None:
            got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
            assert got == brute(source[r["doc_id"]]), source[r["doc_id"]][:80]
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {r["doc_id"]: r["labels"] for r in out}
    assert labels[101] == "mit" and labels[102] == "cc-by,cc-by-nc" and labels[103] == "gpl,gpl-3.0" and labels[104] == "apache-2.0"
    assert labels[105] == "mit" and labels[106] == "" and labels[108] == "reserved" and labels[1] == ""
    assert scan_licenses(clashing).count() == docs.count()


def test_empty(nothing):
    assert scan_licenses(nothing).count() == 0


def test_long_notices_and_long_texts(spark):
    """A whole licence text of over 160 words with some changed; and a text of a million words in well under a minute."""
    import time

    whole = max((t for label, t in TEMPLATES if label == "mit"), key=len)
    words = whole.split()
    assert len(words) > 150
    words[20], words[90] = "changed", "other"
    del words[50]
    filler = "lorem ipsum dolor sit amet consectetur " * 20
    giant = "lorem ipsum dolor sit amet " * 200_000 + "all rights reserved"
    df = spark.createDataFrame([(1, filler + " ".join(words) + " " + filler), (2, whole[: len(whole) // 3]), (3, giant), (3, giant)], "doc_id long, text string")
    began = time.time()
    out = scan_licenses(df).collect()
    assert time.time() - began < 60
    by = {r["doc_id"]: r for r in out}
    assert by[1]["labels"] == "mit" and max(s["similarity"] for s in by[1]["spans"]) < 1 and by[2]["labels"] == "mit"
    assert len(out) == 4 and by[3]["n_words"] == 1_000_003 and (by[3]["n_base"], by[3]["first_word"]) == (1, 1_000_000)


def test_added_labels_against_brute_force(spark):
    """A notice with some words changed is found if, and only if, a span of the text is as like it as the parameter says."""
    import random

    r = random.Random(8)
    notices = [("one", "alpha beta gamma delta epsilon zeta eta theta"), ("two", "red orange yellow green blue indigo violet black white")]
    docs = []
    for i in range(60):
        label, text = notices[i % 2]
        words = text.split()
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = r.choice(["x", "yy"])
        docs.append((i, "w " * r.randrange(9) + " ".join(words) + " w" * r.randrange(9)))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    got = {x["doc_id"]: x["labels"] for x in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), {"zz zz": "z"}, notices).collect()}
    found = 0
    for i, text in docs:
        label, notice = notices[i % 2]
        words, n = text.split(), notice.split()
        best = max((sum(a == b for a, b in zip(zip(words[d:], words[d + 1 :]), zip(n, n[1:]))), -d) for d in range(len(words) - len(n) + 1))
        span = " ".join(words[-best[1] : -best[1] + len(n)])
        like = 1 - edits(notice, span) / max(len(notice), len(span))
        want = label if best[0] >= 0.5 * (len(n) - 1) and like >= 0.7 else ""
        assert got[i] == want, (text, got[i], want, like)
        found += bool(want)
    assert 20 < found < 60
