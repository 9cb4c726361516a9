import re

from pyspark.sql import functions as F

from mosswing.llm.pii import replace_entities, surrogates

TEXTS = [
    (1, "Write to ann.lee@mail1.example.com or ANN.LEE@MAIL1.EXAMPLE.COM, also bob@mail1.example.com."),
    (2, "ann.lee@mail1.example.com calls +1 (017) 555-7713; from 97.51.17.173 at 10:30."),
    (3, "Card 4111111111111111, again 4111 1111 1111 1111, other 9807915762804490"),
    (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and api_key: Zz09Zz09Zz09Zz09'),
    (5, "Mrs. Smith met Mr. John Smith and Anna Jones; Herr Müller. Frau Weiß. Господин Иванов; Mr and the rest"),
    (6, "Clean text: version 1.2.3, year 2024, 3.14 and 100-200, v 10.0"),
    (7, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000, ssn 123-45-6789"),
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_kinds_formats_and_coreference(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = {r["doc_id"]: r for r in replace_entities(df).collect()}
    mails = [re.findall(r"\S+@\S+\w", out[i]["text"]) for i in (1, 2)]
    assert len(mails[0]) == 3 and mails[0][0] == mails[1][0] == mails[0][1].lower() != mails[0][2] and mails[0][1].isupper()
    assert mails[0][0].split("@")[1] == mails[0][2].split("@")[1] and mails[0][0].endswith(".com") and "." in mails[0][0].split("@")[0]
    assert "ann.lee" not in out[1]["text"].lower() and re.fullmatch(r".* calls \+1 \(\d{3}\) \d{3}-\d{4}; from (\d+\.){3}\d+ at 10:30\.", out[2]["text"])
    cards = re.fullmatch(r"Card (\d{16}), again (\d{4} \d{4} \d{4} \d{4}), other (\d{16})", out[3]["text"]).groups()
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111" and luhn(cards[0]) and cards[0][0] == "4" and cards[2] != "9807915762804490"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and api_key: [A-Z][a-z]\d\d([A-Z][a-z]\d\d){3}', out[4]["text"]) and "04dbeb" not in out[4]["text"]
    five = re.fullmatch(r"Mrs\. (\w+) met Mr\. (\w+) (\w+) and (\w+) (\w+); Herr (\w+)\. Frau (\w+)\. Господин (\w+); Mr and the rest", out[5]["text"])
    assert five and five[1] == five[3] and five[5] != five[1] and re.fullmatch("[А-Яа-яё]+", five[8]) and not re.search("Smith|Jones|Müller|Weiß|Иванов", out[5]["text"])
    assert out[6]["text"] == TEXTS[5][1] and out[6]["n_entities"] == 0 and out[6]["kinds"] == ""
    ibans = re.findall(r"DE[\d ]+\d", out[7]["text"])
    assert ibans[0].replace(" ", "") == ibans[1] and ibans[0].count(" ") == 5 and "123-45" not in out[7]["text"] and out[7]["kinds"] == "iban,ssn"
    again = {r["doc_id"]: r["text"] for r in replace_entities(df).collect()}
    assert again == {i: r["text"] for i, r in out.items()}
    assert {r["text"] for r in replace_entities(df, "another key").collect()} != set(again.values())


def test_odd_rows(docs, clashing, nothing):
    out = replace_entities(docs)
    assert out.select(docs.columns).exceptAll(docs).isEmpty() and out.count() == docs.count()
    extra = replace_entities(clashing.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" a@b.example.com"))))
    assert extra.where("n_entities <> 1").isEmpty() and extra.where("new <> 'new' or kinds <> 'email'").isEmpty() and extra.count() == docs.count()
    assert extra.where(F.col("n_chars") != F.length("text")).isEmpty()
    assert replace_entities(nothing).count() == 0


def test_crowded_space_stays_distinct(spark):
    """Three hundred entities of two digits: digests collide again and again."""
    rows = [("secret", f"{n:03d}") for n in range(0, 1000, 4)]
    df = spark.createDataFrame(rows, "kind string, canon string").selectExpr("*", "'latin' script", "0 country")
    got = surrogates(df, "k").collect()
    new = [r["surrogate"] for r in got]
    assert len(got) == len(rows) and len(set(new)) == len(new) and not set(new) & {c for _, c in rows}


def test_namesakes_stay_distinct(spark):
    """More first names with one last name than the pool of one gender holds."""
    first = [a + b for a in ("Al", "Bo", "Ced", "Dor") for b in ("an", "en", "in", "on", "us", "as")]
    df = spark.createDataFrame([(i, f"Mr. {n} Smith") for i, n in enumerate(first)] + [(99, f"Mr. {first[0]} Smith, Mr. Smith")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in replace_entities(df).collect()}
    assert len({out[i] for i in range(len(first))}) == len(first) and len({t.split(",")[0].split()[-1] for t in out.values()}) == 1
    assert out[99].split(",")[0] == out[0] and "Smith" not in out[99]


def test_names_again_without_title(spark):
    text = "Mrs Olivia Brown met Olivia Brown and Noah Green. Later, Brown and Green left; Brown sugar stays."
    got = replace_entities(spark.createDataFrame([(1, text), (2, "Brown and Green are colours, Olivia.")], "doc_id long, text string"))
    out = {r["doc_id"]: r["text"] for r in got.collect()}
    m = re.fullmatch(r"Mrs (\w+ \w+) met (\w+ \w+) and (\w+) (\w+)\. Later, (\w+) and (\w+) left; (\w+) sugar stays\.", out[1])
    assert m and m[1] == m[2] and m[1].split()[1] == m[5] and m[4] == m[6] and not re.search("Olivia|Noah|Green", out[1])
    assert out[2] == "Brown and Green are colours, Olivia."


def test_several_hundred_persons(spark):
    """All persons distinct, none unchanged in any part, the same in every document; last names map one to one."""
    lasts = ["Smith", "Jones", "Miller", "Weber", "Costa", "Lopez"] + [f"{a}{b}" for a in ("Har", "Bel", "Cor") for b in ("ton", "man", "ley", "field")]
    firsts = ["James", "John", "Mary", "Anna", "Noah", "Emily", "Oliver", "Grace", "Hugo", "Clara", "Martin", "Sarah", "Victor", "Eva", "Paul", "Nina", "Leo", "Ruth", "Max", "Ella"]
    people = [(f, l) for l in lasts for f in firsts]  # noqa: E741
    rows = [(i, f"Here {f} {l} speaks.") for i, (f, l) in enumerate(people)] + [(10_000 + i, f"Dr {f} {l} too.") for i, (f, l) in enumerate(people)]  # noqa: E741
    out = {r["doc_id"]: r["text"] for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = {p: tuple(re.fullmatch(r"Here (\w+) (\w+) speaks\.", out[i]).groups()) for i, p in enumerate(people)}
    assert len(set(new.values())) == len(people) == 360
    assert all(a != f and b != l for (f, l), (a, b) in new.items())  # noqa: E741
    last = {l: {b for (_, m), (_, b) in new.items() if m == l} for l in lasts}  # noqa: E741
    assert all(len(x) == 1 for x in last.values()) and len(set.union(*last.values())) == len(lasts) and not set.union(*last.values()) & set(lasts)
    assert all(out[10_000 + i] == "Dr {} {} too.".format(*new[p]) for i, p in enumerate(people))


def test_used_up_formats_stay_distinct(spark):
    """More numbers of a format than it has: some surrogates get longer, none is another's."""
    rows = [("phone", f"+1{n:02d}") for n in range(60)]
    df = spark.createDataFrame(rows, "kind string, canon string").selectExpr("*", "'latin' script", "2 country")
    new = [r["surrogate"] for r in surrogates(df.selectExpr("kind", "substr(canon, 2) canon", "script", "1 country"), "k").collect()]
    assert len(set(new)) == 60 and all(x.isdigit() for x in new) and not set(new) & {c[1:] for _, c in rows}


def test_columns_of_the_input_stay(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "x", 5)], "doc_id long, text string, _id string, _raw long")
    r = replace_entities(df).first()
    assert r["_id"] == "x" and r["_raw"] == 5 and r["n_entities"] == 1
