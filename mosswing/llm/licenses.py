"""License scans by diagonal voting: word k-gram hashes joined to template positions, votes counted by offset diagonal.

Native: DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
BITS = 62  # positions of a template in one number of its mask
FEW = 1_000_000  # documents whose candidates are broadcast at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases of which every place counts: their words must stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices found also with words changed, left out or put in.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _grams(spark: SparkSession, templates: list[tuple[str, list[str], bool]]) -> DataFrame:
    """One row a template k-gram: a constant of the program, as many rows as its templates have words."""
    rows = [(t, p, w[p : p + K]) for t, (_, w, _) in enumerate(templates) for p in range(len(w) - K + 1)]
    rows.append((-1, 0, ["\0", "\0"]))  # what every document has once
    df = spark.createDataFrame(rows, "t int, p int, gram array<string>")
    return df.select("t", "p", F.xxhash64(F.col("gram")[0], F.col("gram")[1]).alias("h"))


def once(value: Column) -> Column:
    """value in a generated row: a barrier, so that the optimiser doesn't put its expression into every lambda call."""
    return F.explode(F.array(value))


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: list[tuple[str, str]] = TEMPLATES, drift: int = 2, votes: float = 0.5, similar: float = 0.7) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score and spans of the notices found.

    Every rolling pair of words of the whole text is joined by hash to the templates' positions; hits vote for the
    diagonal (place minus template position). A base phrase is a diagonal with all votes. For a notice, diagonals at
    most `drift` apart are one span; it needs `votes` of the template's pairs and, verified by Levenshtein distance of
    the span's words against the notice, a similarity of `similar`. score: the best similarity, 1 with a base phrase.

    Only hashes are exploded, so the work grows with a text's length; the words of spans are fetched afterwards, for
    the documents that have any. Templates may be of any length from two words.

    Null and empty texts: no words, null places, empty labels, score 0. Rows that repeat give rows that repeat; null
    ids are allowed. An empty table gives an empty result. Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    known = [(label, words_of(phrase), True) for phrase, label in base.items()] + [(label, words_of(text), False) for label, text in notices]
    if any(len(w) < K for _, w, _ in known):
        raise ValueError("a template has two words at least")
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.greatest(F.col("t"), F.lit(0)) + 1)
    masks = range(-(-max(len(w) for _, w, _ in known) // BITS))
    mask = [f"m{j}" for j in masks]

    text = F.translate(text_of(), UPPER, LOWER)
    identity = docs.select("doc_id", F.xxhash64(text_of()).alias("v"), once(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("words"))
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1)))
    every = F.array(F.xxhash64(F.lit("\0"), F.lit("\0")))
    hashed = identity.select("doc_id", "v", n.cast("long").alias("n_words"), F.concat(every, F.when(n >= K, hashes).otherwise(F.array().cast("array<bigint>"))).alias("hashes"))
    rolled = hashed.select("doc_id", "v", "n_words", F.posexplode("hashes").alias("i", "h"))
    hits = rolled.join(F.broadcast(_grams(spark, known)), "h").select(
        "doc_id", "v", "n_words", "t", F.when(F.col("t") >= 0, F.col("i") - 1 - F.col("p")).otherwise(0).alias("d"), "p")
    bits = [F.bit_or(F.when(F.floor(F.col("p") / BITS) == j, F.expr(f"shiftleft(1L, p % {BITS})")).otherwise(F.lit(0).cast("long"))).alias(f"m{j}") for j in masks]
    key = ["doc_id", "v", "n_words", "t"]
    lines = hits.groupBy(*key, "d").agg(*bits, F.count("*").alias("copies"))

    # neighbouring diagonals of a document and notice
    along = Window.partitionBy("doc_id", "v", "t").orderBy("d")
    own = (F.col("t") >= 0) & ~of([b for *_, b in known])
    fresh = F.when(F.col("d") - F.lag("d").over(along) <= drift, 0).otherwise(1)
    runs = lines.withColumn("run", F.when(own, F.sum(F.when(own, fresh)).over(along)).otherwise(F.col("d")))
    voted = lambda: sum((F.bit_count(m) for m in mask), F.lit(0))
    runs = runs.withColumn("c", voted())
    spans = runs.groupBy(*key, "run").agg(*[F.bit_or(m).alias(m) for m in mask], F.max(F.struct("c", (-F.col("d")).alias("d"))).alias("best"), F.max("copies").alias("copies"))
    share = voted() / (of([len(w) for _, w, _ in known]) - K + 1)
    spans = cut(spans.where((F.col("t") < 0) | (own & (share >= votes)) | (~own & (share == 1))).select(*key, (-F.col("best.d")).alias("d"), "copies"))

    # the words of each candidate span, against its template
    wanted = cut(spans.where("t >= 0").groupBy("doc_id", "v").agg(F.collect_set(F.struct("t", "d")).alias("spans")))
    sized = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    wanted_words = docs.select("doc_id", F.xxhash64(text_of()).alias("v"), "text").join(
        sized.select(F.col("doc_id").alias("_id"), F.col("v").alias("_v"), "spans"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")))
    words_again = wanted_words.select("doc_id", "v", "spans", once(F.regexp_extract_all(text, F.lit(WORD), 0)).alias("words"))

    def against(x: Column) -> Column:
        size = F.element_at(F.array(*[F.lit(len(w)) for _, w, _ in known]), x["t"] + 1)
        notice = F.element_at(F.array(*[F.lit(" ".join(w)) for _, w, _ in known]), x["t"] + 1)
        start = F.greatest(x["d"], F.lit(0))
        span = F.array_join(F.slice("words", start + 1, F.greatest(F.lit(1), F.least(size + F.least(x["d"], F.lit(0)), n - start))), " ")
        likeness = F.when(span == notice, 1.0).otherwise(1 - F.levenshtein(notice, span) / F.greatest(F.char_length(notice), F.char_length(span)))
        return F.struct(x["t"].alias("t"), x["d"].alias("d"), likeness.alias("likeness"))

    checked = words_again.select("doc_id", "v", F.explode(F.transform("spans", against)).alias("x")).select("doc_id", "v", "x.*").distinct()
    all_rows = checked.withColumns({"n_words": F.lit(None).cast("long"), "copies": F.lit(None).cast("long")}).unionByName(
        spans.where("t < 0").select("doc_id", "v", "t", "d", F.lit(0.0).alias("likeness"), "n_words", "copies"))
    place = F.col("d").cast("long")
    around = Window.partitionBy("doc_id", "v").orderBy(place).rangeBetween(-3, 3)  # of notices that start together, the likest
    ranked = all_rows.withColumn("likest", F.max(F.when(own, F.col("likeness"))).over(around)).withColumn("label", of([label for label, *_ in known]))
    is_base = (F.col("t") >= 0) & ~own & (F.col("likeness") == 1)
    is_notice = own & (F.col("likeness") >= similar) & (F.col("likeness") == F.col("likest"))
    result = ranked.groupBy("doc_id", "v").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, place)).alias("first_word"),
        F.max(F.when(is_base, place)).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base | is_notice, F.col("label")))), ",").alias("labels"),
        F.greatest(F.max(F.when(is_base, 1.0).otherwise(0.0)), F.max(F.when(is_notice, F.col("likeness")).otherwise(0.0))).alias("score"),
        F.array_sort(F.collect_list(F.when(is_notice, F.struct(place.alias("word"), "label", F.round("likeness", 4).alias("similarity"))))).alias("spans"),
        F.max("copies").alias("_copies"),
    )
    repeated = result.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return repeated.drop("v", "_copies", "_copy")


def op4_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
