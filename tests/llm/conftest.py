import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SCHEMA, edited, prose  # noqa: E402

def rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, odd characters."""
    base = prose(1, 200)
    texts = {
        0: None, 1: "", 2: " \n ", 3: base, 4: base, 5: edited(base, 5, 6), 6: edited(base, 6, 12), 7: base.upper(), 8: prose(2, 12_000), 9: "...", 10: "...",
        11: "Été à l'école, Ünïcode 日本語 😀 ΟΔΟΣ", 12: prose(3, 60), 13: "x", 14: "one two three", 15: prose(4, 80), 16: "<|endoftext|> \x00 tail"}
    out = [(i, t, "en", "src0", len(t) if t else None) for i, t in texts.items()]
    out += [out[3], out[1], (None, "no id at all", None, None, 12), (None, base, None, None, 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with other columns whose names operators use within."""
    names = ["shard", "slot", "size", "score", "key", "kinds", "new", "i", "h", "label", "block", "length", "split", "words", "_raw", "class_id", "item_id"]
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
