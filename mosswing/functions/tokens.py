"""The analyser of text fields: runs of letters and digits, each character lower-cased by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Null text has no tokens. A capital sigma is mapped first, as lower() would look at its neighbours."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.lower(F.translate(text, "Σ", "σ"))
    return F.coalesce(F.regexp_extract_all(plain, F.lit(RUNS), 0), F.array().cast("array<string>"))


def query_terms(text: str) -> list[str]:
    """The distinct tokens of a query, sorted."""
    out, run = set(), []
    for c in text + " ":
        if c.isalpha() or c.isnumeric():
            run.append(c.lower())
        elif run:
            out.add("".join(run))
            run = []
    return sorted(out)
