"""The engine's query catalogue: for each name a DataFrame plan and, where SQL can say it, the SQL of the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate
from .operators import bm25 as text_ops
from .operators import knn
from .operators.fusion import Rrf, Weighted, fuse, ranked_leg
from .operators.logfold import apply_patches, delete_where_counts, fold, latest
from .operators.search import hits, search
from .plans.filters import Predicate, parse_filter, unexpired
from .plans.request import SearchRequest, TextLeg, VectorLeg
from .schema import Schema
from .sources import synth
from .store import Collection
from .streaming.ingest import apply_batch, follow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CORPUS = Schema.parse([
    {"name": "text", "kind": "text"}, {"name": "lang", "kind": "enum"}, {"name": "source", "kind": "enum"}, {"name": "n_chars", "kind": "i64"},
    {"name": "embedding", "kind": "vector", "dims": 64, "metric": "dot"}, {"name": "label", "kind": "i64"}, {"name": "quality", "kind": "i64"},
    {"name": "toxic", "kind": "i64"}])
CORPUS_SQL = "(SELECT d.doc_id AS id, text, lang, source, n_chars, embedding, label, quality, toxic FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, l = (table(spark, sf_dir, n) for n in ("documents", "embeddings", "labels"))  # noqa: E741
    joined = d.join(e, d.doc_id == e.vec_id, "left").join(l, d.doc_id == l.doc_id, "left")
    return joined.select(d.doc_id.alias("id"), "text", "lang", "source", "n_chars", "embedding", "label", "quality", "toxic")


def _folder(spark: SparkSession) -> str:
    """A new folder where spark.checkpoint.dir is, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mosswing-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


_stored: dict[tuple[str, str], Collection] = {}


def stored_corpus(spark: SparkSession, sf_dir: str) -> Collection:
    """The corpus as a collection with its postings: built by the first query of a session that searches texts."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stored:
        c = Collection(spark, _folder(spark), CORPUS)
        c.upsert_frame(corpus(spark, sf_dir))
        c.compact(force=True)
        _stored[key] = c
    return _stored[key]


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>")).first()
    return [float(x) for x in row[0]]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# filters

FILTERS = {
    "filter_eq": ({"field": "lang", "eq": "fr"}, "lang = 'fr'"),
    "filter_in": ({"field": "source", "in": ["src1", "src2", "src3"]}, "source IN ('src1', 'src2', 'src3')"),
    "filter_in_empty": ({"field": "source", "in": []}, "false"),
    "filter_range": ({"field": "n_chars", "gte": 500, "lte": 1500}, "n_chars BETWEEN 500 AND 1500"),
    "filter_range_open": ({"field": "n_chars", "gt": 2000}, "n_chars > 2000"),
    "filter_range_empty": ({"field": "n_chars", "gt": 2000, "lt": 1000}, "false"),
    "filter_multi_op": ({"field": "n_chars", "gt": 100, "gte": 700, "lt": 5000, "is_null": False}, "n_chars >= 700 AND n_chars < 5000"),
    "filter_not_nulls": ({"not": {"field": "quality", "eq": 1}}, "NOT coalesce(quality = 1, false)"),
    "filter_not_range": ({"not": {"field": "label", "gte": 5}}, "NOT coalesce(label >= 5, false)"),
    "filter_and_or_nested": (
        {"and": [{"or": [{"field": "lang", "eq": "de"}, {"field": "lang", "eq": "es"}]}, {"not": {"and": [{"field": "toxic", "eq": 1}, {"field": "n_chars", "gt": 900}]}}]},
        "lang IN ('de', 'es') AND NOT coalesce(toxic = 1 AND n_chars > 900, false)"),
    "filter_empty_and": ({"and": []}, "true"),
    "filter_empty_or": ({"or": []}, "false"),
    "filter_not_empty_or": ({"not": {"or": []}}, "true"),
    "filter_is_null": ({"field": "label", "is_null": True}, "label IS NULL"),
    "filter_is_not_null": ({"field": "embedding", "is_null": False}, "embedding IS NOT NULL"),
    "filter_first_combinator": ({"and": [{"field": "lang", "eq": "en"}], "or": [], "field": "lang", "eq": "fr"}, "lang = 'en'"),
}


def _filter_query(spec: dict) -> Query:
    return lambda spark, d: corpus(spark, d).where(parse_filter(spec, CORPUS).column()).select("id", "lang", "source", "n_chars", "quality")


for _name, (_spec, _where) in FILTERS.items():
    query(_name, f"SELECT id, lang, source, n_chars, quality FROM {CORPUS_SQL} WHERE {_where}")(_filter_query(_spec))

PARTS = Schema.parse([{"name": "words", "kind": "set"}, {"name": "p_size", "kind": "i64"}])


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("words"), F.col("p_size").cast("long").alias("p_size"), "p_name")


def _word(spark: SparkSession, d: str, n: int) -> list[str]:
    return [r[0] for r in _parts(spark, d).select(F.explode("words").alias("w")).distinct().orderBy("w").limit(n).collect()]


_WORDS_SQL = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part ORDER BY w LIMIT {n})"


@query("filter_set_contains", f"SELECT p_partkey AS id, p_name FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT max(w) FROM {_WORDS_SQL.format(n=1)}))")
def filter_set_contains(spark: SparkSession, d: str) -> DataFrame:
    spec = {"field": "words", "eq": _word(spark, d, 1)[-1]}
    return _parts(spark, d).where(parse_filter(spec, PARTS).column()).select("id", "p_name")


@query("filter_set_any", f"SELECT p_partkey AS id, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), (SELECT list(w) FROM {_WORDS_SQL.format(n=3)}))")
def filter_set_any(spark: SparkSession, d: str) -> DataFrame:
    spec = {"field": "words", "in": _word(spark, d, 3)}
    return _parts(spark, d).where(parse_filter(spec, PARTS).column()).select("id", "p_name")


@query("filter_f64_range", "SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_acctbal >= -100.5 AND c_acctbal < 2500")
def filter_f64_range(spark: SparkSession, d: str) -> DataFrame:
    schema = Schema.parse([{"name": "c_acctbal", "kind": "f64"}])
    spec = {"field": "c_acctbal", "gte": -100.5, "lt": 2500.0}
    return table(spark, d, "customer").where(parse_filter(spec, schema).column()).select(F.col("c_custkey").alias("id"), "c_acctbal")


@query("filter_scan_large", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 24 AND NOT (l_returnflag = 'N') GROUP BY 1")
def filter_scan_large(spark: SparkSession, d: str) -> DataFrame:
    schema = Schema.parse([{"name": "l_quantity", "kind": "f64"}, {"name": "l_returnflag", "kind": "enum"}])
    spec = {"and": [{"field": "l_quantity", "gte": 10.0, "lt": 24.0}, {"not": {"field": "l_returnflag", "eq": "N"}}]}
    rows = table(spark, d, "lineitem").where(parse_filter(spec, schema).column())
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


# vectors

_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {n})"
_DIST = {
    "l2": "round(power(list_distance(embedding::DOUBLE[], " + _QV + "), 2), 6)",
    "dot": "round(-list_dot_product(embedding::DOUBLE[], " + _QV + "), 6)",
    "cosine": "round(-list_cosine_similarity(embedding::DOUBLE[], " + _QV + "), 6)",
}


def _knn_sql(metric: str, k: int, where: str = "true", n: int = 0) -> str:
    return f"SELECT id, {_DIST[metric].format(n=n)} AS score FROM {CORPUS_SQL} WHERE embedding IS NOT NULL AND {where} ORDER BY score, id LIMIT {k}"


def _knn_query(metric: str) -> Query:
    return lambda spark, d: knn.exact_knn(corpus(spark, d), "id", "embedding", query_vector(spark, d), metric, 10, digits=6)


for _metric in _DIST:
    query(f"knn_{_metric}", _knn_sql(_metric, 10))(_knn_query(_metric))


@query("knn_filtered", _knn_sql("l2", 10, "lang = 'en' AND n_chars > 800"))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    where = parse_filter({"and": [{"field": "lang", "eq": "en"}, {"field": "n_chars", "gt": 800}]}, CORPUS).column()
    return knn.exact_knn(corpus(spark, d), "id", "embedding", query_vector(spark, d), "l2", 10, where, 6)


@query("knn_null_vectors", f"SELECT count(*) AS n FROM {CORPUS_SQL} WHERE embedding IS NOT NULL")
def knn_null_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    everyone = knn.exact_knn(rows, "id", "embedding", query_vector(spark, d), "l2", None)
    return everyone.agg(F.count("*").alias("n"))


@query("knn_batch", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 = 0),
 s AS (SELECT query_id, vec_id AS id, round(power(list_distance(embedding::DOUBLE[], v), 2), 6) AS score FROM q, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM s)
 SELECT query_id, rank, id, score FROM r WHERE rank <= 10""")  # fmt: skip
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.batch_knn(e, "vec_id", "embedding", queries, "l2", 10)


def _rrf_sql(legs: list[tuple[str, bool]], k: int, c: float = 60) -> str:
    """legs: SQL of (id, score) and whether higher is better."""
    ctes = [f"l{i} AS (SELECT {i} AS leg, id, score, row_number() OVER (ORDER BY score {'DESC' if up else 'ASC'}, id) - 1 AS rank FROM ({sql}))" for i, (sql, up) in enumerate(legs)]
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(len(legs)))
    columns = ", ".join(f"max(CASE WHEN leg = {i} THEN rank END) AS rank{i}, max(CASE WHEN leg = {i} THEN score END) AS score{i}" for i in range(len(legs)))
    return f"WITH {', '.join(ctes)} SELECT id, round(sum(1 / ({c} + rank + 1)), 6) AS score, {columns} FROM ({union}) GROUP BY id ORDER BY score DESC, id LIMIT {k}"


def _flat(found: DataFrame, legs: int) -> DataFrame:
    columns = [F.col("legs")[i][p].cast("bigint" if p == "rank" else "double").alias(f"{p}{i}") for i in range(legs) for p in ("rank", "score")]
    return found.select(*[c for c in found.columns if c != "legs"], *columns)


@query("knn_multi_vector", _rrf_sql([(_knn_sql("dot", 40), False), (_knn_sql("dot", 40, n=1), False)], 10))
def knn_multi_vector(spark: SparkSession, d: str) -> DataFrame:
    legs = tuple(VectorLeg("embedding", tuple(query_vector(spark, d, n))) for n in (0, 1))
    return _flat(hits(corpus(spark, d), SearchRequest(vectors=legs), CORPUS, digits=6), 2)


# text


def _bm25_sql(terms: list[str], k: int, where: str = "true", match_all: bool = False, source: str = CORPUS_SQL) -> str:
    listed = ", ".join(f"'{t}'" for t in terms) or "''"
    return f"""SELECT id, score FROM (WITH toks AS (SELECT id, lang, source, n_chars, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}),
 st AS (SELECT count(*) AS n, greatest(1, count(*) FILTER (WHERE len(t) > 0)) AS filled, sum(len(t)) AS total FROM toks),
 post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM toks) WHERE term IN ({listed}) GROUP BY id, term),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
 SELECT p.id, count(*) AS matched, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / (total / filled)))), 6) AS score
 FROM post p JOIN df USING (term) JOIN toks ON toks.id = p.id, st WHERE {where} GROUP BY p.id) WHERE matched {f'= {len(terms)}' if match_all else '>= 1'} ORDER BY score DESC, id LIMIT {k}"""


def _bm25_query(text: str, k: int = 10, match_all: bool = False, spec: dict | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        request = SearchRequest(text=TextLeg("text", text, match_all), where=parse_filter(spec, CORPUS), k=k, oversample=1, with_documents=False)
        found = stored_corpus(spark, d).search(request, digits=6)
        return found.select(F.col("_id").alias("id"), F.col("legs")[0]["score"].alias("score"))

    return run


query("bm25_any", _bm25_sql(["from", "the", "with"], 10))(_bm25_query("The from, WITH the!"))
query("bm25_all", _bm25_sql(["from", "the", "with"], 10, match_all=True))(_bm25_query("from the with", match_all=True))
query("bm25_all_missing_term", "SELECT id, 0.0::DOUBLE AS score FROM " + CORPUS_SQL + " WHERE false")(_bm25_query("the qqzzqqzz", match_all=True))
query("bm25_filtered", _bm25_sql(["der", "the", "und"], 10, "lang = 'de'"))(_bm25_query("der und the", spec={"field": "lang", "eq": "de"}))
query("bm25_accents", _bm25_sql(["él", "está", "été", "öffnung"], 10))(_bm25_query("ÉTÉ Él ESTÁ Öffnung"))

_NULL_TEXT = "(SELECT doc_id AS id, lang, source, n_chars, CASE WHEN lang = 'fr' THEN NULL ELSE text END AS text FROM documents)"


@query("bm25_null_text", _bm25_sql(["the", "und"], 10, source=_NULL_TEXT).replace("AS t FROM", "AS t0 FROM").replace("toks AS (SELECT id", "toks AS (SELECT *, coalesce(t0, []) AS t FROM (SELECT id").replace(f"FROM {_NULL_TEXT})", f"FROM {_NULL_TEXT}))"))
def bm25_null_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") != "fr", F.col("text")).alias("text"))
    return text_ops.bm25(docs, "id", "text", "the und", 10, digits=6)


@query("bm25_batch", """WITH toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
 st AS (SELECT count(*) AS n, greatest(1, count(*) FILTER (WHERE len(t) > 0)) AS filled, sum(len(t)) AS total FROM toks),
 post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY id, term),
 df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
 q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark),
 s AS (SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / (total / filled)))), 6) AS score
  FROM q JOIN post p USING (term) JOIN df USING (term) JOIN toks ON toks.id = p.id, st GROUP BY query_id, p.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
 SELECT query_id, rank, id, score FROM r WHERE rank <= 5""")  # fmt: skip
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return stored_corpus(spark, d).batch_text("text", queries, 5)


@query("doc_freq", "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.doc_freq(table(spark, d, "documents"), "text")


@query("postings", "SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term, doc_id")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return text_ops.postings(table(spark, d, "documents"), "doc_id", "text").select("term", "id", "tf")


# hybrid

_EN = "lang = 'en'"
_TEXT = ["from", "was"]


def hybrid_request(spark: SparkSession, d: str, **more) -> SearchRequest:
    return SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),), text=TextLeg("text", "from was"), where=parse_filter({"field": "lang", "eq": "en"}, CORPUS), **more)


def _hybrid(**more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = stored_corpus(spark, d).search(hybrid_request(spark, d, with_documents=False, **more), digits=6)
        return _flat(found.select(F.col("_id").alias("id"), "score", "legs"), 2)

    return run


def _legs_sql(k: int) -> list[tuple[str, bool]]:
    return [(_knn_sql("dot", k, _EN), False), (_bm25_sql(_TEXT, k, _EN), True)]


query("hybrid_rrf", _rrf_sql(_legs_sql(40), 10))(_hybrid())
query("hybrid_rrf_k", _rrf_sql(_legs_sql(40), 10, 5))(_hybrid(fusion=Rrf(5)))
query("oversample_depth", _rrf_sql(_legs_sql(5), 5))(_hybrid(k=5, oversample=1))


def _weighted_sql(legs: list[tuple[str, bool]], weights: list[float], k: int) -> str:
    parts = [
        f"SELECT {i} AS leg, id, score, row_number() OVER (ORDER BY score {'DESC' if up else 'ASC'}, id) - 1 AS rank, {w} * {'' if up else '(1 - '}CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END{'' if up else ')'} AS part FROM ({sql})"
        for i, ((sql, up), w) in enumerate(zip(legs, weights))
    ]
    columns = ", ".join(f"max(CASE WHEN leg = {i} THEN rank END) AS rank{i}, max(CASE WHEN leg = {i} THEN score END) AS score{i}" for i in range(len(legs)))
    return f"SELECT id, round(sum(part), 6) AS score, {columns} FROM ({' UNION ALL '.join(parts)}) GROUP BY id ORDER BY score DESC, id LIMIT {k}"


query("hybrid_weighted", _weighted_sql(_legs_sql(40), [0.7, 0.3], 10))(_hybrid(fusion=Weighted((0.7, 0.3))))

_CONSTANT = ("SELECT doc_id AS id, 0.5::DOUBLE AS score FROM documents ORDER BY id LIMIT 20", False)
_RISING = ("SELECT doc_id AS id, n_chars::DOUBLE AS score FROM documents ORDER BY score DESC, id LIMIT 20", True)


@query("weighted_constant_leg", _weighted_sql([_CONSTANT, _RISING], [1.0, 1.0], 40))
def weighted_constant_leg(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    flat = docs.select(F.col("doc_id").alias("id"), F.lit(0.5).alias("score")).orderBy("id").limit(20)
    rising = docs.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(20)
    return _flat(fuse([ranked_leg(flat, 0, False), ranked_leg(rising, 1, True)], Weighted((1.0, 1.0)), 40, 6), 2)


@query("pure_filter", f"SELECT id, 0.0::DOUBLE AS score FROM {CORPUS_SQL} WHERE lang = 'es' ORDER BY id LIMIT 25")
def pure_filter(spark: SparkSession, d: str) -> DataFrame:
    return hits(corpus(spark, d), SearchRequest(where=parse_filter({"field": "lang", "eq": "es"}, CORPUS), k=25), CORPUS).select("id", "score")


@query("search_documents", f"SELECT id, f.score, text, n_chars FROM ({_knn_sql('dot', 10)}) f JOIN {CORPUS_SQL} c USING (id)")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    request = SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),))
    found = search(corpus(spark, d), request, CORPUS, digits=6)
    return found.select("id", F.col("legs")[0]["score"].alias("score"), F.col("doc.text").alias("text"), F.col("doc.n_chars").alias("n_chars"))


def _group_sql(field: str, where: str = "true") -> str:
    found = f"(SELECT c.id, f.score, c.{field} AS g FROM (SELECT id, {_DIST['dot'].format(n=0)} AS score FROM {CORPUS_SQL} WHERE embedding IS NOT NULL AND {where}) f JOIN {CORPUS_SQL} c USING (id))"
    return f"""SELECT id, score0, g AS "group" FROM (SELECT id, score AS score0, g, row_number() OVER (PARTITION BY g IS NULL, coalesce(g::VARCHAR, id::VARCHAR) ORDER BY score, id) AS n FROM {found}) WHERE n = 1 ORDER BY score0, id LIMIT 10"""


def _group_query(field: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """A search that widens until it has enough groups."""
        request = SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),), group_by=field, with_documents=False)
        return search(corpus(spark, d), request, CORPUS, digits=6).select("id", F.col("legs")[0]["score"].alias("score0"), "group")

    return run


query("group_by_source", _group_sql("source"))(_group_query("source"))
query("group_by_null_groups", _group_sql("quality"))(_group_query("quality"))


@query("group_by_widened", """WITH q AS (SELECT text, embedding::DOUBLE[] AS v FROM embeddings, documents WHERE vec_id = 0 AND doc_id = 0) SELECT count(DISTINCT source) AS groups FROM documents JOIN embeddings ON doc_id = vec_id""")
def group_by_widened(spark: SparkSession, d: str) -> DataFrame:
    """All sources that have a vector, by a search that widens until no hit is left."""
    request = SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),), group_by="source", k=1000, with_documents=False)
    return search(corpus(spark, d), request, CORPUS).agg(F.count("*").alias("groups"))


# the command log: events as commands, user_id the id, event_id the position

_UPS = "(SELECT user_id AS id, event_id AS seq, event_type, value FROM events WHERE event_type <> 'error')"
_DELS = "(SELECT user_id AS id, event_id AS seq FROM events WHERE event_type = 'error')"
_LATEST = f"(SELECT * FROM {_UPS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value")
    return e.where("event_type <> 'error'"), e.where("event_type = 'error'").select("id", "seq")


@query("log_last_writer_wins", f"SELECT id, seq, event_type, value FROM {_LATEST}")
def log_last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    return latest(_log(spark, d)[0], "id")


_FOLDED = f"(SELECT * FROM {_LATEST} l WHERE NOT EXISTS (SELECT 1 FROM {_DELS} x WHERE x.id = l.id AND x.seq > l.seq))"


@query("log_delete_then_upsert", f"SELECT id, seq, event_type, value FROM {_FOLDED}")
def log_delete_then_upsert(spark: SparkSession, d: str) -> DataFrame:
    return fold(*_log(spark, d), "id")


@query("log_delete_where_positional", f"SELECT id, seq, event_type, value FROM {_FOLDED} WHERE NOT (seq < (SELECT max(event_id) FROM events) - 100 AND event_type = 'view')")
def log_delete_where_positional(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "events").agg(F.max("event_id")).first()[0] - 100
    return fold(*_log(spark, d), "id", [(at, F.col("event_type") == "view")])


_NEAR_END = "(SELECT max(event_id) - 100 FROM events)"


@query("log_delete_where_count", f"""SELECT count(*) AS count FROM (SELECT * FROM (SELECT * FROM {_UPS} WHERE seq < {_NEAR_END} QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) l
 WHERE NOT EXISTS (SELECT 1 FROM {_DELS} x WHERE x.id = l.id AND x.seq > l.seq AND x.seq < {_NEAR_END})) WHERE event_type = 'click'""")
def log_delete_where_count(spark: SparkSession, d: str) -> DataFrame:
    at = table(spark, d, "events").agg(F.max("event_id")).first()[0] - 100
    return delete_where_counts(*_log(spark, d), "id", at, F.col("event_type") == "click")


@query("keyed_reorder", f"SELECT id AS key, max(seq) AS ord FROM {_UPS} GROUP BY id")
def keyed_reorder(spark: SparkSession, d: str) -> DataFrame:
    """Text ids in a collection, rewritten by a second commit: each sorts by its last write."""
    c = Collection(spark, _folder(spark), Schema.parse([{"name": "event_type", "kind": "enum"}]))
    rows = _log(spark, d)[0].withColumn("id", F.col("id").cast("string"))
    half = rows.agg(F.max("seq")).first()[0] // 2
    c.upsert_frame(rows.where(F.col("seq") > half), "id", "seq")
    c.upsert_frame(rows.where(F.col("seq") <= half), "id", "seq")
    c.upsert_frame(rows, "id", "seq")
    return c.snapshot().select(F.col("_key").cast("long").alias("key"), F.col("_ord.pos").alias("ord"))


_PATCHES = "(SELECT user_id * 7 AS id, event_id AS seq, event_type FROM events WHERE event_type IN ('click', 'view'))"


def _patches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("click", "view"))
    return e.select((F.col("user_id") * 7).alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("set_n_chars"), F.col("event_id").alias("n_chars"),
        (F.col("event_type") == "view").alias("set_lang"), F.lit(None).cast("string").alias("lang"))


@query("patch_set_clear", f"""SELECT d.doc_id AS id, coalesce(c.seq, d.n_chars) AS n_chars, CASE WHEN v.id IS NOT NULL THEN NULL ELSE lang END AS lang FROM documents d
 LEFT JOIN (SELECT id, max(seq) AS seq FROM {_PATCHES} WHERE event_type = 'click' GROUP BY id) c ON c.id = d.doc_id
 LEFT JOIN (SELECT DISTINCT id FROM {_PATCHES} WHERE event_type = 'view') v ON v.id = d.doc_id""")
def patch_set_clear(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    return apply_patches(live, _patches(spark, d), "id", ["n_chars", "lang"])


@query("patch_missing", f"SELECT count(DISTINCT p.id) AS patched FROM {_PATCHES} p JOIN documents d ON d.doc_id = p.id")
def patch_missing(spark: SparkSession, d: str) -> DataFrame:
    c = Collection(spark, _folder(spark), Schema.parse([{"name": "n_chars", "kind": "i64"}, {"name": "lang", "kind": "enum"}]))
    c.upsert_frame(table(spark, d, "documents"), "doc_id")
    return spark.createDataFrame([(c.patch_frame(_patches(spark, d))["patched"],)], "patched long")


# tenants, retention, reports


@query("tenant_scope", "SELECT doc_id AS id, n_chars FROM documents WHERE source = 'src3' AND lang = 'en'")
def tenant_scope(spark: SparkSession, d: str) -> DataFrame:
    mine = _by_source(spark, d).for_tenant("src3").snapshot()
    return mine.where(parse_filter({"field": "lang", "eq": "en"}, _PLAIN).column()).select(F.col("_id").alias("id"), "n_chars")


_PLAIN = Schema.parse([{"name": "lang", "kind": "enum"}, {"name": "n_chars", "kind": "i64"}])


def _by_source(spark: SparkSession, d: str) -> Collection:
    """Documents of which each source is a tenant."""
    c = Collection(spark, _folder(spark), _PLAIN)
    c.upsert_frame(table(spark, d, "documents"), "doc_id", tenant_col="source")
    return c


@query("tenant_unscoped", "SELECT source AS tenant, count(*) AS n, sum(doc_id) AS ids FROM (SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, 'other' FROM documents) GROUP BY source")
def tenant_unscoped(spark: SparkSession, d: str) -> DataFrame:
    """Every id belongs to two tenants; a read of all tenants keeps them apart."""
    c = _by_source(spark, d)
    c.for_tenant("other").upsert_frame(table(spark, d, "documents"), "doc_id")
    rows = c.snapshot().dropDuplicates(["_ord"])
    return rows.groupBy(F.col("_tenant").alias("tenant")).agg(F.count("*").alias("n"), F.sum("_id").alias("ids"))


@query("erase_tenant", "SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source")
def erase_tenant(spark: SparkSession, d: str) -> DataFrame:
    c = _by_source(spark, d)
    c.erase_tenant("src3")
    return c.snapshot().groupBy(F.col("_tenant").alias("source")).agg(F.count("*").alias("n"))


_NOW = 803_000_000_000


def _retained() -> Predicate:
    return unexpired("expires", _NOW)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("expires"))


_ORDERS = "(SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN epoch_ms(o_orderdate) END AS expires FROM orders)"


@query("retention_visible", f"SELECT id, expires FROM {_ORDERS} WHERE NOT coalesce(expires <= {_NOW}, false)")
def retention_visible(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(_retained().column())


@query("retention_sweep_count", f"SELECT count(*) AS count FROM {_ORDERS} WHERE expires <= {_NOW}")
def retention_sweep_count(spark: SparkSession, d: str) -> DataFrame:
    c = Collection(spark, _folder(spark), Schema.parse([{"name": "expires", "kind": "date"}]), expires="expires", clock=lambda: _NOW)
    c.upsert_frame(_orders(spark, d))
    return spark.createDataFrame([(c.sweep()["count"],)], "count long")


@query("deletion_report", f"SELECT u.id, CASE WHEN f.id IS NULL THEN 'deleted' ELSE 'not proven' END AS verdict FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN {_FOLDED} f USING (id)")
def deletion_report(spark: SparkSession, d: str) -> DataFrame:
    """The events as commands in one commit; then whether any layer of the collection still shows each id."""
    c = Collection(spark, _folder(spark), Schema.parse([{"name": "event_type", "kind": "enum"}]))
    events = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type")
    apply_batch(c, events.withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert")), "events", 0)
    return c.presence(events.select("id").distinct())


# snapshots on disk and the stream into them


@query("store_lifecycle", "SELECT doc_id AS id, CASE WHEN doc_id = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE lang <> 'de' AND doc_id NOT IN (1, 2) AND NOT (n_chars < 400 AND lang = 'en')")
def store_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Upsert, delete by id and by filter, patch, compaction; each a commit."""
    schema = Schema.parse([{"name": "lang", "kind": "enum"}, {"name": "n_chars", "kind": "i64"}])
    c = Collection(spark, _folder(spark), schema)
    c.upsert_frame(table(spark, d, "documents").where("lang <> 'de' OR doc_id >= 0"), "doc_id")
    c.delete_where({"field": "lang", "eq": "de"})
    c.delete([1, 2, 10**9])
    c.compact(force=True)
    c.delete_where({"and": [{"field": "n_chars", "lt": 400}, {"field": "lang", "eq": "en"}]})
    c.patch([{"id": 0, "set": {"lang": "xx"}}, {"id": 10**9, "set": {"lang": "yy"}}])
    return c.snapshot().select(F.col("_id").alias("id"), "lang", "n_chars")


@query("stream_log_fold", f"SELECT id, event_type, value FROM {_FOLDED}")
def stream_log_fold(spark: SparkSession, d: str) -> DataFrame:
    """The same fold through Structured Streaming into a snapshot store."""
    schema = Schema.parse([{"name": "event_type", "kind": "enum"}, {"name": "value", "kind": "f64"}])
    folder = _folder(spark)
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    commands = stream.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "value", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    c = Collection(spark, f"{folder}/data", schema)
    follow(commands, c, f"{folder}/checkpoint").awaitTermination()
    return c.snapshot().select(F.col("_id").alias("id"), "event_type", "value")


# generators and approximate search: SQL can't express their hashes and training


@query("takedown_schedule")
def takedown_schedule(spark: SparkSession, d: str) -> DataFrame:
    return synth.takedowns(spark, 10_000, 500, 60_000)


@query("synthetic_flags")
def synthetic_flags(spark: SparkSession, d: str) -> DataFrame:
    return synth.attributes(spark, 20_000)


_TEN = "SELECT id, round(score, 4) AS score FROM (" + _knn_sql("l2", 10).replace(CORPUS_SQL, "(SELECT vec_id AS id, embedding FROM embeddings)") + ")"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("id", F.round(F.round("score", 6), 4).alias("score"))


@query("sq8_rerank", _TEN)
def sq8_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Stored codes; four times as many candidates as are asked for keep all true neighbours here."""
    e = table(spark, d, "embeddings")
    sq8 = knn.Sq8.fit(e, "embedding")
    coded, path = e.withColumn("q8", sq8.codes("embedding")), _folder(spark)
    coded.write.parquet(path)
    return _rounded(knn.sq8_knn(spark.read.parquet(path), sq8, "vec_id", "embedding", query_vector(spark, d), "l2", 10))


@query("pq_rerank_recall", "SELECT true AS enough")
def pq_rerank_recall(spark: SparkSession, d: str) -> DataFrame:
    """Product codes, the best tenth of the table ranked again: whether nine of the ten true neighbours are found."""
    e = table(spark, d, "embeddings")
    pq = knn.Pq.fit(e, "embedding")
    v = query_vector(spark, d)
    got = knn.pq_knn(pq.encoded(e, "embedding"), pq, "vec_id", "embedding", v, "l2", 10).agg(F.collect_list("id").alias("got"))
    truth = knn.exact_knn(e, "vec_id", "embedding", v, "l2", 10).agg(F.collect_list("id").alias("truth"))
    return got.crossJoin(truth).select((evaluate.recall("got", "truth", 10) >= 0.9).alias("enough"))  # one row each


@query("ivf_probe_recall", "SELECT true AS enough")
def ivf_probe_recall(spark: SparkSession, d: str) -> DataFrame:
    """A clustered collection against an exact request, over eight queries: whether recall is 0.9 on average."""
    e = table(spark, d, "embeddings")
    c = Collection(spark, _folder(spark), Schema.parse([{"name": "embedding", "kind": "vector", "dims": 64, "metric": "l2"}]))
    c.upsert_frame(e, "vec_id")
    c.cluster("embedding", 8)
    centres, rows = c._centres(c.manifest().lists), c.snapshot()
    found = 0.0
    for n in range(8):
        v = query_vector(spark, d, n)
        near = knn.nearest_centres(centres, v, "l2", 6)
        got = knn.exact_knn(rows, "_id", "embedding", v, "l2", 10, F.col("_list").isin(near)).agg(F.collect_list("id").alias("got"))
        truth = knn.exact_knn(e, "vec_id", "embedding", v, "l2", 10).agg(F.collect_list("id").alias("truth"))
        found += got.crossJoin(truth).select(evaluate.recall("got", "truth", 10)).first()[0] / 8  # one row each
    return spark.createDataFrame([(found >= 0.9,)], "enough boolean")


@query("ivf_search", _rrf_sql([(_knn_sql("dot", 40), False)], 10))
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """A clustered collection whose few rows take the exact route; the same answers as without lists."""
    c = Collection(spark, _folder(spark), CORPUS)
    c.upsert_frame(corpus(spark, d))
    c.cluster("embedding", 8)
    request = SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),), with_documents=False)
    return _flat(c.search(request, digits=6).select(F.col("_id").alias("id"), "score", "legs"), 1)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search of `entry`: a vector leg and a text leg under a filter, fused by reciprocal ranks."""
    request = SearchRequest(vectors=(VectorLeg("embedding", tuple(query_vector(spark, d))),), text=TextLeg("text", "in the"), where=parse_filter({"field": "lang", "eq": "en"}, CORPUS))
    return _flat(hits(corpus(spark, d), request, CORPUS, digits=6), 2)


