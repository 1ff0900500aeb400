"""Retrieval, market and evaluation queries. Chunk: a documents row; owner: its source; query: a benchmark row."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answer, market, retrieval as R
from ..operators.vector_index import VectorIndex
from ..operators.word_index import WordIndex, Words, files_fingerprint
from ..stored import shared_dir
from .common import quoted, table, tokens_sql


def _index(spark: SparkSession, sf: str, name: str, docs: DataFrame | None = None, doc: str = "doc_id", kind: str = "bigint", plain: bool = False) -> Words:
    """The stored index of a table's documents, or of texts made of them; brought up to date where the table's files have changed."""
    where = f"{shared_dir(spark).rstrip('/')}/words/{hashlib.sha256(sf.encode()).hexdigest()[:16]}-{name}"
    index = WordIndex(spark, where, kind, words_of=T.meaningful_terms if plain else T.tokens, plain=plain)
    return index.refresh(table(spark, sf, "documents") if docs is None else docs, files_fingerprint(spark, f"{sf}/documents.parquet"), doc)


def _bm25(spark: SparkSession, sf: str, k: int, fill: bool = True) -> DataFrame:
    return R.bm25(table(spark, sf, "benchmark"), table(spark, sf, "documents"), k, query="item_id", fill=fill, words=_index(spark, sf, "texts"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 20).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vec_id divisible by 50 asks, against all vectors."""
    v = table(spark, sf, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return R.knn(q, v.select("vec_id", F.col("embedding").alias("v")), 20).select("query", "vec_id", (F.round("distance", 4) + 0.0).alias("distance"), "rank")


def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    """As knn_topk, from the stored index of inverted lists; about nine tenths of its rows or more."""
    v = table(spark, sf, "embeddings")
    where = f"{shared_dir(spark).rstrip('/')}/vectors/{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    index = VectorIndex(spark, where).refresh(v, files_fingerprint(spark, f"{sf}/embeddings.parquet"))
    found = index.search(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 20)
    return found.select("query", "vec_id", (F.round("distance", 4) + 0.0).alias("distance"), "rank")


def _second_list(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking by the number of shared meaningful words, in place of the dense one."""
    return _index(spark, sf, "meaningful", plain=True).search(table(spark, sf, "benchmark"), 20, "item_id", fill=False).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    a = _second_list(spark, sf).select(F.col("item_id").alias("query"), F.lit(0).alias("list_no"), "rank", F.col("doc_id").alias("key"))
    b = _bm25(spark, sf, 20).select("query", F.lit(1).alias("list_no"), "rank", F.col("doc").alias("key"))
    return R.rrf(a.unionByName(b)).select(F.col("query").alias("item_id"), F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "fused_rank")


def _groups(spark: SparkSession, sf: str, k: int = 6) -> DataFrame:
    hits = _bm25(spark, sf, 30, fill=False).join(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("owner")), "doc")
    return R.group_by_owner(hits, k)


def rank_sources(spark: SparkSession, sf: str) -> DataFrame:
    g = _groups(spark, sf)
    return g.select(F.col("query").alias("item_id"), F.col("owner").alias("source"), F.round("best_score", 4).alias("best_score"), "n_hits", F.round("score", 4).alias("score"), "rank", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


def passage_search(spark: SparkSession, sf: str) -> DataFrame:
    """The four best passages of both lists. What is searched names the source, its number and language; every fifth chunk has no id,
    and goes by the hash of its text. The fused score stands for an outside reranker's, which halves it for French."""
    d = table(spark, sf, "documents").withColumn("number", F.regexp_extract("source", r"(\d+)", 1))
    key = R.chunk_key(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))), F.concat_ws("|", F.col("doc_id").cast("string"), "text"))
    c = d.select(key.alias("key"), "doc_id", "lang", R.index_text(F.col("text"), F.concat(F.lit("IS "), "number"), F.col("lang"), F.col("source"), F.col("number")).alias("text"))
    dense = _second_list(spark, sf).withColumnRenamed("item_id", "query").join(c.select("doc_id", "key"), "doc_id").select("query", "rank", "key")

    def scorer(x: DataFrame) -> DataFrame:
        return x.join(c.select("key", "lang"), "key").withColumn("rerank_score", F.when(F.col("lang") == "fr", F.col("score") / 2).otherwise(F.col("score")))

    words = _index(spark, sf, "passages", c.select("key", "text"), "key", "string")
    out = R.passage_search(table(spark, sf, "benchmark"), c.select("key", "text"), dense, scorer, query="item_id", words=words)
    return out.select(F.col("query").alias("item_id"), "key", F.round("rerank_score", 6).alias("score"), "rank")


def source_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """The best three documents of each query as one block of marked sources."""
    top = _bm25(spark, sf, 3).select("query", F.col("doc").alias("key"), "rank")
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), T.citation(F.lit(None).cast("string"), F.col("source"), (F.col("doc_id") % 3).cast("int"), F.lit("text")).alias("citation"), F.upper("lang").alias("title"), "text")
    return answer.sources(top, c).select(F.col("query").alias("item_id"), F.length("context").cast("long").alias("n_chars"), F.sha2("context", 256).alias("context_sha256"))


def merge_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations are the requests, their turns the passages."""
    c = table(spark, sf, "conversations").select(F.struct(F.col("conv_id").alias("request"), F.col("turn").alias("passage")).alias("pid"), "text")
    hits = R.bm25(c, table(spark, sf, "documents"), 20, query="pid", fill=False, words=_index(spark, sf, "texts")).join(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("owner")), "doc")
    m = R.merge_passages(R.group_by_owner(hits, 4).select("query.request", "query.passage", "owner", "best_score", "chunks"))
    return m.select(F.col("request").alias("conv_id"), F.col("owner").alias("source"), F.round("best_score", 4).alias("best_score"), "passage_hits", F.round("score", 4).alias("score"), "rank")


def _needs(spark: SparkSession, sf: str) -> DataFrame:
    """Every part asks: for things of its name and type, or with a word that no category has."""
    text = F.concat_ws(" ", F.lit("the supply of"), "p_name", F.when(F.col("p_partkey") % 5 == 0, F.lit("zzgizmo")).otherwise(F.lower("p_type")), F.when(F.col("p_partkey") % 7 == 0, F.lit("polished")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("product_name")).distinct().withColumn("category", F.col("product_name"))


def idf_keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    return market.idf_match(_needs(spark, sf), _categories(spark, sf), 15).select("query", "category", F.round("score", 4).alias("score"), "hits", "rank")


def suggest_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Every third part cites its own category outright."""
    words = market.idf_matches(_needs(spark, sf), _categories(spark, sf), 15)
    exact = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("query"), F.concat_ws(" ", "p_name", "p_type").alias("category"), F.lit(1).alias("position"))
    return market.suggest(exact, words).select("query", "category", "tier", "score", "rank")


def unknown_terms(spark: SparkSession, sf: str) -> DataFrame:
    asked = _needs(spark, sf).select("query_id", F.explode(F.array_distinct(T.query_terms(F.col("text")))).alias("word"))
    return asked.join(market.vocabulary(_categories(spark, sf)), "word", "left_anti")


def eval_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Cases: the items whose text some document holds. Expected: the source of the first such document; measured on the ranked sources."""
    b, d = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    held = market.holders(d, b.select(F.col("text").alias("needle")), "doc_id", "text").groupBy("needle").agg(F.min("key").alias("doc_id"))
    want = b.join(held, b["text"] == held["needle"]).join(d.select("doc_id", F.col("source").alias("expected")), "doc_id").select(F.col("item_id").alias("query"), "expected")
    r = answer.evaluate(_groups(spark, sf, 5), want, 5)
    return r.select("n", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")), "not_found")


def source_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct citations of each query's kept chunks, in order of first appearance."""
    g = _groups(spark, sf, 3).select("query", "rank", F.posexplode("chunks").alias("pos", "doc_id")).join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    c = g.withColumn("citation", T.citation(F.lit(None).cast("string"), F.col("source"), (F.col("doc_id") % 3).cast("int"), F.when(F.col("lang") == "de", "ocr-cached").otherwise("text")))
    first = c.groupBy("query", "citation").agg(F.min(F.struct("rank", "pos")).alias("first"))
    return R.ranked(first, ["query"], [F.asc("first")], name="place").select(F.col("query").alias("item_id"), "citation", "place")


def _hits(text: str, rows: str, key: str, docs: str = "documents") -> str:
    """Common table expressions: post, asked and hits of BM25 of `rows` (key, text) against `docs` (doc_id, text)."""
    return f"""
post AS (SELECT doc_id, token, COUNT(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM {docs})) GROUP BY doc_id, token),
size AS (SELECT COUNT(*) AS n, AVG(len(t)) AS avgdl FROM (SELECT {tokens_sql('text')} AS t FROM {docs})),
df AS (SELECT token, ln(n - c + 0.5) - ln(c + 0.5) AS raw FROM (SELECT token, COUNT(*) AS c FROM post GROUP BY token), size),
idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT AVG(raw) FROM df) ELSE raw END AS idf FROM df),
asked AS (SELECT query, token, COUNT(*) AS qn FROM (SELECT {key} AS query, unnest({tokens_sql(text)}) AS token FROM {rows}) GROUP BY query, token),
hits AS (SELECT query, doc_id, SUM(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idf USING (token) JOIN post USING (token), size GROUP BY query, doc_id)"""


_BM25 = f"WITH {_hits('text', 'benchmark', 'item_id')}"
_FILLED = "top AS (SELECT b.item_id AS query, d.doc_id, COALESCE(score, 0) AS score, row_number() OVER (PARTITION BY b.item_id ORDER BY round(COALESCE(score, 0), 6) DESC, d.doc_id) AS rank FROM benchmark b CROSS JOIN documents d LEFT JOIN hits h ON h.query = b.item_id AND h.doc_id = d.doc_id QUALIFY rank <= 20)"
_OWNED = """
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM hits QUALIFY rank <= {pool}),
g0 AS (SELECT query, source AS owner, MAX(score) AS best_score, COUNT(*) AS n_hits, MIN(rank) AS seen, list(doc_id ORDER BY rank)[1:3] AS chunks FROM h JOIN documents USING (doc_id) GROUP BY query, source),
g AS (SELECT *, best_score + ln(1 + n_hits) AS score, row_number() OVER (PARTITION BY query ORDER BY round(best_score + ln(1 + n_hits), 6) DESC, seen) AS rank FROM g0 QUALIFY rank <= {k})"""
_SHARED = f"""
q AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(T.FILLER_WORDS)})))) AS w FROM benchmark),
d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(T.FILLER_WORDS)})))) AS w FROM documents),
s AS (SELECT item_id AS query, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY COUNT(*) DESC, doc_id) AS rank FROM q JOIN d USING (w) GROUP BY item_id, doc_id QUALIFY rank <= 20)"""
_CATEGORIES = "cat AS (SELECT DISTINCT p_name || ' ' || p_type AS category FROM part)"
_IDF = f"""
needs AS (SELECT p_partkey AS query, 'the supply of ' || p_name || ' ' || CASE WHEN p_partkey % 5 = 0 THEN 'zzgizmo' ELSE lower(p_type) END || CASE WHEN p_partkey % 7 = 0 THEN ' polished' ELSE '' END AS text FROM part), {_CATEGORIES},
w AS (SELECT category, len(l) AS n_words, unnest(l) AS word FROM (SELECT category, list_distinct(regexp_extract_all(lower(category), '[a-z0-9]{{2,}}')) AS l FROM cat)),
i AS (SELECT word, ln((SELECT COUNT(*) FROM cat) / COUNT(*)) AS idf FROM w GROUP BY word),
a AS (SELECT query, word, idf FROM (SELECT query, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({quoted(T.QUERY_NOISE)})))) AS word FROM needs) JOIN i USING (word) WHERE idf > 0),
m0 AS (SELECT query, category, SUM(idf) / (SELECT SUM(idf) FROM a b WHERE b.query = a.query) * (1 + COUNT(*) / any_value(n_words)) AS score, array_to_string(list(word ORDER BY word)[1:4], ', ') AS hits FROM a JOIN w USING (word) GROUP BY query, category),
m AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, category) AS rank FROM m0 WHERE score >= 0.1 QUALIFY rank <= 15)"""
SQL = {
    "bm25_topk": f"{_BM25}, {_FILLED} SELECT query AS item_id, doc_id, round(score, 4) AS score, rank FROM top",
    "knn_topk": "SELECT a.vec_id AS query, b.vec_id, round(1 - d, 4) + 0.0 AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - d, 6), b.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a CROSS JOIN embeddings b, LATERAL (SELECT list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS d) QUALIFY rank <= 20",
    "rrf_fuse": f"""{_BM25}, {_FILLED}, {_SHARED},
u AS (SELECT query, doc_id, 0 AS list_no, rank FROM s UNION ALL SELECT query, doc_id, 1, rank FROM top)
SELECT query AS item_id, doc_id, round(SUM(1 / (60 + rank)), 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(SUM(1 / (60 + rank)), 9) DESC, MIN(list_no * 1000 + rank)) AS fused_rank FROM u GROUP BY query, doc_id""",
    "rank_sources": f"{_BM25}, {_OWNED.format(pool=30, k=6)} SELECT query AS item_id, owner AS source, round(best_score, 4) AS best_score, n_hits, round(score, 4) AS score, rank, array_to_string(chunks, ',') AS chunks FROM g",
    "passage_search": f"""WITH k AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN 'c' || doc_id ELSE 'sha:' || sha1(doc_id || '|' || text) END AS key, 'IS ' || regexp_extract(source, '([0-9]+)', 1) || ' ' || lang || ' ' || source || ' ' || regexp_extract(source, '([0-9]+)', 1) || ' ' || text AS said FROM documents),
{_hits('text', 'benchmark', 'item_id', '(SELECT key AS doc_id, said AS text FROM k)')},
top AS (SELECT b.item_id AS query, d.key, row_number() OVER (PARTITION BY b.item_id ORDER BY round(COALESCE(score, 0), 6) DESC, d.key) AS rank FROM benchmark b CROSS JOIN k d LEFT JOIN hits h ON h.query = b.item_id AND h.doc_id = d.key QUALIFY rank <= 20), {_SHARED},
u AS (SELECT query, key, 0 AS list_no, rank FROM s JOIN k USING (doc_id) UNION ALL SELECT query, key, 1, rank FROM top),
f AS (SELECT query, key, SUM(1 / (60 + rank)) AS score, row_number() OVER (PARTITION BY query ORDER BY round(SUM(1 / (60 + rank)), 9) DESC, MIN(list_no * 1000 + rank)) AS fused_rank FROM u GROUP BY query, key),
x AS (SELECT query, key, fused_rank, CASE WHEN lang = 'fr' THEN score / 2 ELSE score END AS score FROM f JOIN k USING (key))
SELECT query AS item_id, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, fused_rank) AS rank FROM x QUALIFY rank <= 4""",
    "source_contexts": f"""{_BM25}, {_FILLED}, c AS (SELECT query, string_agg('<source id="' || rank || '" standard="' || source || (CASE WHEN doc_id % 3 <> 0 THEN ', page ' || (doc_id % 3) ELSE '' END) || '">' || chr(10) || upper(lang) || chr(10) || chr(10) || trim(text, ' ') || chr(10) || '</source>', chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query)
SELECT query AS item_id, CAST(length(context) AS BIGINT) AS n_chars, sha256(context) AS context_sha256 FROM c""",
    "merge_passages": f"""WITH p AS (SELECT {{'c': conv_id, 't': turn}} AS pid, text FROM conversations), {_hits('text', 'p', 'pid')}, {_OWNED.format(pool=20, k=4)},
m AS (SELECT query.c AS request, owner, MAX(best_score) AS best_score, COUNT(*) AS passage_hits, MIN(query.t) AS seen FROM g GROUP BY request, owner)
SELECT request AS conv_id, owner AS source, round(best_score, 4) AS best_score, passage_hits, round(best_score + ln(1 + passage_hits), 4) AS score, row_number() OVER (PARTITION BY request ORDER BY round(best_score + ln(1 + passage_hits), 6) DESC, seen, owner) AS rank FROM m QUALIFY rank <= 6""",
    "idf_keyword_match": f"WITH {_IDF} SELECT query, category, round(score, 4) AS score, hits, rank FROM m",
    "suggest_categories": f"""WITH {_IDF}, e AS (SELECT p_partkey AS query, p_name || ' ' || p_type AS category, 1 AS place FROM part WHERE p_partkey % 3 = 0),
u AS (SELECT query, category, 0 AS tier, place, CAST(100 AS DOUBLE) AS score FROM e UNION ALL SELECT query, category, 1, rank, round_even(score, 2) FROM m WHERE (query, category) NOT IN (SELECT query, category FROM e))
SELECT query, category, tier, score, row_number() OVER (PARTITION BY query ORDER BY tier, place, category) AS rank FROM u QUALIFY rank <= 5""",
    "unknown_terms": f"WITH {_IDF} SELECT query AS query_id, word FROM (SELECT query, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ({quoted(T.QUERY_NOISE)})))) AS word FROM needs) WHERE word NOT IN (SELECT word FROM i)",
    "eval_recall": f"""{_BM25}, {_OWNED.format(pool=30, k=5)}, r AS (SELECT item_id, rank FROM (SELECT b.item_id, arg_min(d.source, d.doc_id) AS owner FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id) b LEFT JOIN g ON g.query = item_id AND g.owner = b.owner)
SELECT COUNT(*) AS n, round(AVG(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(AVG(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(AVG(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(SUM(COALESCE(1.0 / rank, 0)) / COUNT(*), 6) AS mrr, COUNT(*) FILTER (WHERE rank IS NULL) AS not_found FROM r""",
    "source_citations": f"""{_BM25}, {_OWNED.format(pool=30, k=3)}, c AS (SELECT query, rank, generate_subscripts(chunks, 1) AS pos, unnest(chunks) AS doc_id FROM g),
t AS (SELECT query, rank * 100 + pos AS seen, source || (CASE WHEN doc_id % 3 <> 0 THEN ', page ' || (doc_id % 3) ELSE '' END) || (CASE WHEN lang = 'de' THEN ' [OCR]' ELSE '' END) AS citation FROM c JOIN documents USING (doc_id))
SELECT query AS item_id, citation, row_number() OVER (PARTITION BY query ORDER BY MIN(seen)) AS place FROM t GROUP BY query, citation""",
}
QUERIES = {f.__name__: f for f in (rank_sources, bm25_topk, knn_topk, knn_index, rrf_fuse, passage_search, source_contexts, merge_passages, idf_keyword_match, suggest_categories, unknown_terms, eval_recall, source_citations)}
