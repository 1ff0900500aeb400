"""Extraction, routing, labelling and whole-answer queries. Extractors that SQL cannot follow over any text are given texts made from
every row of a table, whose contents SQL works out from the row's key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..operators import answer, decide, extract, graph, incremental as inc, market
from ..sources import documents as D
from ..sources import tables as S
from ..sources.pages import Model, route_scripts
from .change_queries import _F, _R, _files, _resolved
from .common import table
from .retrieval_queries import _categories, _index
from .text_queries import _roles


def _pick(key: Column, *forms: Column) -> Column:
    """One of several forms, by the key's remainder."""
    out = forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        out = F.when(key % len(forms) == i, f).otherwise(out)
    return out


def _five_digits(key: str) -> Column:
    """A number of five digits, as ids and citations have them."""
    return (F.col(key) % 80_000 + 10_000).cast("string")


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def category_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name with a standard, a version, a tag or a mark, in five forms."""
    n, what = _five_digits("p_partkey"), F.concat_ws(" ", F.initcap("p_name"), "p_type")
    forms = (
        _said(what, " (V", F.col("p_size").cast("string"), ") Conforming To Is ", n),
        _said(what, " as per IS ", n, " : 1984 (Q", F.col("p_size").cast("string"), ")"),
        _said(what, " ISI Marked to Is ", n, " (Part 2)"),
        _said(what, " IS ", n, " (Part II / Sec 1) and IS ", n, " (Part 2/Sec 1) Under BIS Scheme - I"),
        what,
    )
    c = table(spark, sf, "part").select("p_partkey", I.parse_category(_pick(F.col("p_partkey"), *forms)).alias("c")).select("p_partkey", "c.*")
    keys = F.array_join(F.transform("standards", lambda s: I.standard_key(s["doc_type"], s["number"], s["part"], s["section"])), ";")
    return c.select("p_partkey", "product_name", keys.alias("standard_keys"), "version", "listing_tag", "certification")


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """The citations of every document, a page each, which begins with one of three forms; every seventh cites itself."""
    d, n = table(spark, sf, "documents"), _five_digits("doc_id")
    forms = (
        _said("See IS ", n, " for the details of concrete\n"),
        _said("2 REFERENCES\nIS ", n, " : 2000 Plain and reinforced concrete - Code of practice\nIS ", (F.col("doc_id") % 80_000 + 10_001).cast("string"), " (Part 2)\n"),
        _said("Rounding off numerical values shall follow IS ", n, " : 1960 always\n"),
    )
    own = F.when(F.col("doc_id") % 7 == 0, n)
    return extract.references(d.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), _said(_pick(F.col("doc_id"), *forms), F.coalesce("text", F.lit(""))).alias("text"), own.alias("self_number"), F.lit(None).cast("string").alias("self_part")))


def reference_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).select("doc", "to_number", "to_part", "cited_year", "cited_title", "role", "page", "confidence", "source")


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction, resolution and ranking in one: the outgoing edges of every document; each part is a held standard."""
    none, number = F.lit(None).cast("string"), (F.col("p_partkey") + 10_000).cast("string")
    held = table(spark, sf, "part").select(_said("IS ", number, " : 2001").alias("standard_id"), number.alias("number"), none.alias("part"), none.alias("section"), F.lit("2001").alias("year"), F.col("p_partkey").alias("position"))
    r = graph.resolve(_references(spark, sf).withColumn("edge_no", F.struct(F.col("to_number").cast("long"), "to_part", "to_section")), held)
    return graph.outgoing(r, "low", source="doc").select("doc", "to_number", "resolved_id", "edition_note", "rank")


def html_strategy(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's HTML after names that only one strategy, or a later one in far greater number, finds."""
    k = F.col("page_id")
    many = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), f), ",")
    forms = (
        many(3 + k % 5, lambda i: _said('<a href="/search?q=', i.cast("string"), '">Pump ', i.cast("string"), " (V1)</a>")),
        _said('<a href="/search?q=1">Pump (V1)</a><script>var x={', many(8 + k % 6, lambda i: _said('"n', i.cast("string"), '":"Valve type ', i.cast("string"), ' (V2)"')), "}</script>"),
        F.lit('<div class="product-card">Pipe as Conforming To IS 1239</div>'),
        F.lit('<img alt="Rope (V1)">'),
        F.lit("<p>Wire ISI Marked</p><p>wire isi marked</p>"),
    )
    p = table(spark, sf, "pages").select("page_id", _said(_pick(k, *forms), F.coalesce("html", F.lit(""))).alias("html"))
    return extract.html_categories(p).groupBy("page_id", "found_by").agg(F.count("*").alias("n"))


def discover_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a table made of the last five digits of their number, as an id has six at most: three rows, two ids."""
    n = (F.col("page_id") % 100_000).cast("string")
    html = F.concat(F.lit("<table><tr><td>IS "), n, F.lit(" : 2000</td><td>a</td></tr><tr><td>is  "), n, F.lit(" : 2000</td><td>b</td></tr><tr><td>IS 9"), n, F.lit("</td></tr></table>"), F.when(F.col("page_id") % 5 == 0, F.lit('<a href="?page=2">next</a>')).otherwise(F.lit("")))
    return extract.discovered_ids(table(spark, sf, "pages").select("page_id", html.alias("html")))


def page_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Every third page has only its source's name as text, OCR has the whole; every seventh claims a legacy font."""
    d = table(spark, sf, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text")).alias("text"), F.col("text").alias("ocr_text"), (F.col("doc_id") % 7 == 0).alias("legacy_font"))
    p = D.page_table(d)
    return p.select("page", "method", "legacy_font", F.col("chars").cast("long").alias("chars"))


def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = page_methods(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("page"), F.col("source").alias("filename")), "page").withColumn("boilerplate_removed", F.lit(0))
    return D.pdf_summary(p).select("filename", "total_pages", "total_chars", "ocr_pages", "empty_pages", "legacy_font_pages", "chars_per_page")


def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("filename"), F.col("doc_id").alias("page"), "text", F.lit("text").alias("method"), F.lit(None).cast("string").alias("standard_id"), F.lit(None).cast("string").alias("title"))
    return extract.chunks(d).select("chunk_id", F.length("text").alias("n_chars"))


def passage_pack(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", extract.passages(F.col("text")).alias("p"))
    return d.select("doc_id", F.size("p").alias("n_passages"), T.snippet(F.get("p", F.lit(0))).alias("first"))


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    cat = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").cast("string").alias("filename"), F.concat(F.lit("IS "), "s_suppkey").alias("standard_id"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("title"), *(F.lit(None).cast("string").alias(c) for c in S.METADATA_FIELDS if c not in ("standard_id", "title")))
    files = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("filename"))
    return S.chunk_metadata(files, cat).select("filename", "standard_id", "title")


def _model(route: str, score) -> Callable[[], Model]:
    """A stand-in for a language model, which scores a text by its length."""
    return lambda: lambda texts: [(route, score(len(x))) for x in texts]


def language_route(spark: SparkSession, sf: str) -> DataFrame:
    """Native or roman script by the share of ASCII letters; roman texts of low confidence go to a second model."""
    d = route_scripts(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text", _model("native", lambda _: 0.9), _model("roman", lambda n: n % 10 / 10), _model("roman, second model", lambda _: 0.5))
    return d.select("doc_id", F.col("language").alias("route"), T.language_gate(F.col("lang"), F.col("score")).alias("language"))


def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.concat_ws("::", "l_orderkey", "l_linenumber").alias("chunk_id"), "l_orderkey").dropDuplicates(["chunk_id"])
    old = li.filter("l_orderkey % 3 <> 0").select("chunk_id", F.lit("old").alias("run"))
    new = li.filter("l_orderkey % 3 <> 1").select("chunk_id", F.lit("new").alias("run"))
    return inc.upsert_chunks(old, new).select("chunk_id", "run")


def manifest_repair(spark: SparkSession, sf: str) -> DataFrame:
    files, manifest, chunks = _files(spark, sf)
    decided = inc.ingest_decision(files, manifest, inc.inventory(chunks))
    return inc.repaired_manifest(decided, manifest).select("source", "sha256", "chunks")


def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = _resolved(spark, sf)
    return e.select("edge_no", I.edge_label(F.col("resolved_id"), F.col("to_number"), F.col("to_part"), F.col("cited_year")).alias("label"))


def allied_list(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved citations of a part first, then proposals; told apart by number and part."""
    e = _resolved(spark, sf).filter("in_corpus")
    q = F.floor(F.col("edge_no") / 3)
    g = e.select(q.alias("query"), F.col("resolved_id").alias("code"), F.lit("cited").alias("role"), F.col("edge_no").alias("position"))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("query"), F.concat(F.lit("IS "), F.col("p_partkey").cast("string"), F.lit(" : 1999")).alias("code"), F.lit("proposed").alias("role"), F.lit(0).cast("long").alias("position"))
    return decide.allied(g, m, 8)


def search_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Every part asks, with measures, filler and at times an unknown word, against the words of all categories."""
    text = _said("Supply of ", F.col("p_name"), " 230V 36W ", F.col("p_type"), " 600x600mm 12 ", F.when(F.col("p_partkey") % 4 == 0, "zzgizmo").otherwise("nos"))
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), text.alias("text"))
    return market.search_ladder(q, market.vocabulary(_categories(spark, sf))).select("query_id", F.array_join("ladder", "|").alias("ladder"))


def option_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name inside three kinds of titles."""
    name = F.col("p_name")
    title = _pick(F.col("p_partkey"), _said("SPECIFICATION FOR ", F.upper(name), " - METHODS OF SAMPLING AND TEST"), _said(name, " - Specification"), _said("Sewing machine Part 2 ", F.initcap(name), " requirements"))
    t = table(spark, sf, "part").select("p_partkey", _said("IS ", F.col("p_partkey").cast("string")).alias("standard_id"), title.alias("title"))
    return t.select("p_partkey", extract.short_label(F.col("standard_id"), F.col("title")).alias("label"), extract.aspect_phrase(F.array().cast("array<string>"), F.col("title")).alias("aspect"))


def verify_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a name is among the live ones, and which of its fields changed."""
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_size", "p_partkey")
    live = p.filter("p_partkey % 3 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    changed = inc.snapshot_diff(live, p, "name", ["p_size"], "p_partkey").groupBy(F.lower("name").alias("k")).agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("changed"))
    j = p.withColumn("k", F.lower("name")).join(live.select(F.lower("name").alias("k"), F.lit(True).alias("live")), "k", "left").join(changed, "k", "left")
    return j.select("name", F.coalesce("live", F.lit(False)).alias("live"), "changed")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.concat(F.lit("IS "), F.regexp_extract("source", r"(\d+)", 1), F.lit(" : 2000")).alias("owner"), F.col("source").alias("title"))


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """(n): the numbers of the corpus's standards."""
    return table(spark, sf, "documents").select(F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("n")).distinct()


def _cites(spark: SparkSession, sf: str) -> DataFrame:
    """Every standard cites the next two numbers."""
    cited = F.explode(F.array(*(F.struct(F.lit(k).alias("position"), _said("IS ", (F.col("n") + k).cast("string"), " : 2000").alias("code")) for k in (1, 2)))).alias("c")
    return _numbers(spark, sf).select(_said("IS ", F.col("n").cast("string"), " : 2000").alias("src"), "n", cited).select("src", "c.code", F.when(F.col("n") % 2 == 0, "test method").otherwise("safety").alias("role"), F.col("c.position").cast("long").alias("position"))


def _enrichment(spark: SparkSession, sf: str) -> answer.Enrichment:
    """The chain of citations, where the cited standard is held; editions of every other standard; the parts' categories, of which those with a
    standard's number in their name cite it."""
    e = _cites(spark, sf)
    held = e.select(F.col("src").alias("target")).distinct()
    walked = e.select("src", F.col("position").alias("edge_rank"), F.col("code").alias("label")).join(held, F.col("label") == F.col("target"), "left")
    catalog = _numbers(spark, sf).filter("n % 2 = 0").select(_said("IS ", F.col("n").cast("string"), " : 2000").alias("standard_id"), F.lit("2000").alias("edition"), F.lit("2021").alias("reaffirmed_year"), F.col("n").alias("position"))
    names = table(spark, sf, "part").select(_said(F.col("p_name"), " as per IS ", (F.col("p_partkey") % 40).cast("string")).alias("name"), "p_partkey")
    cites = names.select(_said("IS ", (F.col("p_partkey") % 40).cast("string"), " : 2000").alias("standard_id"), F.col("name").alias("category"), F.col("p_partkey").alias("position"))
    return answer.Enrichment(walked, catalog, names.select(F.col("name").alias("category"), F.col("name").alias("product_name")).distinct(), cites)


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array().cast("array<struct<label:string,select:array<string>>>").alias("answers"), F.array().cast("array<string>").alias("asked"))
    d = _corpus(spark, sf)
    r = answer.recommend(q, d, _cites(spark, sf), words=_index(spark, sf, "texts"), more=_enrichment(spark, sf))
    own = [F.size("allied").alias("n_allied"), "version", F.size("references").alias("n_references"), F.array_join(F.transform("categories", lambda c: c["category"]), "|").alias("categories")]
    return r.select(F.col("query").alias("item_id"), "clarification_needed", "primary_standard", "confidence", "match_score", F.size("clauses").alias("n_clauses"), F.size("placeholders").alias("n_placeholders"), *own)


def document_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    out = answer.answer_documents(c.select(F.col("conv_id").alias("request"), "text"), _corpus(spark, sf), edges=_cites(spark, sf), words=_index(spark, sf, "texts"), more=_enrichment(spark, sf))
    found = F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["standard_id"], x["passage_hits"].cast("string"))), "|")
    return out.select(F.col("query").alias("conv_id"), found.alias("candidates"), F.size("requirements").alias("n_requirements"), "primary_standard", "confidence", "version", F.size("clauses").alias("n_clauses"), F.size("allied").alias("n_allied"), F.size("references").alias("n_references"), F.size("categories").alias("n_categories"))


_PAGES = r"""SELECT doc_id AS page, source AS filename, CASE WHEN doc_id % 3 = 0 AND length(trim(source)) < 200 AND length(s) > length(trim(source)) THEN 'ocr' ELSE 'text' END AS m0, s, trim(source) AS cut
FROM (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')) AS s FROM documents)"""
_METHODS = f"SELECT page, filename, CASE WHEN page % 7 = 0 THEN 'legacy-font' ELSE m0 END AS method, page % 7 = 0 AS legacy_font, CAST(length(CASE WHEN page % 3 = 0 AND m0 = 'text' THEN cut ELSE s END) AS BIGINT) AS chars FROM ({_PAGES})"
_CONCRETE = "'IS ' || n || ' : 2000 Plain and reinforced concrete - Code of practice"
#: What the three forms hold: number, part, year, title, context, confidence, source.
_REFERENCES = f"""d AS (SELECT doc_id AS doc, doc_id % 80000 + 10000 AS n, doc_id % 7 = 0 AS own FROM documents),
y AS (SELECT doc, own, n, CAST(NULL AS VARCHAR) AS to_part, CAST(NULL AS VARCHAR) AS cited_year, CAST(NULL AS VARCHAR) AS cited_title, 'See IS ' || n || ' for the details of concrete' AS context, 'low' AS confidence, 'inline' AS source FROM d WHERE doc % 3 = 0
UNION ALL SELECT doc, own, n, NULL, '2000', 'Plain and reinforced concrete - Code of practice', '', 'high', 'references_clause' FROM d WHERE doc % 3 = 1
UNION ALL SELECT doc, FALSE, n + 1, '2', NULL, NULL, {_CONCRETE} IS ' || (n + 1) || ' (Part 2)', 'medium', 'references_clause' FROM d WHERE doc % 3 = 1
UNION ALL SELECT doc, own, n, NULL, '1960', NULL, 'Rounding off numerical values shall follow IS ' || n || ' : 1960 always', 'medium', 'inline' FROM d WHERE doc % 3 = 2),
x AS (SELECT doc, CAST(n AS VARCHAR) AS to_number, to_part, cited_year, cited_title, {_roles("COALESCE(cited_title, '') || ' ' || context", T.REFERENCE_ROLES, "normative reference")} AS role, 1 AS page, confidence, source FROM y WHERE NOT own)"""
_SHARE = r"CASE WHEN rest = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / rest END"
SQL = {
    "category_parse": """SELECT p_partkey, what AS product_name, CASE p_partkey % 5 WHEN 2 THEN 'IS|' || n || '|2|' WHEN 3 THEN 'IS|' || n || '|2|1' WHEN 4 THEN '' ELSE 'IS|' || n || '||' END AS standard_keys,
CASE WHEN p_partkey % 5 = 0 THEN 'V' || p_size END AS version, CASE WHEN p_partkey % 5 = 1 THEN 'Q' || p_size END AS listing_tag, CASE p_partkey % 5 WHEN 2 THEN 'ISI Marked' WHEN 3 THEN 'BIS Scheme - I' END AS certification
FROM (SELECT *, p_partkey % 80000 + 10000 AS n, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_type AS what FROM part)""",
    "reference_extract": f"WITH {_REFERENCES} SELECT doc, to_number, to_part, cited_year, cited_title, role, page, confidence, source FROM x",
    "graph_edges": f"""WITH {_REFERENCES}, j AS (SELECT x.*, p_partkey, row_number() OVER (PARTITION BY doc ORDER BY CASE role {' '.join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(graph.ROLE_ORDER))} ELSE 99 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CAST(to_number AS BIGINT)) AS rank
FROM x LEFT JOIN part ON CAST(p_partkey + 10000 AS VARCHAR) = to_number AND to_part IS NULL)
SELECT doc, to_number, 'IS ' || (p_partkey + 10000) || ' : 2001' AS resolved_id, CASE WHEN p_partkey IS NOT NULL AND cited_year <> '2001' THEN 'cites ' || cited_year || ', holds 2001' END AS edition_note, rank FROM j""",
    "html_strategy": """SELECT page_id, ['links', 'embedded_json', 'containers', 'attributes', 'text_shape'][CAST(page_id % 5 + 1 AS INT)] AS found_by, CASE page_id % 5 WHEN 0 THEN 3 + page_id % 5 WHEN 1 THEN 8 + page_id % 6 ELSE 1 END AS n FROM pages""",
    "discover_ids": "SELECT page_id, upper(id) AS standard_id, sha256(said) AS row_hash, page_id % 5 <> 0 AS complete FROM (SELECT page_id, 'IS ' || page_id % 100000 || ' : 2000' AS id, 'is ' || page_id % 100000 || ' : 2000 b' AS said FROM pages UNION ALL SELECT page_id, 'IS 9' || page_id % 100000, 'IS 9' || page_id % 100000 FROM pages)",
    "page_methods": f"SELECT page, method, legacy_font, chars FROM ({_METHODS})",
    "page_summary": f"SELECT filename, COUNT(*) AS total_pages, CAST(SUM(chars) AS BIGINT) AS total_chars, COUNT(*) FILTER (WHERE method = 'ocr') AS ocr_pages, COUNT(*) FILTER (WHERE method = 'empty') AS empty_pages, COUNT(*) FILTER (WHERE legacy_font) AS legacy_font_pages, round(SUM(chars) / COUNT(*), 1) AS chars_per_page FROM ({_METHODS}) GROUP BY filename",
    "chunk_metadata": "SELECT CAST(s_suppkey AS VARCHAR) AS filename, CASE WHEN s_suppkey % 3 <> 0 THEN 'IS ' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS standard_id, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 2 <> 0 THEN s_name END AS title FROM supplier",
    "language_route": rf"SELECT doc_id, CASE WHEN share <= 0.5 THEN 'native' WHEN (n % 10) / 10 <= 0.6 THEN 'roman, second model' ELSE 'roman' END AS route, CASE WHEN share > 0.5 AND (n % 10) / 10 <= 0.6 THEN 'en' ELSE lang END AS language FROM (SELECT doc_id, lang, length(COALESCE(text, '')) AS n, {_SHARE} AS share FROM (SELECT doc_id, lang, text, length(regexp_replace(text, '[!-/:-@\[-`{{-~]|\s', '', 'g')) - (length(text) - length(replace(text, chr(10), ''))) AS rest FROM documents))",
    "chunk_upsert": "SELECT DISTINCT l_orderkey || '::' || l_linenumber AS chunk_id, CASE WHEN l_orderkey % 3 <> 1 THEN 'new' ELSE 'old' END AS run FROM lineitem",
    "manifest_repair": f"WITH {_F} SELECT source, m_sha AS sha256, m_chunks AS chunks FROM m UNION ALL SELECT source, sha, n_chunks FROM p JOIN i USING (source) WHERE n_stamped = n_chunks AND n_hashes = 1 AND a_hash = sha AND n_totals = 1 AND a_total = n_chunks AND source NOT IN (SELECT source FROM m)",
    "edge_labels": f"WITH {_R} SELECT r.edge_no, COALESCE(resolved_id, 'IS ' || dst || CASE WHEN dst % 2 = 0 THEN ' (Part ' || (dst % 5) || ')' ELSE '' END || ' : ' || (2000 + r.edge_no % 3)) AS label FROM r JOIN e ON e.edge_no = r.edge_no",
    "allied_list": f"""WITH {_R}, u AS (SELECT edge_no // 3 AS query, resolved_id AS code, 'cited' AS role, 'reference clause' AS source, 0 AS tier, edge_no AS seen, resolved_id AS k FROM r WHERE in_corpus UNION ALL SELECT p_partkey, 'IS ' || p_partkey || ' : 1999', 'proposed', 'model', 1, 0, 'IS ' || p_partkey FROM part),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query, k ORDER BY tier, seen) = 1) SELECT query, code, role, source, row_number() OVER (PARTITION BY query ORDER BY tier, seen) AS place FROM f QUALIFY place <= 8""",
    "search_ladder": """WITH cat AS (SELECT DISTINCT p_name || ' ' || p_type AS c FROM part), v AS (SELECT word, COUNT(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(c), '[a-z0-9]{2,}'))) AS word FROM cat) GROUP BY word),
q AS (SELECT p_partkey AS query_id, list_concat(string_split(p_name, ' '), [p_type]) AS known FROM part), w AS (SELECT query_id, unnest(known) AS w, generate_subscripts(known, 1) AS pos FROM q),
two AS (SELECT query_id, w, pos FROM w JOIN v ON word = lower(w) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, pos) <= 2), r AS (SELECT query_id, string_agg(w, ' ' ORDER BY pos) AS rare FROM two GROUP BY query_id)
SELECT query_id, CASE WHEN query_id % 4 = 0 THEN array_to_string(known, ' ') || ' zzgizmo|' ELSE '' END || array_to_string(known, ' ') || '|' || rare AS ladder FROM q JOIN r USING (query_id)""",
    "option_labels": """SELECT p_partkey, 'IS ' || p_partkey || ' - ' || CASE p_partkey % 3 WHEN 0 THEN upper(p_name[1]) || p_name[2:] WHEN 1 THEN p_name ELSE 'Sewing machine Part 2 ' || cap || ' requirements' END AS label,
CASE p_partkey % 3 WHEN 0 THEN 'SPECIFICATION FOR ' || upper(p_name) || ' - METHODS OF SAMPLING AND TEST' WHEN 1 THEN p_name || ' - Specification' ELSE cap || ' requirements' END AS aspect
FROM (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part)""",
    "verify_categories": "SELECT p_name || ' ' || p_partkey AS name, p_partkey % 3 <> 0 AS live, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 5 = 0 THEN 'p_size' END AS changed FROM part",
}
QUERIES = {
    f.__name__: f
    for f in (category_parse, reference_extract, graph_edges, html_strategy, discover_ids, page_methods, page_summary, chunk_pages, passage_pack, chunk_metadata, language_route, chunk_upsert, manifest_repair, edge_labels, allied_list, search_ladder, option_labels, verify_categories, recommendations, document_recommendations)
}
