"""Text and aggregate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions.html import stable_sql
from ..operators import decide, market
from ..sources import documents as D
from .common import quoted, table, tokens_sql

LICENCE_MARK = r"Licen[cs]ed?\s+under[\s\S]{0,200}?\d{1,3}(?:\.\d{1,3}){3}\.?"


def tok_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counted in the row first (places of each word's first mention), then inside tasks: what is shuffled is a vocabulary."""
    t = table(spark, sf, "documents").select(T.query_terms(F.col("text")).alias("t"))
    each = t.select(F.explode(F.concat(F.transform("t", lambda x: F.struct(x.alias("token"), F.lit(1).alias("n"), F.lit(0).alias("df"))), F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("token"), F.lit(0).alias("n"), F.lit(1).alias("df"))))).alias("x"))
    return each.groupBy("x.token").agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df"))


def unicode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def meaningful_terms(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "benchmark").withColumn("t", T.meaningful_terms(F.col("text")))
    return t.select("item_id", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n_terms"))


def boilerplate_strip(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").withColumn("s", T.strip_watermarks(F.col("text"), [*T.WATERMARKS, LICENCE_MARK]))
    return t.select("doc_id", F.col("s.removed").cast("long").alias("removed"), F.sha2("s.text", 256).alias("text_sha256"))


def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").withColumn("r", T.redact(F.col("text")))
    return t.filter(F.col("r") != F.col("text")).select("doc_id", F.sha2("r", 256).alias("redacted_sha256"))


def html_normalize_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2(T.normalise_html(F.col("html")), 256).alias("page_hash"))


def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nok"))
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.json_object(reply), "$.k").cast("long").alias("k"))


def role_of_text(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" ", F.col("p_name"), F.element_at(F.array(*map(F.lit, ["methods of test", "glossary of terms", "sampling", "safety code of practice", "specification", "determination of lead", ""])), (F.col("p_partkey") % 7 + 1).cast("int")))
    t = table(spark, sf, "part").select("p_partkey", label.alias("t"))
    return t.select("p_partkey", T.role_of(F.col("t")).alias("title_role"), T.infer_role(F.lit(None).cast("string"), F.col("t")).alias("reference_role"))


def id_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Ids made of every part's key, in five forms."""
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 80_000 + 10_000).cast("string")
    part, year = (k % 9 + 1).cast("string"), (1950 + k % 70).cast("string")
    lit = F.lit
    id_ = F.when(k % 5 == 0, F.concat(lit("IS "), n, lit(" (Part "), part, lit(") : "), year)).when(k % 5 == 1, F.concat(lit("SP "), n, lit(" : "), year)).when(k % 5 == 2, F.concat(lit("is "), n, lit(" (Part 5/Section "), part, lit(") : 2012"))).when(k % 5 == 3, F.concat(lit("IS"), n)).otherwise(lit(" No Id "))
    t = table(spark, sf, "part").select("p_partkey", id_.alias("id")).withColumn("p", I.parse_id(F.col("id")))
    key = I.standard_key(F.col("p.type"), F.col("p.number"), F.col("p.part"), F.col("p.section"))
    return t.select("p_partkey", "p.type", "p.number", "p.part", "p.section", I.number_key(F.col("id")).alias("number_key"), key.alias("standard_key"))


FILE_FIELDS = ["doc_type", "number", "part", "part_to", "section", "year", "reaffirmed", "duplicate_marker"]
#: File names (with {n} for a number and {p} for a part) and what they hold.
FILE_FORMS = [
    ("{n}_2025.pdf", ("IS", "{n}", None, None, None, "2025", None, False)),
    ("{n}_{p}_2024.pdf", ("IS", "{n}", "{p}", None, None, "2024", None, False)),
    ("{n}_1992_reff2020.pdf", ("IS", "{n}", None, None, None, "1992", "2020", False)),
    ("IS {n}_2025.pdf", ("IS", "{n}", None, None, None, "2025", None, False)),
    ("IS {n} (Part {p})_2024.pdf", ("IS", "{n}", "{p}", None, None, "2024", None, False)),
    ("IS {n} (Part 1 to 8)_2021.pdf", ("IS", "{n}", "1", "8", None, "2021", None, False)),
    ("IS-{n}-AIF.pdf", ("IS", "{n}", None, None, None, None, None, False)),
    ("SP {n}_1976.pdf", ("SP", "{n}", None, None, None, "1976", None, False)),
    ("{n}_2025 (1).pdf", ("IS", "{n}", None, None, None, "2025", None, True)),
    ("IS {n} (Part 5/Section {p})_2012.pdf", ("IS", "{n}", "5", None, "{p}", "2012", None, False)),
]


def filename_parse(spark: SparkSession, sf: str) -> DataFrame:
    """File names made of every part's key, in ten forms."""
    k = F.col("p_partkey")
    form = F.element_at(F.array(*(F.lit(f) for f, _ in FILE_FORMS)), (k % len(FILE_FORMS) + 1).cast("int"))
    name = F.replace(F.replace(form, F.lit("{n}"), (k % 80_000 + 10_000).cast("string")), F.lit("{p}"), (k % 9 + 1).cast("string"))
    # an array exploded: fields read from the struct itself would work it out anew for each of them
    return table(spark, sf, "part").select("p_partkey", F.explode(F.array(I.parse_filename(name))).alias("p")).select("p_partkey", "p.*")


def line_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("lines", F.split("text", "\n"))
    count = lambda f: F.size(F.filter("lines", f)).cast("long")
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), count(lambda x: T.digit_share(x) > 0.3).alias("id_lines"), count(T.garbled).alias("garbled_lines"), count(lambda x: T.latin_share(x) < 0.5).alias("foreign_lines"), F.round(T.roman_share(F.col("text")), 6).alias("roman_share"))


def doc_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", F.length(F.trim("text")).alias("chars"))
    g = d.groupBy("source").agg(F.count("*").alias("total_pages"), F.sum("chars").alias("total_chars"), F.count_if(F.col("chars") < 200).alias("short_pages"), F.count_if(F.col("chars") == 0).alias("empty_pages"))
    g = g.withColumn("chars_per_page", F.round(F.try_divide("total_chars", "total_pages"), 1))
    warn = F.array(F.when(F.col("chars_per_page") < 2300, F.lit("low yield")), F.when(F.col("empty_pages") > 0, F.lit("empty pages")), F.when(F.col("short_pages") > 3, F.lit("short pages")))
    return g.withColumn("warnings", F.array_join(F.array_compact(warn), "; "))


def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    r = doc_quality_report(spark, sf)
    return r.agg(F.count("*").alias("files"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("total_pages", "total_chars", "short_pages", "empty_pages")))


def vocab_df(spark: SparkSession, sf: str) -> DataFrame:
    return market.vocabulary(table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("product_name")))


def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").agg(F.count("*").alias("categories"), F.count_if(F.col("p_size") > 25).alias("large"), F.countDistinct("p_brand").alias("brands"), F.countDistinct("p_name").alias("names"))


def distinguishing_words(spark: SparkSession, sf: str) -> DataFrame:
    """Per brand: the words of each distinct name that no more than half of the brand's names share."""
    names = table(spark, sf, "part").select("p_brand", "p_name").distinct().withColumn("w", T.title_words(F.col("p_name")))
    return decide.distinguishing(names, "p_brand", "p_name", "w").withColumn("words", F.array_join("words", " "))


def category_words(spark: SparkSession, sf: str) -> DataFrame:
    """Per size: what tells the categories of that size apart, by the categories' rule."""
    c = table(spark, sf, "part").select("p_size", F.concat_ws(" ", "p_name", "p_type").alias("category")).distinct().withColumn("w", T.query_terms(F.col("category")))
    return decide.distinguishing(c.withColumn("w", F.filter("w", lambda x: F.length(x) > 2)), "p_size", "category", "w", categories=True).withColumn("words", F.array_join("words", " "))


def category_find(spark: SparkSession, sf: str) -> DataFrame:
    """The categories that hold each type's name, in any case, and a word that few have."""
    p = table(spark, sf, "part")
    needles = p.select(F.upper("p_type").alias("needle")).unionByName(p.select(F.substring_index("p_name", " ", -1).alias("needle"))).distinct()
    return market.find(p.select(F.concat_ws(" ", "p_name", "p_type").alias("product_name")).distinct(), needles)


def category_search(spark: SparkSession, sf: str) -> DataFrame:
    """The one search text of every part's category, whose name has two brackets and a measure."""
    name = F.concat(F.initcap("p_name"), F.lit(" ("), "p_type", F.lit(" Light) (Size "), F.col("p_size").cast("string"), F.lit(") 36W"))
    return table(spark, sf, "part").select("p_partkey", market.category_search_text(name).alias("search"))


def confidence_score(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    title = F.split("text", "\n")[0]
    s = I.catalog_score(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") + F.when(F.col("quality") == 1, 0).otherwise(1)).cast("string")), F.lit("2020"), F.when(F.col("doc_id") % 2 == 0, F.when(F.col("toxic") == 1, "2019").otherwise("2020")), F.lit("2020"), title, F.col("doc_id") % 5 == 0, F.when(F.col("doc_id") % 7 == 0, "8"))
    return d.select("doc_id", s["level"].alias("level"), s["score"].cast("long").alias("score"))


def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return confidence_score(spark, sf).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def audio_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    reason = T.audio_rejection(F.when(F.col("event_type") == "error", "Thank you.").otherwise(F.col("props")), F.when(F.col("event_id") % 11 != 0, -F.col("value") / 50), (F.col("event_id") % 10) / 10)
    return e.select("event_id", reason.alias("reason"))


def audio_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("audio"), (-F.col("value") / 50).alias("avg_logprob"), ((F.col("event_id") % 10) / 10).alias("no_speech_prob"))
    return D.transcript_scores(e).select(F.col("audio").alias("user_id"), F.round("avg_logprob", 6).alias("avg_logprob"), "no_speech_prob", "segments")


_STRIPPED = "text"
for _p in [*T.WATERMARKS, LICENCE_MARK]:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?i){_p}', ' ', 'g')"
_STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace({_STRIPPED}, '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _roles(text: str, rules: list, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"


_GARBLED = (
    rf"(x = '' OR regexp_matches(x, '[{T.LEGACY_GLYPHS}]') OR (length(regexp_replace(x, '[{T.SAFE_TITLE_CHARS.replace(chr(39), chr(39) * 2)}]', '', 'g')) >= 2 AND length(regexp_replace(x, '[{T.SAFE_TITLE_CHARS.replace(chr(39), chr(39) * 2)}]', '', 'g')) > 0.02 * length(x)) "
    r"OR (len(list_filter(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '\p{L}'))) >= 2 AND len(list_filter(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '\p{L}') AND length(regexp_replace(w, '[^\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(w, '[aeiouAEIOU]'))) "
    r"> 0.4 * len(list_filter(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' '), lambda w: regexp_matches(w, '\p{L}')))))"
)
_DIGITS = "length(regexp_replace(x, '[^0-9]', '', 'g'))"
_LETTERS = r"length(regexp_replace(x, '[^\p{L}]', '', 'g'))"
_REPORT = """SELECT *, array_to_string(list_filter([CASE WHEN chars_per_page < 2300 THEN 'low yield' END, CASE WHEN empty_pages > 0 THEN 'empty pages' END, CASE WHEN short_pages > 3 THEN 'short pages' END], lambda x: x IS NOT NULL), '; ') AS warnings
FROM (SELECT source, COUNT(*) AS total_pages, CAST(SUM(length(trim(text))) AS BIGINT) AS total_chars, COUNT(*) FILTER (WHERE length(trim(text)) < 200) AS short_pages, COUNT(*) FILTER (WHERE length(trim(text)) = 0) AS empty_pages,
round(SUM(length(trim(text))) / COUNT(*), 1) AS chars_per_page FROM documents GROUP BY source)"""
_SCORE = rf"""
SELECT doc_id, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS level, score FROM (
SELECT doc_id, CAST(greatest(0, 100 - (CASE WHEN doc_id % 3 <> 0 AND quality <> 1 THEN 50 ELSE 0 END) - (CASE WHEN doc_id % 3 = 0 THEN 15 ELSE 0 END) - (CASE WHEN doc_id % 2 = 0 AND toxic = 1 THEN 30 ELSE 0 END)
- (CASE WHEN x = '' THEN 50 ELSE 0 END) - (CASE WHEN x <> '' AND length(x) < 12 THEN 30 ELSE 0 END) - (CASE WHEN regexp_matches(x, '{I.COVER_WORDS}') THEN 40 ELSE 0 END) - (CASE WHEN x <> '' AND {_DIGITS} > 0.2 * length(x) THEN 20 ELSE 0 END)
- (CASE WHEN x <> '' AND {_GARBLED} THEN 45 ELSE 0 END) - (CASE WHEN x <> '' AND regexp_replace(lower(x), '[^a-z]', '', 'g') IN ({quoted(T.TITLE_BOILERPLATE)}) THEN 45 ELSE 0 END)
- (CASE WHEN doc_id % 5 = 0 THEN 15 ELSE 0 END) - (CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 0 END)) AS BIGINT) AS score
FROM (SELECT doc_id, quality, toxic, string_split(text, chr(10))[1] AS x FROM labels JOIN documents USING (doc_id)))"""


def _value(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else x[1] if x.startswith("{") else f"'{x}'"


SQL = {
    "tok_counts": f"SELECT token, COUNT(*) AS n, COUNT(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}')) AS token FROM documents) WHERE token NOT IN ({quoted(T.QUERY_NOISE)}) GROUP BY token",
    "unicode_tokens": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)",
    "meaningful_terms": f"SELECT item_id, array_to_string(t, ' ') AS terms, CAST(len(t) AS BIGINT) AS n_terms FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(T.FILLER_WORDS)})) AS t FROM benchmark)",
    "boilerplate_strip": f"SELECT doc_id, CAST(length(text) - length(s) AS BIGINT) AS removed, sha256(s) AS text_sha256 FROM (SELECT doc_id, text, {_STRIPPED} AS s FROM documents)",
    "pii_redact": f"SELECT doc_id, sha256(r) AS redacted_sha256 FROM (SELECT doc_id, text, regexp_replace(text, '{T.PERSONAL}', '[redacted]', 'g') AS r FROM documents) WHERE r <> text",
    "html_normalize_hash": f"SELECT page_id, sha256({stable_sql('html')}) AS page_hash FROM pages",
    "json_extract": "SELECT event_id, CAST(json_extract(regexp_extract('Answer: ```json ' || props || ' ``` ok', '(?s)\\{.*\\}'), '$.k') AS BIGINT) AS k FROM events",
    "role_of_text": f"SELECT p_partkey, {_roles('t', T.TITLE_ROLES, 'product specification')} AS title_role, {_roles('t', T.REFERENCE_ROLES, 'normative reference')} AS reference_role FROM (SELECT p_partkey, p_name || ' ' || ['methods of test', 'glossary of terms', 'sampling', 'safety code of practice', 'specification', 'determination of lead', ''][CAST(p_partkey % 7 + 1 AS INT)] AS t FROM part)",
    "filename_parse": "SELECT p_partkey, " + ", ".join(f"CASE p_partkey % {len(FILE_FORMS)} " + " ".join(f"WHEN {i} THEN {_value(v[f])}" for i, (_, v) in enumerate(FILE_FORMS)) + f" END AS {name}" for f, name in enumerate(FILE_FIELDS)) + " FROM (SELECT p_partkey, CAST(p_partkey % 80000 + 10000 AS VARCHAR) AS n, CAST(p_partkey % 9 + 1 AS VARCHAR) AS p FROM part)",
    "line_profile": rf"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(l, lambda x: x = '' OR {_DIGITS} / length(x) > 0.3)) AS BIGINT) AS id_lines, CAST(len(list_filter(l, lambda x: {_GARBLED})) AS BIGINT) AS garbled_lines,
CAST(len(list_filter(l, lambda x: {_LETTERS} = 0 OR length(regexp_replace(x, '[^A-Za-z]', '', 'g')) / {_LETTERS} < 0.5)) AS BIGINT) AS foreign_lines,
round(CASE WHEN rest = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / rest END, 6) AS roman_share
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, length(regexp_replace(text, '[!-/:-@\[-`{{-~]|\s', '', 'g')) - (length(text) - length(replace(text, chr(10), ''))) AS rest FROM documents)""",
    "doc_quality_report": _REPORT,
    "report_totals": f"SELECT COUNT(*) AS files, " + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in ("total_pages", "total_chars", "short_pages", "empty_pages")) + f" FROM ({_REPORT})",
    "vocab_df": "SELECT word, COUNT(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{2,}'))) AS word FROM part) GROUP BY word",
    "catalog_stats": "SELECT COUNT(*) AS categories, COUNT(*) FILTER (WHERE p_size > 25) AS large, COUNT(DISTINCT p_brand) AS brands, COUNT(DISTINCT p_name) AS names FROM part",
    "distinguishing_words": f"""
WITH n AS (SELECT DISTINCT p_brand, p_name FROM part), w AS (SELECT p_brand, p_name, unnest(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ({quoted(T.TITLE_NOISE)})))) AS word FROM n),
t AS (SELECT p_brand, COUNT(*) AS n_names FROM n GROUP BY p_brand), c AS (SELECT p_brand, word, COUNT(*) AS k FROM w GROUP BY p_brand, word)
SELECT n.p_brand, n.p_name, COALESCE(string_agg(w.word, ' ' ORDER BY w.word) FILTER (WHERE c.k <= t.n_names / 2), '') AS words
FROM n JOIN t USING (p_brand) LEFT JOIN w USING (p_brand, p_name) LEFT JOIN c ON c.p_brand = w.p_brand AND c.word = w.word GROUP BY n.p_brand, n.p_name""",
    "category_words": f"""
WITH n AS (SELECT DISTINCT p_size, p_name || ' ' || p_type AS category FROM part), w AS (SELECT p_size, category, list_distinct(list_filter(regexp_extract_all(lower(category), '[a-z0-9]{{2,}}'), lambda x: length(x) > 2 AND x NOT IN ({quoted(T.QUERY_NOISE)}))) AS l FROM n),
t AS (SELECT p_size, COUNT(*) AS n, flatten(list(l)) AS every FROM w GROUP BY p_size)
SELECT p_size, category, array_to_string(list_sort(list_filter(l, lambda x: NOT ((n > 1 AND len(list_filter(every, lambda y: y = x)) = n) OR (n > 2 AND len(list_filter(every, lambda y: y = x)) > n / 2)))), ' ') AS words FROM w JOIN t USING (p_size)""",
    "category_find": """WITH c AS (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part), k AS (SELECT upper(p_type) AS needle FROM part UNION SELECT string_split(p_name, ' ')[-1] FROM part)
SELECT needle, name, COUNT(*) OVER (PARTITION BY needle) AS matches, row_number() OVER (PARTITION BY needle ORDER BY name) AS place FROM k JOIN c ON contains(lower(name), lower(needle)) QUALIFY place <= 25""",
    "category_search": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || p_type || ' Light' AS search FROM part",
    "confidence_score": _SCORE,
    "confidence_buckets": f"SELECT level, COUNT(*) AS n, round(AVG(score), 4) AS mean_score FROM ({_SCORE}) GROUP BY level",
    "audio_gate": f"""SELECT event_id, CASE WHEN t = '' THEN 'no speech' WHEN trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) IN ({quoted(T.SILENCE_PHRASES)}) THEN 'silence phrase' WHEN lp IS NULL THEN 'no scores' WHEN ns > 0.6 THEN 'no_speech_prob too high' WHEN lp < -1.0 THEN 'avg_logprob too low' END AS reason
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'Thank you.' ELSE props END AS t, CASE WHEN event_id % 11 <> 0 THEN -value / 50 END AS lp, (event_id % 10) / 10 AS ns FROM events)""",
    "audio_scores": "SELECT user_id, round(AVG(-value / 50), 6) AS avg_logprob, MAX((event_id % 10) / 10) AS no_speech_prob, COUNT(*) AS segments FROM events GROUP BY user_id",
}
SQL["id_parse"] = """
SELECT p_partkey, CASE f WHEN 1 THEN 'SP' WHEN 4 THEN NULL ELSE 'IS' END AS type, CASE WHEN f < 4 THEN n END AS number, CASE f WHEN 0 THEN p WHEN 2 THEN '5' END AS part, CASE WHEN f = 2 THEN p END AS section,
CASE f WHEN 0 THEN n || '|' || p WHEN 4 THEN 'no id' ELSE n || '|' END AS number_key, CASE f WHEN 0 THEN 'IS|' || n || '|' || p || '|' WHEN 1 THEN 'SP|' || n || '||' WHEN 2 THEN 'IS|' || n || '|5|' || p WHEN 3 THEN 'IS|' || n || '||' ELSE '|||' END AS standard_key
FROM (SELECT p_partkey, p_partkey % 5 AS f, CAST(p_partkey % 80000 + 10000 AS VARCHAR) AS n, CAST(p_partkey % 9 + 1 AS VARCHAR) AS p FROM part)"""
QUERIES = {
    f.__name__: f
    for f in (tok_counts, unicode_tokens, meaningful_terms, boilerplate_strip, pii_redact, html_normalize_hash, json_extract, role_of_text, id_parse, filename_parse, line_profile, doc_quality_report, report_totals, vocab_df, catalog_stats, distinguishing_words, category_words, category_find, category_search, confidence_score, confidence_buckets, audio_gate, audio_scores)
}
