"""Divergence of sources inside a language: which sources use a language's words unlike the others, and which words set a source apart.

Plain relational: matches of the term pattern are exploded and counted by (language, source, term); each language keeps the
terms that enough of its documents hold; every (language, source) group is crossed with its language's kept terms, so that
zeros count; a self-join on language and term gives, summed, the distance of every two sources; windows rank them.

A term's share of a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), N the group's kept occurrences, V the kept terms; all
arithmetic is on whole numbers (decimals where a product may pass 64 bits), so the order of rows never shows.

Scale: texts are read once and counted inside tasks before the exchange, so that vocabularies are shuffled, not texts; a
language with most of the rows is dealt by salt where groups meet terms, and by term in the self-join, which holds as many
rows a key as the language has sources. The result's pairs grow with the square of a language's sources, as asked.

Edge cases: null text, language and source are ''. A text without terms makes its group occur. Repeated rows are
documents each. Equal values go by the item's bytes. A language without kept terms gives its pairs with value 0. Empty
tables give no rows; long texts are read whole; only the three named columns are read, so others may be called anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

# --- fixed values ---------------------------------------------------------------------------------------------
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCUMENTS, TOP_TERMS, SMOOTHING, UNIT = 30, 50, 5, 1_000_000_000
# ----------------------------------------------------------------------------------------------------------------

#: Shares of a language's terms that meet its groups in different tasks.
SALTS = 32


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group, and documents that hold it. Matches of the term pattern are
    what lies between matches of its complement, which is the faster way to cut them out; the empty strings at a text's ends go."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # texts of one byte a character hold no capitals but A-Z
    low = F.when(F.octet_length(said) == F.length(said), F.lower(said)).otherwise(F.translate(said, UPPER, LOWER))
    rows = docs.select(_name(lang).alias("lang"), _name(source).alias("source"), F.split(low, BETWEEN).alias("terms"))
    # a text's terms, then its distinct ones: told apart by their place
    each = rows.select("lang", "source", F.size("terms").alias("k"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("pos", "term")).filter("term <> ''")
    once = F.when(F.col("pos") < F.col("k"), 1).otherwise(0)
    return each.groupBy("lang", "source", "term").agg(F.sum(once).alias("n"), F.sum(1 - once).alias("d"))


def _name(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def share(count: Column, total: Column, terms: Column, smoothing: int = SMOOTHING) -> Column:
    """1 + floor(UNIT * (count + smoothing) / (total + smoothing * terms)), exactly."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + smoothing).cast("decimal(20,0)")
    under = (total + terms * smoothing).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, under)


def dense_shares(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, smoothing: int = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, terms: V), and (lang, source, term, n, p, q): every group's share p of every kept term of its
    language, and the language's own share q."""
    # all groups of a term meet once: at most a row for each of its language's sources
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text, lang, source).withColumn("n_all", F.sum("n").over(of_term)).withColumn("d", F.sum("d").over(of_term))
    own = durable(counts.filter(F.col("d") >= least).select("lang", "source", "term", "n", "n_all"))
    kept = durable(own.select("lang", "term", "n_all").distinct())
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_all").alias("total_all"))
    of_group = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(_name(lang).alias("lang"), _name(source).alias("source")).distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = durable(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "terms", "total_all"))))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    crossed = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    filled = crossed.join(own.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", zero))
    shares = filled.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms"), smoothing).alias("p"), share(F.col("n_all"), F.col("total_all"), F.col("terms"), smoothing).alias("q"))
    return groups.select("lang", "source", "terms"), durable(shares)


def distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of absolute differences of shares, for every two sources of a language, either way."""
    a = shares.select("lang", "term", "source", "p")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"))
    half = a.join(b, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p_item"))).alias("value"))
    silent = groups.filter("terms = 0").select("lang", "source")
    zero = silent.join(silent.select("lang", F.col("source").alias("item")), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long"))
    half = half.unionByName(zero)
    return half.withColumn("both", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))).select("lang", "both.source", "both.item", "value")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, smoothing: int = SMOOTHING) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: the other sources of the language, the most distant first; part
    `term`: the `top` terms that a group uses more than its language, by how much more."""
    groups, shares = dense_shares(docs, text, lang, source, least, smoothing)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = distances(groups, shares).withColumn("rank", F.row_number().over(order))
    more = shares.filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = {
    "op11_source_divergence": rf"""
WITH t AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT lang, source, term, COUNT(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM t) GROUP BY ALL),
d AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM t) GROUP BY ALL HAVING COUNT(*) >= 30),
v AS (SELECT lang, COUNT(*)::HUGEINT AS v FROM d GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
x AS (SELECT g.lang, g.source, d.term, COALESCE(c.n, 0)::HUGEINT AS n FROM g JOIN d USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = d.term),
s AS (SELECT lang, source, SUM(n) AS total FROM x GROUP BY ALL),
l AS (SELECT lang, term, SUM(n)::HUGEINT AS n FROM x GROUP BY ALL),
m AS (SELECT lang, SUM(n) AS total FROM l GROUP BY lang),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + 1000000000::HUGEINT * (x.n + 5) // (s.total + 5 * v.v)::HUGEINT AS p FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
q AS (SELECT l.lang, l.term, 1 + 1000000000::HUGEINT * (l.n + 5) // (m.total + 5 * v.v)::HUGEINT AS q FROM l JOIN m USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, SUM(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(COALESCE(pair.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""
}
QUERIES = {"op11_source_divergence": op11_source_divergence}
