"""Graph, incremental, decision and stream queries over stand-ins from the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decide, graph, incremental as inc
from ..operators.retrieval import ranked
from ..sources.recognised import Recognised, Recogniser
from ..streaming.cycle import Cycle
from ..streaming.ingest import Ingest
from ..streaming.limiter import rate_limited
from ..stored import durable, shared_dir
from .common import quoted, table
from .retrieval_queries import _BM25, _OWNED, _groups

ROLES = [*graph.ROLE_ORDER, "other"]


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Three citations a part: to (key * 7 + 1 + 13 j) modulo the number of parts."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("src"))
    n = p.count()
    e = p.withColumn("j", F.explode(F.array(*map(F.lit, range(3)))))
    at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    return e.select("src", ((F.col("src") * 7 + 1 + F.col("j") * 13) % n).alias("dst"), at(ROLES, (F.col("src") + F.col("j")) % 9).alias("role"), at(graph.CONFIDENCE_ORDER, (F.col("src") * 2 + F.col("j")) % 3).alias("confidence"), (F.col("src") * 3 + F.col("j")).alias("edge_no"))


def outgoing_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return graph.outgoing(_edges(spark, sf), "medium", 8).select("src", "dst", "role", "confidence", "rank")


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked citations; every tenth part (3, 13, ...) is cited but not held, and so a leaf."""
    e = graph.outgoing(_edges(spark, sf), "medium", 6)
    return e.select("src", F.col("rank").alias("edge_rank"), F.concat(F.lit("IS "), F.col("dst").cast("string")).alias("label"), F.when(F.col("dst") % 10 != 3, F.col("dst")).alias("target"))


def citation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The walk from every part, three citations deep."""
    c = graph.chain(table(spark, sf, "part").select(F.col("p_partkey").alias("root")), _cited(spark, sf), 3)
    return c.select("root", "place", "depth", "src", "label", "expanded")


def standard_references(spark: SparkSession, sf: str) -> DataFrame:
    """A part's chain, two deep, with the whole graph's figures beside it: one row a part that cites something."""
    c = graph.chain(table(spark, sf, "part").select(F.col("p_partkey").alias("root")), _cited(spark, sf), 2)
    said = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("depth").cast("string"), F.lit(" "), "label").alias("x")))), lambda x: x["x"])
    stats = edge_stats(spark, sf)
    return c.groupBy("root").agg(F.array_join(said, "; ").alias("chain"), F.count_if("expanded").alias("expanded")).join(F.broadcast(stats), F.lit(True))


def unparsed_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that are cited but held by no part."""
    held = table(spark, sf, "part").filter("p_partkey % 10 <> 3").select(F.concat(F.lit("IS "), F.col("p_partkey").cast("string")).alias("standard_id"))
    return graph.unparsed(_cited(spark, sf), held)


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).select("edge_no", F.col("dst").cast("string").alias("to_number"), F.when(F.col("dst") % 2 == 0, (F.col("dst") % 5).cast("string")).alias("to_part"), F.lit(None).cast("string").alias("to_section"), (F.lit(2000) + F.col("edge_no") % 3).cast("string").alias("cited_year"))
    p = table(spark, sf, "part").filter("p_partkey % 10 <> 3")
    held = p.select(F.concat(F.lit("IS "), F.col("p_partkey").cast("string")).alias("standard_id"), F.col("p_partkey").cast("string").alias("number"), F.when(F.col("p_partkey") % 4 == 0, (F.col("p_partkey") % 5).cast("string")).otherwise("").alias("part"), F.lit("").alias("section"), F.lit("2001").alias("year"), F.col("p_partkey").alias("position"))
    return graph.resolve(e, held)


def edge_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select("edge_no", "in_corpus", "resolved_id", "edition_note")


def edge_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(_resolved(spark, sf))


def edges_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).groupBy("confidence").agg(F.count("*").alias("n"))


def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(0))
    x = table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("pos", "a"))
    return x.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("a", ">([^<]*)<", 1).alias("text"))


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, manifest, chunks) of every part and lineitem, with every case of the decision table by key arithmetic: no chunks
    where k % 23 = 0, no manifest row where k % 3 = 1."""
    sha = lambda k: F.sha2(F.concat(F.lit("file"), k.cast("string")), 256)
    name = F.concat(F.lit("f"), F.col("k").cast("string")).alias("source")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    files = p.select(name, sha(F.col("k")).alias("sha256"))
    li = table(spark, sf, "lineitem").filter("l_partkey % 23 <> 0").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber")
    n = li.groupBy("k").agg(F.count("*").alias("n"))
    stamp = F.when((F.col("k") % 5 == 0) | ((F.col("k") % 7 == 0) & (F.col("l_linenumber") == 1)), F.lit(None)).when(F.col("k") % 11 == 0, F.lit("old")).otherwise(sha(F.col("k")))
    chunks = li.join(n, "k").select(name, stamp.alias("source_sha256"), (F.col("n") + F.when(F.col("k") % 13 == 0, 1).otherwise(0)).cast("int").alias("source_chunks"))
    m = p.filter("k % 3 <> 1").join(n, "k", "left")
    manifest = m.select(name, F.when(F.col("k") % 17 == 0, F.lit("other")).otherwise(sha(F.col("k"))).alias("sha256"), (F.coalesce("n", F.lit(3)) + F.when(F.col("k") % 19 == 0, 1).otherwise(0)).alias("chunks"))
    return files, manifest, chunks


def index_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inc.inventory(_files(spark, sf)[2]).select("source", "n_chunks", "n_stamped", F.size("hashes").cast("long").alias("n_hashes"))


def ingest_decision(spark: SparkSession, sf: str) -> DataFrame:
    files, manifest, chunks = _files(spark, sf)
    return inc.ingest_decision(files, manifest, inc.inventory(chunks)).select("source", "n_chunks", "decision", "reason")


def gone_files(spark: SparkSession, sf: str) -> DataFrame:
    files, manifest, chunks = _files(spark, sf)
    present = files.filter(F.substring("source", -1, 1) != "4").select("source")
    return inc.gone_files(inc.inventory(chunks), manifest, present)


def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    new = li.filter("l_shipdate < timestamp_ntz'1999-01-01'")
    return inc.stale(li, new, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber").distinct()


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("position"))
    old = o.filter("id % 3 <> 0").withColumn("fingerprint", inc.row_fingerprint("id", "title", "status")).select("id", "status", "title", "fingerprint", F.when(F.col("id") % 50 == 0, 0).otherwise(1).alias("is_active"), F.lit("r0").alias("first_seen"), F.lit("r0").alias("last_seen"))
    new = o.filter("id % 4 <> 1").withColumn("status", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("status"))).withColumn("fingerprint", inc.row_fingerprint("id", "title", "status")).withColumn("seen_at", F.lit("r1"))
    return old, new


def upsert_delta(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    return inc.upsert(old, new, "id", ["status", "title"]).select("id", "change_type", "status", "fingerprint", "is_active", "first_seen", "last_seen")


def withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    return inc.withdrawals(old, new, "id").select("id", "change_type", "fingerprint")


def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), "p_size", "p_brand", "p_partkey")
    live = p.withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 9 == 0, F.lit(None)).otherwise(F.col("p_brand"))).withColumn("name", F.upper("name"))
    return inc.snapshot_diff(live, p.filter("p_partkey % 8 <> 0"), "name", ["p_size", "p_brand"], "p_partkey")


def report_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("filename")).agg(F.count("*").alias("pages"), F.sum("n_chars").alias("chars"))
    run = d.filter("filename like 'src1%'").withColumn("pages", F.col("pages") + 100)
    drop = spark.createDataFrame([("src3",), ("src4",)], "filename string")
    return inc.merge_report(d, run, drop)


def _standards(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked groups with ids and titles made from the source's number."""
    n = F.regexp_extract("owner", r"(\d+)", 1).cast("int")
    title = F.element_at(F.array(*map(F.lit, ["Methods of test for gears", "Gears - Specification", "Glossary of terms", "Sampling of gears"])), (F.floor(n / 5) + 1).cast("int"))
    sid = F.concat(F.lit("IS "), (100 + F.floor(n / 3)).cast("string"), F.lit(" (Part "), (n % 3 + 1).cast("string"), F.lit(")"))
    return durable(_groups(spark, sf).select("query", "rank", sid.alias("standard_id"), title.alias("title"), "best_score"))


def confidence_tier(spark: SparkSession, sf: str) -> DataFrame:
    m = decide.margins(_standards(spark, sf))
    terms = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.size(T.meaningful_terms(F.col("text"))).alias("n_terms"))
    j = m.join(terms, "query").withColumn("logit", (F.col("top_score") - 20) / 4)
    tier = decide.confidence(F.col("logit"), F.col("n_terms") >= 3, F.col("same_family_tie"))
    return j.select(F.col("query").alias("item_id"), tier.alias("tier"), T.match_score(F.col("logit")).cast("long").alias("match_score"), (F.round("margin", 4) + 0.0).alias("margin"), "same_family_tie")


def clarify_dimension(spark: SparkSession, sf: str) -> DataFrame:
    g = _standards(spark, sf)
    asked = g.select("query").distinct().withColumn("asked", F.when(F.col("query") % 3 == 0, F.array(F.lit("part"))).otherwise(F.array().cast("array<string>")))
    q = decide.next_question(g, asked, lambda standard_id, title: standard_id)
    return q.select(F.col("query").alias("item_id"), "dimension", F.array_join(F.transform("options", lambda x: F.concat(x["label"], F.lit("="), F.array_join(x["select"], "+"))), "; ").alias("options"))


def version_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every part as an answer, against a catalogue where some lack an edition, some are reaffirmed, and some come twice."""
    k = F.col("p_partkey")
    sid = F.concat(F.lit("IS "), k.cast("string"))
    c = table(spark, sf, "part").filter("p_partkey % 5 <> 0").select(sid.alias("standard_id"), F.when(k % 3 != 0, F.concat(F.lit("Edition "), F.col("p_size").cast("string"))).alias("edition"), F.when(k % 2 == 0, F.lit("2019")).alias("reaffirmed_year"), k.alias("position"))
    later = c.select("standard_id", F.lit("later").alias("edition"), F.lit("2024").alias("reaffirmed_year"), (F.col("position") + 1).alias("position"))
    return decide.version_text(table(spark, sf, "part").select("p_partkey", sid.alias("standard_id")), c.unionByName(later)).select("p_partkey", "version")


def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    """The files to ingest, with the ids of their chunks."""
    files, manifest, chunks = _files(spark, sf)
    decided = inc.ingest_decision(files, manifest, inc.inventory(chunks))
    ids = table(spark, sf, "lineitem").filter("l_partkey % 23 <> 0").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("source"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"))
    return inc.pending(decided, ids).select("source", "reason", F.size("old_ids").cast("long").alias("n_old"), F.sha2(F.array_join("old_ids", ","), 256).alias("old_sha256"))


def guarded_withdrawals(spark: SparkSession, sf: str) -> DataFrame:
    """Discoveries of orders by priority as runs of their own: one whose ids are all held or parsed withdraws, one with an id of neither does not."""
    old, new = _snapshots(spark, sf)
    parsed = new.filter("id % 9 <> 0")
    safe = inc.withdrawals(old, new.join(old.select("id").unionByName(parsed.select("id")).distinct(), "id", "left_semi"), "id", True, parsed)
    unsafe = inc.withdrawals(old, new, "id", True, parsed)
    return safe.select("id", F.lit("all known").alias("run")).unionByName(unsafe.select("id", F.lit("some unknown").alias("run")))


def changed_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to fetch: not held, or held with another signature; beside them those that nothing came back for."""
    old, new = _snapshots(spark, sf)
    todo = inc.changed_or_missing(new.select("id", "fingerprint"), old, "id", "fingerprint")
    lost = inc.not_parsed(todo, new.filter("id % 5 <> 0"), "id")
    return todo.join(lost.withColumn("lost", F.lit(True)), "id", "left").select("id", F.coalesce("lost", F.lit(False)).alias("lost"))


def expected_orders(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _snapshots(spark, sf)
    return inc.expected_ids(old, new, "id")


def answer_narrowing(spark: SparkSession, sf: str) -> DataFrame:
    g = _standards(spark, sf)
    second = g.filter("rank in (2, 3)").groupBy("query").agg(F.array_sort(F.collect_list("standard_id")).alias("select")).withColumn("answer_no", F.lit(1))
    none = g.select("query").distinct().select("query", F.array(F.lit("IS 9")).alias("select"), F.lit(2).alias("answer_no"))
    a = second.unionByName(none).filter("query % 2 = 0")
    return decide.narrow(g, a).select(F.col("query").alias("item_id"), "rank", "standard_id")


def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-6 * 3600 * 1_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("offered"))


def _pieces(files: DataFrame, size: int = 1000) -> DataFrame:
    n = F.ceil(F.length("text") / size).cast("int")
    return files.filter(n > 0).select("source", F.explode(F.sequence(F.lit(1), n)).alias("k"), "text").select("source", F.format_string("%s::c%05d", "source", "k").alias("chunk_id"), F.expr(f"substr(text, (k - 1) * {size} + 1, {size})").alias("text"))


def resumable_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """All documents are ingested as files; then every seventh has another text, every eleventh is gone, and a run that sees them all
    prunes. Listed files with their chunks, as the tables hold them after both runs."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id").alias("source"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    hashed = lambda x: x.withColumn("sha256", F.sha2("text", 256))
    work = Ingest(spark, f"{shared_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}", _pieces, 16)
    work.run(hashed(d))
    work.run(hashed(d.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text")))), complete=True, prune=True)
    kept = work.chunks.read(columns=["source", "chunk_id", "text"], together="source").groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), ""), 256).alias("text_sha256"))
    zero = F.lit(0).cast("long")
    return work.manifest.read().join(kept, "source", "left").select("source", "sha256", "chunks", F.coalesce("n_chunks", zero).alias("n_chunks"), F.coalesce("n_chars", zero).alias("n_chars"), F.coalesce("text_sha256", F.sha2(F.lit(""), 256)).alias("text_sha256"))


def _read_aloud() -> Recogniser:
    return lambda contents, languages: [f"{len(c)} bytes in {x}: {c.decode()}" for c, x in zip(contents, languages, strict=True)]


def ocr_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages to be read, a third of them in a second run only: what each says, and the run in which its text was read."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    cache = Recognised(spark, f"{shared_dir(spark).rstrip('/')}/read-{uuid.uuid4().hex}", _read_aloud, 16)
    cache.read(d.filter("doc_id % 3 <> 0"), "first")
    out = cache.read(d, "second").join(cache.cache.read().select(F.col("content_hash"), F.col("language").alias("of"), "run"), (F.sha2("content", 256) == F.col("content_hash")) & (F.col("language") == F.col("of")))
    return out.select("doc_id", F.sha2("ocr_text", 256).alias("text_sha256"), "run")


def change_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds over pages that list the orders of a customer: the second has other rows for every fifth customer, who has one order fewer,
    and a new one. Current standards with what each round did to them."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("page"), F.row_number().over(Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderkey")).alias("no")).filter("no <= 40")

    def pages(second: bool) -> DataFrame:
        other = (F.col("page") % 5 == 0) & F.lit(second)
        rows = o.filter(~(other & (F.col("no") == 1))).withColumn("id", F.concat(F.lit("IS "), F.col("page") * 100 + F.col("no") + 1000))
        said = F.concat(F.lit("<tr><td>"), "id", F.lit("</td><td>"), F.when(other & (F.col("no") == 2), "changed").otherwise("as it was"), F.lit("</td></tr>"))
        html = rows.select("page", "no", said.alias("said")).groupBy(F.concat(F.lit("p"), "page").alias("page"), F.col("page").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "said"))), lambda x: x["said"]), "").alias("html"))
        html = html.withColumn("html", F.concat(F.lit("<table>"), "html", F.when((F.col("n") % 5 == 0) & F.lit(second), F.concat(F.lit("<tr><td>IS "), (F.col("n") * 100 + 1099).cast("string"), F.lit("</td></tr>"))).otherwise(F.lit("")), F.lit("</table>")))
        return html.select("page", "html", F.sha2(T.normalise_html(F.col("html")), 256).alias("page_hash"))

    def collect(ids: DataFrame) -> DataFrame:
        return ids.select("standard_id", F.concat(F.lit("Title of "), "standard_id").alias("title"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("string").alias("last_amendment_date"), F.lit(0).alias("position"))

    cycle = Cycle(spark, f"{shared_dir(spark).rstrip('/')}/cycle-{uuid.uuid4().hex}", collect, buckets=8)
    cycle.run(pages(False), "1")
    cycle.run(pages(True), "2")
    did = cycle.tracker.deltas().groupBy("standard_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "run_id", "change_type"))), ",").alias("changes"))
    return cycle.tracker.current().join(did, "standard_id", "left").select("standard_id", "status", "is_active", "first_seen", "last_seen", "changes")


def rate_limiter(spark: SparkSession, sf: str) -> DataFrame:
    return rate_limited(table(spark, sf, "events"), "user_id", "ts", "event_id", 2, 12 * 3600.0)


def history_cap(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.concat_ws("::", "event_type", "props").alias("key"), "ts", "event_id")
    return decide.capped(e, "user_id", "key", "ts", 10).select("user_id", "event_id", "place")


_E = f"""n AS (SELECT COUNT(*) AS n FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 7 + 1 + j * 13) % n AS dst, [{quoted(ROLES)}][CAST((p_partkey + j) % 9 + 1 AS INT)] AS role, (p_partkey + j) % 9 AS role_no, ['low', 'medium', 'high'][CAST((p_partkey * 2 + j) % 3 + 1 AS INT)] AS confidence, (p_partkey * 2 + j) % 3 AS level, p_partkey * 3 + j AS edge_no FROM part, n, (SELECT unnest([0, 1, 2]) AS j)),
o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN role_no = 8 THEN 99 ELSE role_no END, level DESC, edge_no) AS rank FROM e WHERE level >= 1)"""
_R = f"""{_E}, h0 AS (SELECT 'IS ' || p_partkey AS standard_id, CAST(p_partkey AS VARCHAR) AS number, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) ELSE '' END AS part FROM part WHERE p_partkey % 10 <> 3),
r AS (SELECT edge_no, h0.number IS NOT NULL AS in_corpus, standard_id AS resolved_id, CASE WHEN h0.number IS NOT NULL AND 2000 + edge_no % 3 <> 2001 THEN 'cites ' || (2000 + edge_no % 3) || ', holds 2001' END AS edition_note FROM e LEFT JOIN h0 ON h0.number = CAST(dst AS VARCHAR) AND h0.part = CASE WHEN dst % 2 = 0 THEN CAST(dst % 5 AS VARCHAR) ELSE '' END)"""
_F = """p AS (SELECT p_partkey AS k, 'f' || p_partkey AS source, sha256('file' || p_partkey) AS sha FROM part),
li AS (SELECT l_partkey AS k, l_linenumber FROM lineitem WHERE l_partkey % 23 <> 0), n AS (SELECT k, COUNT(*) AS n FROM li GROUP BY k),
c AS (SELECT 'f' || k AS source, CASE WHEN k % 5 = 0 OR (k % 7 = 0 AND l_linenumber = 1) THEN NULL WHEN k % 11 = 0 THEN 'old' ELSE sha256('file' || k) END AS stamp, n + (CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS total FROM li JOIN n USING (k)),
i AS (SELECT source, COUNT(*) AS n_chunks, COUNT(stamp) AS n_stamped, COUNT(DISTINCT stamp) AS n_hashes, MIN(stamp) AS a_hash, COUNT(DISTINCT CASE WHEN stamp IS NOT NULL THEN total END) AS n_totals, MIN(CASE WHEN stamp IS NOT NULL THEN total END) AS a_total FROM c GROUP BY source),
m AS (SELECT 'f' || k AS source, CASE WHEN k % 17 = 0 THEN 'other' ELSE sha END AS m_sha, COALESCE(n, 3) + (CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END) AS m_chunks FROM p LEFT JOIN n USING (k) WHERE k % 3 <> 1)"""


def _walk(depth: int) -> str:
    """The depth-first walk with one list of visited nodes a root: one step takes the first of the stack, and puts its node's
    citations in its place where it is held, not expanded yet, and not too deep. v: the steps in order."""
    kids = "list_transform(kids, lambda x: {{'dst': x.dst, 'src': x.src, 'depth': CAST({d} AS INT)}})"
    on = f"(stack[1].depth < {depth} AND stack[1].dst % 10 <> 3 AND NOT list_contains(seen, stack[1].dst))"
    return f"""WITH RECURSIVE {_E}, a AS (SELECT src, list({{'dst': dst, 'src': src}} ORDER BY rank) AS kids FROM o WHERE rank <= 6 GROUP BY src),
w AS (SELECT src AS root, -1 AS place, {kids.format(d=1)} AS stack, [src] AS seen, CAST(NULL AS STRUCT(dst BIGINT, src BIGINT, depth INT)) AS item, FALSE AS expanded FROM a
UNION ALL SELECT root, place + 1, CASE WHEN {on} AND kids IS NOT NULL THEN list_concat({kids.format(d='stack[1].depth + 1')}, stack[2:]) ELSE stack[2:] END, CASE WHEN {on} THEN list_append(seen, stack[1].dst) ELSE seen END, stack[1], {on} FROM w LEFT JOIN a ON a.src = w.stack[1].dst WHERE len(stack) > 0),
v AS (SELECT root, CAST(place AS BIGINT) AS place, item, expanded FROM w WHERE place >= 0)"""


_S = """old AS (SELECT o_orderkey AS id, o_orderstatus AS status, sha256(o_orderkey || o_orderpriority || o_orderstatus) AS fp, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END AS is_active FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT id, status, sha256(id || title || status) AS fp FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority AS title FROM orders WHERE o_orderkey % 4 <> 1))"""
_G = f"""{_BM25}, {_OWNED.format(pool=30, k=6)}, st0 AS (SELECT query, rank, best_score, CAST(regexp_extract(owner, '([0-9]+)', 1) AS INT) AS n FROM g),
st AS (SELECT query, rank, best_score, 100 + n // 3 AS number, n % 3 + 1 AS part, 'IS ' || (100 + n // 3) || ' (Part ' || (n % 3 + 1) || ')' AS standard_id, ['test method', 'product specification', 'terminology', 'sampling'][n // 5 + 1] AS role, ['Methods of test for gears', 'Gears - Specification', 'Glossary of terms', 'Sampling of gears'][n // 5 + 1] AS title FROM st0)"""
SQL = {
    "outgoing_ranked": f"WITH {_E} SELECT src, dst, role, confidence, rank FROM o WHERE rank <= 8",
    "citation_chain": f"{_walk(3)} SELECT root, place, item.depth AS depth, item.src AS src, 'IS ' || item.dst AS label, expanded FROM v",
    "standard_references": f"""{_walk(2)}, {_R[len(_E) + 2 :]}, s AS (SELECT COUNT(*) AS edges, COUNT(*) FILTER (WHERE in_corpus) AS resolved, COUNT(edition_note) AS outdated FROM r)
SELECT root, string_agg(item.depth || ' IS ' || item.dst, '; ' ORDER BY place) AS chain, COUNT(*) FILTER (WHERE expanded) AS expanded, any_value(edges) AS edges, any_value(resolved) AS resolved, any_value(outdated) AS outdated FROM v, s GROUP BY root""",
    "unparsed_targets": f"WITH {_E} SELECT 'IS ' || dst AS label, COUNT(*) AS citations FROM o WHERE rank <= 6 AND dst NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3) GROUP BY dst",
    "edge_resolve": f"WITH {_R} SELECT * FROM r",
    "edge_stats": f"WITH {_R} SELECT COUNT(*) AS edges, COUNT(*) FILTER (WHERE in_corpus) AS resolved, COUNT(edition_note) AS outdated FROM r",
    "edges_by_confidence": f"WITH {_E} SELECT confidence, COUNT(*) AS n FROM e GROUP BY confidence",
    "link_extract": r"""SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, regexp_extract(a, '>([^<]*)<', 1) AS text FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>') AS l FROM pages))""",
    "index_inventory": f"WITH {_F} SELECT source, n_chunks, n_stamped, n_hashes FROM i",
    "ingest_decision": f"""WITH {_F}, r AS (SELECT source, COALESCE(n_chunks, 0) AS n_chunks, CASE WHEN n_stamped > 0 AND n_stamped <> n_chunks THEN 'mixed' WHEN n_stamped > 0 AND (n_hashes <> 1 OR a_hash <> sha) THEN 'changed' WHEN n_stamped > 0 AND (n_totals <> 1 OR a_total <> n_chunks) THEN 'interrupted' WHEN n_stamped > 0 THEN 'unchanged'
WHEN m_sha IS NULL AND n_chunks > 0 THEN 'unlisted' WHEN m_sha IS NULL THEN 'new' WHEN m_sha <> sha THEN 'changed' WHEN m_chunks <> COALESCE(n_chunks, 0) THEN CASE WHEN COALESCE(n_chunks, 0) = 0 THEN 'missing' ELSE 'interrupted' END ELSE 'unchanged' END AS reason FROM p LEFT JOIN i USING (source) LEFT JOIN m USING (source))
SELECT source, n_chunks, CASE WHEN reason = 'unchanged' THEN 'skip' ELSE 'ingest' END AS decision, reason FROM r""",
    "gone_files": f"WITH {_F} SELECT source, COALESCE(n_chunks, 0) AS n_chunks, CASE WHEN COALESCE(n_chunks, 0) = 0 THEN 'drop_manifest' ELSE 'warn' END AS action FROM (SELECT source FROM i UNION SELECT source FROM m) LEFT JOIN i USING (source) WHERE source NOT IN (SELECT source FROM p WHERE source NOT LIKE '%4')",
    "stale_chunks": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_shipdate < TIMESTAMP '1999-01-01' AND n.l_orderkey = l.l_orderkey AND n.l_linenumber = l.l_linenumber)",
    "upsert_delta": f"""WITH {_S} SELECT COALESCE(new.id, old.id) AS id, CASE WHEN new.id IS NULL THEN 'KEPT' WHEN old.id IS NULL THEN 'NEW' WHEN old.fp <> new.fp OR is_active = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS change_type, COALESCE(new.status, old.status) AS status, COALESCE(new.fp, old.fp) AS fingerprint,
CASE WHEN new.id IS NOT NULL THEN 1 ELSE is_active END AS is_active, CASE WHEN old.id IS NULL THEN 'r1' ELSE 'r0' END AS first_seen, CASE WHEN new.id IS NULL THEN 'r0' ELSE 'r1' END AS last_seen FROM old FULL JOIN new ON old.id = new.id""",
    "withdrawals": f"WITH {_S} SELECT id, 'WITHDRAWN' AS change_type, fp AS fingerprint FROM old WHERE is_active = 1 AND id NOT IN (SELECT id FROM new)",
    "snapshot_diff": """WITH l AS (SELECT p_partkey AS k, upper(p_name || ' ' || p_partkey) AS name, p_size + (CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) AS p_size, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS p_brand, p_size AS old_size, p_brand AS old_brand FROM part)
SELECT name, 'new' AS field, NULL AS old, name AS new FROM l WHERE k % 8 = 0 UNION ALL SELECT name, 'p_size', CAST(old_size AS VARCHAR), CAST(p_size AS VARCHAR) FROM l WHERE k % 8 <> 0 AND old_size <> p_size UNION ALL SELECT name, 'p_brand', old_brand, p_brand FROM l WHERE k % 8 <> 0 AND p_brand IS NULL""",
    "report_merge": "SELECT source AS filename, COUNT(*) + (CASE WHEN source LIKE 'src1%' THEN 100 ELSE 0 END) AS pages, CAST(SUM(n_chars) AS BIGINT) AS chars FROM documents WHERE source NOT IN ('src3', 'src4') GROUP BY source",
    "confidence_tier": f"""WITH {_G[5:]}, t AS (SELECT a.query, a.best_score AS top, a.best_score - b.best_score AS margin, COALESCE(a.best_score - b.best_score < 1.5 AND a.number = b.number AND a.part <> b.part, FALSE) AS tie FROM (SELECT * FROM st WHERE rank = 1) a LEFT JOIN (SELECT * FROM st WHERE rank = 2) b USING (query)),
m AS (SELECT t.*, (top - 20) / 4 AS logit, len(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(T.FILLER_WORDS)}))) AS n FROM t JOIN benchmark ON item_id = query)
SELECT query AS item_id, CASE WHEN logit >= 4 AND n >= 3 AND NOT tie THEN 'high' WHEN logit >= 4 AND n >= 3 OR logit >= 0 THEN 'medium' ELSE 'low' END AS tier, CAST(greatest(1, least(99, round_even(100 / (1 + exp(-logit)), 0))) AS BIGINT) AS match_score, round(margin, 4) + 0.0 AS margin, tie AS same_family_tie FROM m""",
    "clarify_dimension": f"""WITH {_G[5:]}, tw AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({quoted(T.TITLE_NOISE)}))) AS words FROM st),
f0 AS (SELECT query, number, COUNT(*) AS n, MIN(rank) AS seen, flatten(list(words)) AS every FROM tw GROUP BY query, number HAVING COUNT(*) > 1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY COUNT(*) DESC, MIN(rank)) = 1),
f1 AS (SELECT query, rank, part, standard_id, title, list_transform(list_sort(list_filter(words, lambda w: len(list_filter(every, lambda x: x = w)) * 2 <= n))[1:4], lambda w: upper(w[1]) || w[2:]) AS own FROM tw JOIN f0 USING (query, number)),
f AS (SELECT query, string_agg('Part ' || part || ' - ' || (CASE WHEN len(own) > 0 THEN array_to_string(own, ' / ') ELSE title END) || '=' || standard_id, '; ' ORDER BY rank) AS options FROM f1 GROUP BY query),
r0 AS (SELECT query, role, COUNT(*) AS n, MIN(rank) AS seen, role || '=' || string_agg(standard_id, '+' ORDER BY standard_id) AS o FROM st GROUP BY query, role), r AS (SELECT query, string_agg(o, '; ' ORDER BY n DESC, seen) AS options FROM r0 GROUP BY query HAVING COUNT(*) >= 2),
p AS (SELECT query, string_agg(standard_id || '=' || standard_id, '; ' ORDER BY rank) AS options FROM st WHERE rank <= 4 GROUP BY query HAVING COUNT(*) >= 2)
SELECT query AS item_id, CASE WHEN query % 3 <> 0 AND f.options IS NOT NULL THEN 'part' WHEN r.options IS NOT NULL THEN 'role' ELSE 'product' END AS dimension, CASE WHEN query % 3 <> 0 AND f.options IS NOT NULL THEN f.options ELSE COALESCE(r.options, p.options) END AS options
FROM (SELECT DISTINCT query FROM st) LEFT JOIN f USING (query) LEFT JOIN r USING (query) LEFT JOIN p USING (query) WHERE COALESCE(CASE WHEN query % 3 <> 0 THEN f.options END, r.options, p.options) IS NOT NULL""",
    "version_texts": """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no edition held' ELSE 'IS ' || p_partkey || CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN ' (Edition ' || p_size || ', reaffirmed 2019)' WHEN p_partkey % 3 <> 0 THEN ' (Edition ' || p_size || ')' WHEN p_partkey % 2 = 0 THEN ' (reaffirmed 2019)' ELSE '' END || ': as its own text says; later revisions are not looked up' END AS version FROM part""",
    "guarded_withdrawals": f"WITH {_S} SELECT id, 'all known' AS run FROM old WHERE is_active = 1 AND id NOT IN (SELECT id FROM new)",
    "changed_ids": f"WITH {_S} SELECT new.id, new.id % 5 = 0 AS lost FROM new LEFT JOIN old USING (id) WHERE old.fp IS DISTINCT FROM new.fp",
    "expected_orders": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 1",
    "answer_narrowing": f"WITH {_G[5:]} SELECT query AS item_id, rank, standard_id FROM st WHERE query % 2 <> 0 OR rank IN (2, 3) OR query NOT IN (SELECT query FROM st WHERE rank IN (2, 3))",
    "request_rate": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS offered FROM events",
    "history_cap": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, key) AS place FROM (SELECT user_id, event_type || '::' || props AS key, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type || '::' || props ORDER BY ts) = 1) QUALIFY place <= 10",
}
_DECIDED = SQL["ingest_decision"]
SQL["rate_limiter"] = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, us IS NOT NULL AS admitted, CASE WHEN us IS NULL THEN [] ELSE [us] END AS seen FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, n, us IS NOT NULL AND len(held) < 2, CASE WHEN us IS NOT NULL AND len(held) < 2 THEN list_append(held, us) ELSE held END
FROM (SELECT e.*, list_filter(w.seen, lambda x: e.us - x <= 43200000000) AS held FROM w JOIN e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.n = w.n + 1))
SELECT CAST(user_id AS VARCHAR) AS client, event_id AS request, admitted FROM w"""
SQL["ocr_cache"] = """
WITH d AS (SELECT doc_id, lang, COALESCE(text, '') AS text FROM documents WHERE lang IS NOT NULL), f AS (SELECT DISTINCT text, lang FROM d WHERE doc_id % 3 <> 0)
SELECT doc_id, sha256(octet_length(encode(d.text)) || ' bytes in ' || d.lang || ': ' || d.text) AS text_sha256, CASE WHEN f.text IS NULL THEN 'second' ELSE 'first' END AS run FROM d LEFT JOIN f ON f.text = d.text AND f.lang = d.lang"""
SQL["change_cycle"] = """
WITH o AS (SELECT p, no FROM (SELECT o_custkey % 50 AS p, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS no FROM orders) WHERE no <= 40),
x AS (SELECT 'IS ' || (p * 100 + no + 1000) AS standard_id, p % 5 = 0 AND no = 1 AS gone, p % 5 = 0 AND no = 2 AS again, FALSE AS fresh FROM o
UNION ALL SELECT DISTINCT 'IS ' || (p * 100 + 1099), FALSE, FALSE, TRUE FROM o WHERE p % 5 = 0)
SELECT standard_id, CASE WHEN gone THEN 'WITHDRAWN' ELSE 'ACTIVE' END AS status, CASE WHEN gone THEN 0 ELSE 1 END AS is_active, CASE WHEN fresh THEN '2' ELSE '1' END AS first_seen, CASE WHEN fresh OR again THEN '2' ELSE '1' END AS last_seen,
CASE WHEN fresh THEN '2:NEW' WHEN gone THEN '1:NEW,2:WITHDRAWN' ELSE '1:NEW' END AS changes FROM x"""
SQL["resumable_ingest"] = """
WITH d AS (SELECT 'f' || doc_id AS source, CASE WHEN doc_id % 7 = 0 THEN 'new ' ELSE '' END || COALESCE(text, '') AS text FROM documents WHERE doc_id % 11 <> 0)
SELECT source, sha256(text) AS sha256, CAST(ceil(length(text) / 1000) AS BIGINT) AS chunks, CAST(ceil(length(text) / 1000) AS BIGINT) AS n_chunks, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM d"""
SQL["pending_files"] = _DECIDED[: _DECIDED.rindex("\nSELECT")] + """, o AS (SELECT 'f' || l_partkey AS source, l_orderkey || '-' || l_linenumber AS id FROM lineitem WHERE l_partkey % 23 <> 0)
SELECT r.source, any_value(reason) AS reason, COUNT(id) AS n_old, sha256(COALESCE(string_agg(id, ',' ORDER BY id), '')) AS old_sha256 FROM r LEFT JOIN o USING (source) WHERE reason <> 'unchanged' GROUP BY r.source"""
QUERIES = {
    f.__name__: f
    for f in (outgoing_ranked, citation_chain, standard_references, unparsed_targets, edge_resolve, edge_stats, edges_by_confidence, link_extract, index_inventory, ingest_decision, gone_files, stale_chunks, upsert_delta, withdrawals, snapshot_diff, report_merge, confidence_tier, clarify_dimension, version_texts, pending_files, resumable_ingest, ocr_cache, change_cycle, guarded_withdrawals, changed_ids, expected_orders, answer_narrowing, request_rate, rate_limiter, history_cap)
}
