"""Sources, sinks and streams on files made here."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from lodestone.sources import documents as D
from lodestone.sources import tables as S
from lodestone.streaming.cdc import Tracker
from lodestone.streaming.limiter import rate_limited, rate_limited_stream


def docx(paragraphs, rows):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def xlsx(*sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, rows in enumerate(sheets, 1):
            body = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{c}</t></is></c>' for j, c in enumerate(r) if c) + "</row>" for i, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_uploads(spark, tmp_path):
    files = {"a.txt": "café".encode(), "b.txt": "café".encode("cp1252"), "c.txt": "café".encode("utf-16"), "d.docx": docx(["One", " "], [["x", "y"]]), "e.pdf": b"%PDF", "f.xyz": b"1", "g.txt": b"", "h.docx": b"no zip", "i.md": b"  "}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    f = D.binary_files(spark, str(tmp_path))
    empty = spark.createDataFrame([("g.txt", "", 0, "", bytearray())], f.schema)  # a file scan leaves empty files out
    good, bad = D.parsed_uploads(f.filter("filename <> 'g.txt'").unionByName(empty), lambda data, n: ["page one", "", "page two"])
    assert {r.filename: r.text for r in good.collect()} == {"a.txt": "café", "b.txt": "café", "c.txt": "café", "d.docx": "One\nx | y", "e.pdf": "page one\n\npage two"}
    assert {r.filename: r.reason for r in bad.collect()} == {"f.xyz": "unsupported type", "g.txt": "empty", "h.docx": "unreadable: BadZipFile", "i.md": "no text"}
    assert f.filter("filename = 'a.txt'").first().sha256 == __import__("hashlib").sha256(files["a.txt"]).hexdigest()


def test_workbooks(spark, tmp_path):
    table = [["Bureau report"], ["Printed on", "today"], ["Sr", "IS Number", "Title", "Email", "Status"], ["1", "is 10  : 2000", "Pumps", "a@b.org", "Active"], ["2", "", "No id", "", ""], ["3", "IS 11", "Call 9876543210", "", ""]]
    pairs = [["Standard No:", "IS 5 : 1999"], ["Title:", "Ropes"], ["Title:", "second"], ["Email:", "x@y.org"]]
    (tmp_path / "w.xlsx").write_bytes(xlsx(table, pairs))
    (tmp_path / "bad.xlsx").write_bytes(b"zz")
    rows = D.sheet_rows(D.binary_files(spark, str(tmp_path), "*.xlsx"))
    lay = {r.sheet[-6:-4]: (r.is_table, r.header_row) for r in D.sheet_layout(rows).collect()}
    assert lay == {"t1": (True, 2), "t2": (False, 0)}
    got = {r.standard_id: r for r in D.standard_records(D.sheet_records(rows)).collect()}
    assert set(got) == {"IS 10 : 2000", "IS 11", "IS 5 : 1999"} and got["IS 10 : 2000"].status == "Active" and got["IS 11"].title == "Call [redacted]" and got["IS 5 : 1999"].title == "Ropes"
    assert not any("@" in r.raw_text_excerpt for r in got.values())


def test_text_records(spark):
    df = spark.createDataFrame([("Title: Steel tubes for water Status: Active Edition: 2", "/x/is_9.pdf"), ("IS 44 : 1990 nothing", "y.pdf")], "t string, s string")
    a, b = (r.x for r in df.select(D.text_record(F.col("t"), F.col("s")).alias("x")).collect())
    assert a.standard_id == "IS_9" and a.title == "Steel tubes for water" and a.extraction_warnings == ["No IS number found"] and b.standard_id == "IS 44 : 1990" and b.title == "IS 44 : 1990"


def test_pages_and_warnings(spark):
    p = spark.createDataFrame([("f", 1, "x" * 300, None, False), ("f", 2, "", "", False), ("g", 1, "Hkkjrh", None, True)], "filename string, page int, text string, ocr_text string, legacy_font boolean")
    s = {r.filename: r for r in D.file_warnings(D.pdf_summary(D.page_table(p)).withColumn("standard_id", F.when(F.col("filename") == "f", "IS 1")).withColumn("chunks", F.lit(1))).collect()}
    assert s["f"].total_chars == 300 and s["f"].empty_pages == 1 and s["f"].warnings == ["low yield", "empty pages"]
    assert s["g"].legacy_font_pages == 1 and s["g"].warnings == ["no catalogue entry", "low yield", "legacy-font pages"]


def test_json_sources(spark, tmp_path):
    assert S.catalog(spark, str(tmp_path / "none.json")).count() == 0 and S.graph(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert S.graph(spark, str(tmp_path / "bad.json")).count() == 0
    import pytest

    with pytest.raises(Exception):
        S.catalog(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "m.json").write_text(json.dumps([{"source": "a", "sha256": "h", "chunks": 3}]))
    assert S.manifest(spark, str(tmp_path / "m.json")).first().chunks == 3
    (tmp_path / "old.json").write_text(json.dumps(["a", "b"]))
    assert S.manifest(spark, str(tmp_path / "old.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"cases": [{"id": "1", "query": "q", "expected": "x"}]}))
    assert S.eval_cases(spark, str(tmp_path / "e.json")).first().expected == "x"


def test_files_as_objects(spark, tmp_path):
    """A graph with its edges nested, a manifest keyed by file name, a report with a list of files; damaged ones are empty."""
    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x, indent=1)) and str(tmp_path / name)
    g = S.graph(spark, put("g.json", {"documents": 2, "edges": [{"from": "IS 1", "to_number": "2", "role": "sampling", "page": 4}, {"from": "IS 3", "to_number": "5"}]}))
    assert {(r.src, r.to_number, r.page) for r in g.collect()} == {("IS 1", "2", 4), ("IS 3", "5", None)}
    m = S.manifest(spark, put("o.json", {"a.pdf": {"sha256": "x", "chunks": 3, "standard_id": None, "ingested_at": "t"}, "b.pdf": {"sha256": "y", "chunks": 0}}))
    assert {(r.source, r.sha256, r.chunks) for r in m.collect()} == {("a.pdf", "x", 3), ("b.pdf", "y", 0)}
    r = S.report(spark, put("r.json", {"generated_at": "t", "totals": {"files": 1}, "files": [{"filename": "a.pdf", "total_pages": 7}, {"no": 1}]}))
    assert [(x.filename, x.total_pages) for x in r.collect()] == [("a.pdf", 7)]
    for bad in ("{not json", "[1, 2]", '["a"]', "", "{}"):
        path = put("bad.json", bad or " ")
        assert S.graph(spark, path).count() == S.manifest(spark, path).count() == S.report(spark, path).count() == 0
    assert S.manifest(spark, str(tmp_path / "none.json")).count() == S.report(spark, str(tmp_path / "none.json")).count() == 0


def test_runs_that_fail_are_logged_and_done_again(spark, tmp_path):
    t = Tracker(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("IS 1", "a", "ACTIVE", None, 0)], "standard_id string, title string, status string, last_amendment_date string, position int")
    import pytest

    with pytest.raises(Exception):
        t.run(rows.drop("position"), "r1", page_hash="h")
    assert {tuple(r) for r in t.run_states().collect()} == {("r1", "FAILED")} and t.last_run() == (None, None)
    assert t.run(rows, "r2", page_hash="h") == "CHANGED" and t.run(rows, "r3", page_hash="h") == "NO_CHANGE"
    assert {tuple(r) for r in t.run_states().collect()} == {("r1", "FAILED"), ("r2", "CHANGED"), ("r3", "NO_CHANGE")} and t.current().count() == 1


def test_categories_and_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿Name,URL,Created At\nPump (V2) as per IS 5 : 1999,u,t\n".encode())
    c = S.categories(spark, str(tmp_path / "c.csv"))
    assert c.first().product_name == "Pump" and S.by_standard_number(c).first().number == "5"
    cat = spark.createDataFrame([("f", "IS 1", "", True)], "filename string, standard_id string, title string, verified boolean")
    full = cat.select("*", *(F.lit(None).cast("string").alias(x) for x in S.METADATA_FIELDS if x not in ("standard_id", "title")))
    got = {r.filename: r for r in S.chunk_metadata(spark.createDataFrame([("f",), ("g",)], "filename string"), full).collect()}
    assert (got["f"].standard_id, got["f"].title, got["g"].standard_id) == ("IS 1", None, "g")
    new = spark.createDataFrame([("f", "IS 2", "n", False), ("h", "IS 3", "n", False)], cat.schema)
    assert {r.filename: r.standard_id for r in S.keep_verified(cat, new).collect()} == {"f": "IS 1", "h": "IS 3"}


def test_cache_versions_and_validation(spark, tmp_path):
    q = spark.createDataFrame([(" Pump ",), ("rope",)], "query string")
    c = q.select(S.cache_key(F.lower(F.trim("query"))).alias("key"), F.expr("timestamp'2024-01-01 00:00:00'").alias("fetched_at"), F.lit("p").alias("payload"))
    hits = lambda at: [r.payload for r in S.cached(q, c, F.expr(f"timestamp'{at}'")).collect()]
    assert hits("2024-01-02 00:00:00") == ["p", "p"] and hits("2024-01-02 00:00:01") == [None, None]
    v = S.Versions(spark, str(tmp_path / "v"))
    assert v.current() is None and v.read() is None
    assert v.write(q) == 1 and v.write(q.limit(1)) == 2 and v.read().count() == 1
    ok, no = S.valid_documents(spark.createDataFrame([("a", "x"), ("", "x"), ("b", ""), ("c" * 201, "x")], "id string, content string"))
    assert ok.count() == 1 and no.count() == 3
    assert S.corpus_fingerprint(q, q) != S.corpus_fingerprint(q.limit(1), q)


def run(rows, spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "standard_id string, title string, status string, last_amendment_date string, position int")


def test_change_tracking(spark, tmp_path):
    t = Tracker(spark, str(tmp_path / "cdc"))
    first = run([("IS 1", "a", "Active", None), ("IS 2", "b", "Active", None)], spark)
    assert t.run(first, "0001") == "CHANGED" and t.run(first, "0002") == "NO_CHANGE"
    assert t.run(run([("IS 1", "a2", "Active", None)], spark), "0003", complete=False) == "CHANGED"
    assert t.current().filter("is_active = 1").count() == 2
    assert t.run(run([("IS 1", "a2", "Active", None), ("IS 3", "c", "Active", None)], spark), "0004") == "CHANGED"
    assert {(r.run_id, r.standard_id, r.change_type) for r in t.deltas().collect()} == {("0001", "IS 1", "NEW"), ("0001", "IS 2", "NEW"), ("0003", "IS 1", "UPDATED"), ("0004", "IS 3", "NEW"), ("0004", "IS 2", "WITHDRAWN")}
    assert t.current().filter("standard_id = 'IS 2'").first().status == "WITHDRAWN"


def test_change_stream(spark, tmp_path):
    where = str(tmp_path / "landed")
    run([("IS 1", "a", "Active", None)], spark).write.parquet(where + "/1")
    t = Tracker(spark, str(tmp_path / "cdc"))
    source = lambda: spark.readStream.schema("standard_id string, title string, status string, last_amendment_date string, position int").parquet(where + "/*")
    t.stream(source(), str(tmp_path / "ck")).awaitTermination()
    run([("IS 1", "b", "Active", None), ("IS 2", "n", "Active", None)], spark).write.parquet(where + "/2")
    t.stream(source(), str(tmp_path / "ck")).awaitTermination()
    assert t.current().count() == 2 and t.runs().filter("status = 'CHANGED'").count() == 2


LIMITS = [("u", 0.0, True), ("u", 1.0, True), ("u", 60.0, False), ("u", 60.5, True), ("u", 61.0, False), ("u", 61.5, True), ("v", 5.0, True)]


def test_requests_without_a_time_are_rejected(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", 5.0, 3), (None, None, 4), (None, 1.0, 5)], "client string, s double, id long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.request: r.admitted for r in rate_limited(df, "client", "ts", "id", 2, 60.0).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True}


def test_rate_limiter_at_the_edges(spark, tmp_path):
    rows = [(c, F.lit(0) is not None and at, i) for i, (c, at, _) in enumerate(LIMITS)]
    df = spark.createDataFrame(rows, "client string, s double, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request: r.admitted for r in rate_limited(df, "client", "ts", "id", 2, 60.0).collect()}
    assert [got[i] for i in range(len(LIMITS))] == [x for _, _, x in LIMITS]
    df.select("client", "ts", "id").write.parquet(str(tmp_path / "in"))
    s = rate_limited_stream(spark.readStream.schema("client string, ts timestamp, id long").parquet(str(tmp_path / "in")), "client", "ts", "id", 2, 60.0)
    q = s.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.request: r.admitted for r in spark.sql("select * from limited").collect()} == got


def test_monitored_pages(spark, tmp_path):
    import pytest

    from lodestone.sources import pages as P

    (tmp_path / "a.html").write_text("<p>x</p>\n<script>1</script>")
    (tmp_path / "b.html").write_text("<p>y</p>")
    p = P.landed_pages(spark, str(tmp_path))
    hashes = {r.page: r.page_hash for r in p.collect()}
    state = spark.createDataFrame([("a.html", hashes["a.html"], "t0"), ("b.html", "old", "t0")], "key string, value string, updated_at string")
    assert [r.page for r in P.changed_pages(p, state).collect()] == ["b.html"]
    new = P.set_state(state, spark.createDataFrame([("b.html", hashes["b.html"], "t1")], state.schema))
    assert P.changed_pages(p, new).count() == 0 and new.count() == 2
    (tmp_path / "a.html").write_text("<p>x</p>  <script>2</script>")
    assert P.changed_pages(P.landed_pages(spark, str(tmp_path)), new).count() == 0
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        P.with_retries(fails, 4, 200.0, waits.append)
    assert len(calls) == 4 and waits == [200.0, 300.0, 300.0] and P.with_retries(lambda: 5) == 5


def test_script_routing(spark):
    """Every row once and in order, each model asked once a row, missing scores kept, other columns as they were."""
    from lodestone.sources.pages import route_scripts

    t = spark.createDataFrame([(1, "भारत", "a"), (2, "hello there", "b"), (3, "namaste ji", "c"), (4, "no score", "d"), (5, None, "e"), (6, "", None)], "id long, text string, __roman string").coalesce(1)

    def model(name, score):
        def make():
            seen = set()

            def ask(texts):
                assert not seen & {x for x in texts if x}, "asked twice"
                seen.update(texts)
                return [(name, None if x == "no score" else 0.6 if x == "namaste ji" else score) for x in texts]

            return ask

        return make

    got = [tuple(r) for r in route_scripts(t, "text", model("hi", 0.9), model("en", 0.9), model("hi-Latn", 0.7), rows=4).collect()]
    assert got == [(1, "भारत", "a", "hi", 0.9), (2, "hello there", "b", "en", 0.9), (3, "namaste ji", "c", "hi-Latn", 0.6), (4, "no score", "d", "en", None), (5, None, "e", "hi", 0.9), (6, "", None, "hi", 0.9)]
    assert route_scripts(t.limit(0), "text", model("a", 1.0), model("b", 1.0), model("c", 1.0)).count() == 0


def test_state_of_clients_who_went_away_goes(spark, tmp_path):
    """State rows fall to zero once the clock has passed the window; a request from before the clock gets no answer."""
    kind = "client string, ts timestamp, id long"

    def batch(k, rows):
        spark.createDataFrame(rows, "client string, s double, id long").select("client", F.timestamp_seconds("s").alias("ts"), "id").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))

    def run():
        s = rate_limited_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in/*")), "client", "ts", "id", 2, 60.0, lateness=10.0)
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]["numRowsTotal"]

    batch(0, [("a", 0.0, 1), ("b", 1.0, 2), ("a", 1.0, 3), ("a", 2.0, 4)])
    assert run() == 2
    batch(1, [("c", 500.0, 5)])
    run()
    batch(2, [("c", 501.0, 6), ("a", 100.0, 7)])
    assert run() == 1
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).withColumnRenamed("request", "id").collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True}
