"""Registered queries read whole tables: small tables made here, with rows beyond the bounds that queries once had."""

from lodestone.operators import retrieval as R
from lodestone.plans import registry


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_discover_ids_of_every_page(spark, tmp_path):
    pages = [7, 99_999, 100_000, 100_007, 12_345_678]
    write(spark, tmp_path, "pages", [(i, "u", "<p>") for i in pages], "page_id long, url string, html string")
    got = sorted((r.page_id, r.standard_id, r.complete) for r in registry.QUERIES["discover_ids"](spark, str(tmp_path)).collect())
    assert got == sorted((i, x, i % 5 != 0) for i in pages for x in (f"IS {i % 100_000} : 2000", f"IS 9{i % 100_000}"))


def test_knn_asks_every_fiftieth_vector(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 0) for i in range(205)]
    write(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    got = registry.QUERIES["knn_topk"](spark, str(tmp_path)).collect()
    assert {r.query for r in got} == {0, 50, 100, 150, 200} and len(got) == 5 * 20
    assert all(r.vec_id == 2 * (r["rank"] - 1) and r.distance == 0 for r in got)


def test_knn_in_blocks_equals_brute_force(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)]
    v = spark.createDataFrame(rows + [(60, None)], "vec_id long, v array<float>").repartition(3)
    q = v.filter("vec_id % 3 = 0").select(v.vec_id.alias("query"), v.v.alias("q"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, j, n) for i, a in rows if i % 3 == 0 for n, (_, j) in enumerate(sorted((round(1 - dot(a, b), 6), j) for j, b in rows)[:4], 1)}
    for block in (4096, 7):
        assert {(r.query, r.vec_id, r["rank"]) for r in R.knn(q, v, 4, block).collect()} == want
    assert R.knn(q.limit(0), v, 4).count() == 0 and R.knn(q, v.limit(0), 4).count() == 0


def test_every_conversation_and_turn_is_answered(spark, tmp_path):
    """Conversation 10 as before, 11 beside it, and words that only turn 7 of conversation 150 has."""
    said = [(10, 0, "red gear"), (11, 0, "red gear"), (150, 0, "nothing"), (150, 7, "blue valve"), (150, 150, "green pump")]
    write(spark, tmp_path, "conversations", [(c, t, "user", x) for c, t, x in said], "conv_id long, turn long, role string, text string")
    docs = [(1, "red gear of steel", "src1"), (2, "blue valve of brass", "src2"), (3, "green pump of iron", "src3"), (4, "other words here", "src4")]
    write(spark, tmp_path, "documents", [(i, x, "en", s, len(x)) for i, x, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.conv_id, r.source, r.passage_hits) for r in registry.QUERIES["merge_passages"](spark, str(tmp_path)).collect()}
    assert got == {(10, "src1", 1), (11, "src1", 1), (150, "src2", 1), (150, "src3", 1)}
    write(spark, tmp_path, "part", [(1, "red gear"), (2, "rope")], "p_partkey long, p_name string")
    asked = {r.conv_id for r in registry.QUERIES["document_recommendations"](spark, str(tmp_path)).collect()}
    assert asked == {10, 11, 150}


def test_files_of_every_part(spark, tmp_path):
    """Parts beyond the bounds of the SQL (650, 690, 700), with every case of the decision table among them."""
    parts = range(600, 2_000)
    write(spark, tmp_path, "part", [(k,) for k in parts], "p_partkey long")
    write(spark, tmp_path, "lineitem", [(k, 10 * k + j, j) for k in parts for j in (1, 2)], "l_partkey long, l_orderkey long, l_linenumber int")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.source for r in run("index_inventory")} == {f"f{k}" for k in parts if k % 23}
    decided = run("ingest_decision")
    assert {r.source for r in decided} == {f"f{k}" for k in parts}
    assert {r.reason for r in decided if int(r.source[1:]) >= 700} == {"mixed", "changed", "interrupted", "unchanged", "unlisted", "new", "missing"}
    assert {r.source for r in run("gone_files")} == {f"f{k}" for k in parts if k % 10 == 4 and (k % 23 or k % 3 != 1)}
    assert {r.source for r in run("manifest_repair")} >= {f"f{k}" for k in parts if k % 3 != 1}


def test_every_part_is_walked_from(spark, tmp_path):
    write(spark, tmp_path, "part", [(k,) for k in range(100)], "p_partkey long")
    got = registry.QUERIES["citation_chain"](spark, str(tmp_path)).collect()
    assert {r.root for r in got} == set(range(100)) and any(r.depth == 3 for r in got) and not any(r.expanded for r in got if r.depth == 3)


def test_allied_numbers_of_six_digits(spark):
    from lodestone.operators import decide

    g = spark.createDataFrame([(1, f"IS {n}", "cited", p) for p, n in enumerate((123_451, 123_452, 12_345))], "query long, code string, role string, position long")
    m = spark.createDataFrame([(1, "IS 123452 : 1999", "proposed", 0), (1, "IS 123453 : 1999", "proposed", 1)], g.schema)
    assert [r.code for r in decide.allied(g, m).orderBy("place").collect()] == ["IS 123451", "IS 123452", "IS 12345", "IS 123453 : 1999"]


def test_sharp_s_at_the_start_of_a_sentence(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import text as T

    assert spark.createDataFrame([("ßheit ENUNG groß",)], "t string").select(T.sentence_case(F.col("t"))).first()[0] == "ẞheit enung groß"


def write_documents(spark, folder, texts):
    write(spark, folder, "documents", [(i, x, "en", "s", len(x)) for i, x in texts], "doc_id long, text string, lang string, source string, n_chars long")


def test_numbers_of_cards_and_addresses_are_no_citations(spark, tmp_path):
    """Texts in capitals have the word IS before card numbers and addresses."""
    write_documents(spark, tmp_path, [(1, "THEN IS 4782437528475387 HERE\nTHAT IS 36.132.194.208 THERE"), (2, "THEN IS 456 HERE and IS 800.2007 THERE")])
    got = sorted((r.doc, r.to_number, r.cited_year) for r in registry.QUERIES["reference_extract"](spark, str(tmp_path)).collect())
    assert got == [(1, "10001", "2000"), (1, "10002", None), (2, "10002", "1960"), (2, "456", None), (2, "800", "2007")]
    write(spark, tmp_path, "part", [(1,)], "p_partkey long")
    got = sorted((r.doc, r.to_number, r.resolved_id) for r in registry.QUERIES["graph_edges"](spark, str(tmp_path)).collect())
    assert got == [(1, "10001", "IS 10001 : 2001"), (1, "10002", None), (2, "10002", None), (2, "456", None), (2, "800", None)]


def test_numbers_of_cards_make_no_category(spark, tmp_path):
    write(spark, tmp_path, "pages", [(4, "u", "<p>Shly is 4859855714882215 there</p><p>is 36.132.194.208</p>"), (9, "u", "<p>Rope is 4859 there</p>")], "page_id long, url string, html string")
    assert sorted(map(tuple, registry.QUERIES["html_strategy"](spark, str(tmp_path)).select("page_id", "found_by", "n").collect())) == [(4, "text_shape", 1), (9, "text_shape", 2)]


def test_names_of_mail_addresses_are_no_numbers(spark, tmp_path):
    """Words and numbers make the names of mail addresses: is.37@..., in capitals in some texts."""
    mail = "anth IS.37@MAIL4.EXAMPLE.COM there\nthat is.37@mail4.example.com, IS 51.a-b@x.org here"
    write_documents(spark, tmp_path, [(1, mail), (2, mail + "\nthen IS 456 there @ home")])
    got = sorted((r.doc, r.to_number) for r in registry.QUERIES["reference_extract"](spark, str(tmp_path)).collect())
    assert got == [(1, "10001"), (1, "10002"), (2, "10002"), (2, "456")]
    write(spark, tmp_path, "part", [(1,)], "p_partkey long")
    assert sorted((r.doc, r.to_number) for r in registry.QUERIES["graph_edges"](spark, str(tmp_path)).collect()) == got
    write(spark, tmp_path, "pages", [(4, "u", "<p>t lyin is.37@mail4.example.com thnt</p>"), (9, "u", "<p>Rope is 4859 there</p>")], "page_id long, url string, html string")
    assert sorted(map(tuple, registry.QUERIES["html_strategy"](spark, str(tmp_path)).select("page_id", "found_by", "n").collect())) == [(4, "text_shape", 1), (9, "text_shape", 2)]
