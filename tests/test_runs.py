"""Runs that die between steps, are repeated, or meet: ingestion, change tracking, versions."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import buckets as B
from lodestone.sources import tables as S
from lodestone.streaming.cdc import Tracker
from lodestone.streaming.ingest import Ingest

KIND = "standard_id string, title string, status string, last_amendment_date string, position int"


def cut(files):
    return files.select("source", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("k", "text")).select("source", F.concat("source", F.lit("::"), "k").alias("chunk_id"), "text")


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string").withColumn("sha256", F.sha2("text", 256))


def held(work):
    m = sorted((r.source, r.sha256, r.chunks) for r in work.manifest.read().collect())
    return m, sorted((r.source, r.chunk_id, r.text, r.source_sha256, r.source_chunks) for r in work.chunks.read().collect())


FIRST = {"a": "one two three", "b": "four", "c": "", "d": "five six"}
SECOND = {"a": "one two", "b": "four", "c": "", "e": "seven"}


@pytest.mark.parametrize("dies", ["cut", "chunks written", "chunks put", "old ones left", "manifest put", "prune put"])
def test_a_run_that_dies_is_finished_by_the_next(spark, tmp_path, dies, monkeypatch):
    clean = Ingest(spark, str(tmp_path / "clean"), cut, 4)
    for t in (FIRST, SECOND):
        clean.run(files(spark, t), complete=True, prune=True)
    work = Ingest(spark, str(tmp_path / "work"), cut, 4)
    work.run(files(spark, FIRST), complete=True, prune=True)

    def dead(*a, **k):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if dies == "cut":
            m.setattr(work, "cut", dead)
        elif dies == "chunks written":
            m.setattr(work.chunks.log, "put", dead)
        elif dies == "chunks put":
            m.setattr(work.manifest, "write", dead)
        elif dies == "old ones left":
            put = work.chunks.write
            m.setattr(work.chunks, "write", lambda rows, gone=None: put(rows, gone) if rows is not None else dead())
        elif dies == "manifest put":
            own = work.manifest.write
            m.setattr(work.manifest, "write", lambda *a, **k: own(*a, **k) and dead())
        else:
            own = work.chunks.write
            m.setattr(work.chunks, "write", lambda rows, gone=None: own(rows, gone) if rows is not None else own(rows, gone) and dead())
        with pytest.raises(OSError):
            work.run(files(spark, SECOND), complete=True, prune=True)
    decided = {r.source: r.decision for r in work.run(files(spark, SECOND), complete=True, prune=True).collect()}
    assert held(work) == held(clean) and (dies != "manifest put" or set(decided.values()) == {"skip"})
    at = work.chunks.version(), work.manifest.version()
    assert {r.decision for r in work.run(files(spark, SECOND), complete=True, prune=True).collect()} == {"skip"}
    assert (work.chunks.version(), work.manifest.version()) == at


def test_files_as_a_stream(spark, tmp_path):
    work = Ingest(spark, str(tmp_path / "work"), cut, 4)
    for k, t in enumerate((FIRST, SECOND)):
        files(spark, t).write.parquet(str(tmp_path / f"landed/{k}"))
        source = spark.readStream.schema("source string, text string, sha256 string").parquet(str(tmp_path / "landed/*"))
        work.stream(source, str(tmp_path / "ck")).awaitTermination()
    assert {r.source: r.chunks for r in work.manifest.read().collect()} == {"a": 2, "b": 1, "c": 0, "d": 2, "e": 1}
    assert sorted(r.text for r in work.chunks.read().filter("source = 'a'").collect()) == ["one", "two"]


def test_a_tracker_writes_buckets_it_has_seen(spark, tmp_path):
    t = Tracker(spark, str(tmp_path / "t"), 16)
    rows = [(f"IS {i}", "a", "Active", None, i) for i in range(300)]
    t.run(spark.createDataFrame(rows, KIND), "0001")
    before = t.table.log.latest()[1]["folders"]
    t.run(spark.createDataFrame([("IS 7", "b", "Active", None, 0), ("IS 900", "n", "Active", None, 1)], KIND), "0002", complete=False)
    after = t.table.log.latest()[1]["folders"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2
    now = {r.standard_id: (r.title, r.first_seen, r.last_seen) for r in t.current().collect()}
    assert len(now) == 301 and now["IS 7"] == ("b", "0001", "0002") and now["IS 8"] == ("a", "0001", "0001")


def test_a_run_that_is_repeated_or_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = Tracker(spark, str(tmp_path / "t"), 4)
    a, b = (spark.createDataFrame([("IS 1", x, "Active", None, 0)], KIND) for x in "ab")
    t.run(a, "0001")
    with monkeypatch.context() as m:
        m.setattr(t.table.log, "put", lambda *x: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            t.run(b, "0002")
    assert t.current().first().title == "a" and {r.run_id for r in t.deltas().collect()} == {"0001"}
    assert t.run(b, "0003") == "CHANGED"
    state = t.table.version(), sorted(map(tuple, t.current().collect())), sorted(map(tuple, t.deltas().collect()))
    assert t.run(b, "0003") == "CHANGED" and t.run(b, "0004") == "NO_CHANGE"
    assert (t.table.version(), sorted(map(tuple, t.current().collect())), sorted(map(tuple, t.deltas().collect()))) == state


def test_two_runs_at_once(spark, tmp_path):
    t, other = (Tracker(spark, str(tmp_path / "t"), 4) for _ in range(2))
    t.run(spark.createDataFrame([("IS 1", "a", "Active", None, 0)], KIND), "0001")
    write, seen = t.table.write, []

    def late(*x, **k):
        if not seen:
            seen.append(other.run(spark.createDataFrame([("IS 2", "b", "Active", None, 0)], KIND), "0002", complete=False))
        return write(*x, **k)

    t.table.write = late
    with pytest.raises(B.Conflict):
        t.run(spark.createDataFrame([("IS 3", "c", "Active", None, 0)], KIND), "0003", complete=False, attempts=1)
    seen.clear()
    other.run = lambda *x, **k: Tracker.run(other, x[0].withColumn("title", F.lit("again")), "0004", complete=False)
    assert t.run(spark.createDataFrame([("IS 3", "c", "Active", None, 0)], KIND), "0005", complete=False) == "CHANGED"
    assert sorted((r.standard_id, r.title) for r in t.current().collect()) == [("IS 1", "a"), ("IS 2", "again"), ("IS 3", "c")]
    assert {(r.run_id, r.status) for r in t.run_states().collect()} >= {("0003", "FAILED"), ("0005", "CHANGED")}


def test_two_writers_of_versions(spark, tmp_path):
    v, other = (S.Versions(spark, str(tmp_path / "v")) for _ in range(2))
    put, seen = v.log.put, []
    v.log.put = lambda *a: (seen or not seen.append(other.write(spark.range(3)))) and put(*a)
    assert v.write(spark.range(5)) == 2 and seen == [1] and other.read().count() == 5
    with pytest.raises(B.Conflict):
        v.write(spark.range(7), upto=1)
    assert other.read().count() == 5


def test_pages_are_read_once(spark, tmp_path):
    """A second run calls the recogniser for no page; what could not be read is tried again."""
    from lodestone.sources.recognised import Recognised

    calls = tmp_path / "calls"

    def make():
        def read(contents, languages):
            with open(calls, "a") as f:
                f.writelines(f"{c!r} {x}\n" for c, x in zip(contents, languages, strict=True))
            return [None if c == b"blank" else f"{c.decode()} in {x}" for c, x in zip(contents, languages, strict=True)]

        return read

    r = Recognised(spark, str(tmp_path / "cache"), make, 4, rows=2)
    rows = [(1, b"a", "en"), (2, b"a", "en"), (3, b"a", "hi"), (4, b"blank", "en"), (5, None, "en"), (6, b"", None)]
    pages = spark.createDataFrame([(*x, "mine") for x in rows], "page int, content binary, language string, __hash string").repartition(3)
    want = {1: "a in en", 2: "a in en", 3: "a in hi", 4: None, 5: None, 6: " in "}
    for run, n in (("1", 4), ("2", 1)):
        out = r.read(pages, run).collect()
        assert {x.page: x.ocr_text for x in out} == want and all(x["__hash"] == "mine" for x in out)
        assert len(calls.read_text().splitlines()) == n
        calls.write_text("")
    assert r.read(pages.filter("page <> 4")).count() == 5 and calls.read_text() == "" and r.cache.version() == 1


def test_the_change_cycle(spark, tmp_path, monkeypatch):
    """Each branch: nothing new, new and changed rows, an id without a record, an incomplete page, withdrawal, a run that dies and is repeated."""
    from lodestone.sources.pages import landed_pages
    from lodestone.streaming.cycle import Cycle

    asked, without = [], set()

    def collect(ids):
        got = sorted(r.standard_id for r in ids.collect())
        asked.append(got)
        return spark.createDataFrame([(x, f"t {x}", "ACTIVE", None, 0) for x in got if x not in without], KIND)

    land = tmp_path / "land"
    land.mkdir()
    row = lambda i, x="": f"<tr><td>IS {i}</td><td>{x}</td></tr>"
    put = lambda page, *rows, more="": (land / f"{page}.html").write_text("<table>" + "".join(rows) + "</table>" + more)
    c = Cycle(spark, str(tmp_path / "state"), collect, buckets=4)
    run = lambda k: c.run(landed_pages(spark, str(land)), k)
    now = lambda: {r.standard_id: r.status for r in c.tracker.current().collect()}
    put("a", row(1), row(2))
    put("b", row(3))
    assert run("01")["targets"] == 3 and now() == {f"IS {i}": "ACTIVE" for i in (1, 2, 3)}
    assert run("02") == {"status": "NO_CHANGE", "pages": 0, "targets": 0, "missing": 0} and len(asked) == 1
    put("a", row(1, "new"), row(2))
    assert run("03")["targets"] == 1 and asked[-1] == ["IS 1"]
    without.add("IS 4")
    put("a", row(1, "new"), row(4))
    assert run("04")["missing"] == 1 and now()["IS 2"] == "ACTIVE"
    without.clear()
    put("b", row(3), row(5), more='<a href="?page=2">next</a>')
    with monkeypatch.context() as m:
        m.setattr(c.listed, "write", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            run("05")
    state = sorted(map(tuple, c.tracker.current().collect())), c.tracker.table.version()
    assert now() == {f"IS {i}": "ACTIVE" for i in range(1, 6)}
    assert run("05")["status"] == "CHANGED" and (sorted(map(tuple, c.tracker.current().collect())), c.tracker.table.version()) == state
    put("a", row(1, "new"))
    put("b", row(3))
    assert run("06")["status"] == "CHANGED" and now() == {"IS 1": "ACTIVE", "IS 2": "WITHDRAWN", "IS 3": "ACTIVE", "IS 4": "WITHDRAWN", "IS 5": "WITHDRAWN"}
    assert {(r.standard_id, r.change_type) for r in c.tracker.deltas().filter("run_id = '06'").collect()} == {(f"IS {i}", "WITHDRAWN") for i in (2, 4, 5)}
    c.stream(landed_pages(spark, str(land), stream=True), str(tmp_path / "ck")).awaitTermination()
    assert sorted(x for xs in asked[6:] for x in xs) == [] and now()["IS 1"] == "ACTIVE"


def test_texts_are_not_shuffled_where_they_are_not_asked_for(spark, tmp_path):
    """A table of joined folders gives the columns asked for, shuffles no others, and deals the rows of a file once; few or all files are picked without a shuffle."""
    from lodestone.sources.buckets import Buckets
    from lodestone.streaming import ingest

    t = Buckets(spark, str(tmp_path / "t"), ["source", "chunk_id"], "source string, chunk_id string, text string, n long", 2)
    for k in range(3):
        t.write(spark.createDataFrame([(f"f{i}", f"c{j}", f"{i} {j} {k}", k) for i in range(k, 9) for j in range(3)], t.schema), None if k < 2 else spark.createDataFrame([("f0", "c0")], "source string, chunk_id string"))
    want = {(f"f{i}", f"c{j}", f"{i} {j} {min(i, 2)}", min(i, 2)) for i in range(9) for j in range(3)} - {("f0", "c0", "0 0 0", 0)}
    assert {tuple(r) for r in t.read().collect()} == want
    assert {tuple(r) for r in t.read(columns=["n", "source"]).collect()} == {(s, n) for s, _, _, n in want} and t.read(columns=["n", "source"]).count() == len(want)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan(t.read(columns=["source", "n"]))
    dealt = t.read(columns=["source", "chunk_id", "text"], together="source").groupBy("source").agg(F.max("text"))
    assert plan(dealt).count("Exchange") == 1 and {tuple(r) for r in dealt.collect()} == {(s, max(x[2] for x in want if x[0] == s)) for s, *_ in want}

    seen = []

    def cut(files):
        seen.append(plan(files))
        return files.select("source", F.concat("source", F.lit("::c1")).alias("chunk_id"), "text")

    files = lambda new: spark.createDataFrame([(f"f{i}", f"text {i} {i in new}", f"sha {i} {i in new}") for i in range(20)] + [(None, "x", "x")], "source string, text string, sha256 string")
    work = ingest.Ingest(spark, str(tmp_path / "w"), cut, 2)
    work.run(files(()))
    work.run(files((3, 4)))
    assert len(seen) == 2 and not any("Exchange hashpartitioning" in x for x in seen)
    assert {(r.source, r.text) for r in work.chunks.read().collect()} == {(f"f{i}", f"text {i} {i in (3, 4)}") for i in range(20)}
    assert {(r.source, r.sha256, r.chunks) for r in work.manifest.read().filter("source is not null").collect()} == {(f"f{i}", f"sha {i} {i in (3, 4)}", 1) for i in range(20)}
