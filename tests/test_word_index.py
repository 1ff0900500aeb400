"""The bucketed store and the word index: what is written, read and tokenised, two writers, runs that die."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import word_index as W
from lodestone.sources import buckets as B

KIND = "id long, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_changes_touch_their_buckets_only(spark, tmp_path):
    t = B.Buckets(spark, str(tmp_path / "t"), ["id"], KIND, 16)
    assert t.read().count() == 0 and t.version() == 0
    first = spark.range(2000).select("id", F.col("id").cast("string").alias("v"))
    assert t.write(first) == 1
    before = t.log.latest()[1]["folders"]
    change = spark.createDataFrame([(7, "x"), (5000, "new")], KIND)
    assert t.write(change, spark.createDataFrame([(9,)], "id long")) == 2
    after = t.log.latest()[1]["folders"]
    touched = {b for b in after if after[b] != before.get(b)}
    where = {str(r.b) for r in spark.createDataFrame([(7,), (9,), (5000,)], "id long").select(F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    assert touched == where and all(after[b] == before[b] for b in before if b not in touched)
    new = {f for b in touched for f in after[b]} - {f for b in before for f in before[b]}
    assert {d for f in new for d in os.listdir(tmp_path / "t" / os.path.dirname(f)) if d.startswith("__bucket")} == {f"__bucket={b}" for b in touched}
    want = {i: str(i) for i in range(2000) if i != 9} | {7: "x", 5000: "new"}
    assert dict(rows_of(t.read())) == want and t.read().count() == len(want)


def test_folders_are_joined_and_old_keys_stay_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "MOST_FOLDERS", 3)
    t = B.Buckets(spark, str(tmp_path / "t"), ["id"], KIND, 2)
    want = {}
    for k in range(6):
        new = {i: f"{k}" for i in range(k, 12, k + 1)}
        gone = {k + 3}
        t.write(spark.createDataFrame([(i, v) for i, v in new.items() if i not in gone], KIND), spark.createDataFrame([(i,) for i in gone], "id long"))
        want = {i: v for i, v in (want | new).items() if i not in gone}
        assert dict(rows_of(t.read())) == want
    assert all(len(f) <= 4 for f in t.log.latest()[1]["folders"].values())


def test_two_writers_lose_no_row(spark, tmp_path):
    """The second to finish finds its number taken: a change by key goes on top, one that rests on what was there fails."""
    t = B.Buckets(spark, str(tmp_path / "t"), ["id"], KIND, 4)
    t.write(spark.createDataFrame([(1, "a")], KIND))
    other = B.Buckets(spark, str(tmp_path / "t"), ["id"], KIND, 4)
    put, seen = t.log.put, []

    def late(version, entry):
        if not seen:
            seen.append(other.write(spark.createDataFrame([(2, "b"), (1, "other")], KIND)))
        return put(version, entry)

    t.log.put = late
    assert t.write(spark.createDataFrame([(3, "c"), (1, "mine")], KIND)) == 3 and seen == [2]
    assert rows_of(other.read()) == [(1, "mine"), (2, "b"), (3, "c")]
    seen.clear()
    with pytest.raises(B.Conflict):
        t.write(spark.createDataFrame([(4, "d")], KIND), upto=3)
    assert (4, "d") not in rows_of(t.read()) and (1, "other") in rows_of(t.read())


def test_a_file_is_put_once(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    assert B.put_if_absent(spark, path, "é") and not B.put_if_absent(spark, path, "b") and B.read_text(spark, path) == "é"
    assert os.listdir(tmp_path / "log") == ["1.json"]


def brute(queries, docs, k):
    words = {d: W_of(t) for d, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    out = {}
    for q, t in queries:
        scores = {}
        for d, ws in words.items():
            tf = Counter(ws)
            if hit := [w for w in W_of(t) if tf[w]]:
                scores[d] = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in hit)
        best = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:k]
        out |= {(q, d): (round(scores[d], 5), r + 1) for r, d in enumerate(best)}
    return out


def W_of(text):
    return (text or "").lower().split()


def test_index_follows_its_texts(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    texts = {i: " ".join(r.choices([f"w{k}" for k in range(60)], k=r.randint(0, 40))) for i in range(150)}
    asks = [(i, " ".join(r.choices([f"W{k}" for k in range(70)], k=r.randint(0, 9)))) for i in range(40)]
    q = spark.createDataFrame(asks, "query_id long, text string")
    index = W.WordIndex(spark, str(tmp_path / "ix"), buckets=8)
    said = []
    own = W.word_counts
    monkeypatch.setattr(W, "word_counts", lambda docs, *a: said.append(docs.count()) or own(docs, *a))

    def ask(mark):
        d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = index.refresh(d, mark).search(q, 5, fill=False, most_asked=50).collect()
        assert {(x.query, x.doc): (round(x.score, 5), x["rank"]) for x in got} == brute(asks, list(texts.items()), 5) and len(got) == len({(x.query, x.doc) for x in got})

    ask("a")
    ask("a")
    assert said == [150]
    texts |= {3: "w1 w1 w2", 500: "w3 w60"}
    del texts[4]
    ask("b")
    assert said == [150, 2]


def test_shared_words_rank_plainly(spark, tmp_path):
    d = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "beta alpha gamma"), (4, None)], "doc_id long, text string")
    words = W.WordIndex(spark, str(tmp_path / "ix"), plain=True).refresh(d, "x")
    got = words.search(spark.createDataFrame([(9, "alpha alpha beta")], "query_id long, text string"), 3, fill=False).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in got] == [(1, 2.0), (3, 2.0), (2, 1.0)]


def test_words_in_a_matrix_equal_words_by_postings(spark, monkeypatch):
    """Words that most queries and documents share, beside rare ones; small pieces; ties at the last place go to the least document."""
    from lodestone.operators import word_index as W

    docs = spark.createDataFrame([(i, " ".join(["the", "of"] * (1 + i % 3) + [f"w{i % 5}", f"r{i % 97}"])) for i in range(400)], "doc_id long, text string").repartition(3)
    asks = spark.createDataFrame([(i, f"the of w{i % 5} r{i}") for i in range(30)] + [(99, "r96")], "query_id long, text string")
    words = W.Words(W.word_counts(docs, "doc_id", "text"))

    def run(heavy, postings):
        monkeypatch.setattr(W, "HEAVY", heavy)
        monkeypatch.setattr(W, "MOST_POSTINGS", postings)
        return sorted((r.query, r.doc, round(r.score, 6), r["rank"]) for r in words.search(asks, 7, fill=False).collect())

    want = run(2.0, 2_000_000)
    assert len(want) == 30 * 7 + 4 and [d for q, d, _, _ in want if q == 99] == [96, 193, 290, 387]
    assert run(0.003, 2_000_000) == want and run(0.003, 500) == want


def test_what_is_known_of_the_best_leaves_no_document_out(spark, monkeypatch):
    """Documents and queries of three languages and short ones: the rows are those of plain scores, whatever documents are shown first, however
    they are put in groups, and with scores that differ by less than single precision can tell."""
    rnd = random.Random(5)
    said = lambda n: " ".join(rnd.choice("abc"[rnd.random() < 0.02 :][:1]) + str(int(rnd.paretovariate(0.6)) % 300) for _ in range(n))
    texts = [said(rnd.randint(1, 60)).replace("a", "xyz"[i % 3]) for i in range(900)]
    asks = [said(rnd.randint(1, 25)).replace("a", "xyz"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asks)), "query_id long, text string")
    counts = [Counter(t.split()) for t in texts]
    df, n, mean = Counter(w for c in counts for w in c), len(texts), sum(len(t.split()) for t in texts) / len(texts)
    raw = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = set()
    for i, ask in enumerate(asks):
        score = [sum(m * idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in Counter(ask.split()).items()) for c in counts]
        want |= {(i, d, k) for k, (_, d) in enumerate(sorted((-round(x, 6), d) for d, x in enumerate(score) if x > 0)[:7], 1)}
    words = W.Words(W.word_counts(docs, "doc_id", "text").cache())
    for shown, group, documents in ((8192, 512, 5000), (40, 512, 5000), (40, 5, 70), (150, 30, 100)):
        for name, value in (("SHOWN", shown), ("GROUP", group), ("DOCUMENTS", documents)):
            monkeypatch.setattr(W, name, value)
        assert {(r.query, r.doc, r["rank"]) for r in words.search(q, 7, fill=False).collect()} == want


def write_plans(spark, folder):
    """The plans that wrote into a folder."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [every.apply(i).physicalPlanDescription() for i in range(every.size())]
    return [p for p in plans if re.search(rf"Arguments: file:/*{re.escape(str(folder))}/", p)]


def test_the_first_index_is_written_where_words_are_counted(spark, tmp_path):
    """Words are neither shuffled nor sorted; small partitions share tasks, so that files are few; later changes and repeated ids as before."""
    name, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    texts = {i: f"w{i % 7} w{i % 11} w{i % 7}" for i in range(400)}
    frame = lambda: spark.createDataFrame([*texts.items(), (None, "w1")], "doc_id long, text string").repartition(40)
    asks = [(1, "w1 w3"), (2, "w6 w10 w9")]
    q = spark.createDataFrame(asks, "query_id long, text string")
    found = lambda words: {(x.query, x.doc): (round(x.score, 5), x["rank"]) for x in words.search(q, 5, fill=False).collect()}
    frame().write.parquet(str(tmp_path / "d"))
    stored = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "d"))
    index = W.WordIndex(spark, str(tmp_path / "ix"), buckets=8)
    assert found(index.refresh(stored, "a")) == brute(asks, list(texts.items()), 5)
    first = write_plans(spark, tmp_path / "ix/terms")
    assert len(first) == 1 and "Exchange" not in first[0] and "Sort" not in first[0]
    parts = [x for _, _, names in os.walk(tmp_path / "ix/terms/data") for x in names if x.endswith(".parquet")]
    assert len(parts) <= 8 * 2 * 4 and spark.conf.get(name) == before
    texts |= {3: "w1 w1 w3", 900: "w9"}
    del texts[5]
    assert found(index.refresh(frame(), "b")) == brute(asks, list(texts.items()), 5)
    assert index.table.read().count() == len(texts) and spark.conf.get(name) == before
    twice = W.WordIndex(spark, str(tmp_path / "twice"), buckets=8).refresh(frame().unionByName(frame()), "a")
    assert twice.terms.count() == len(texts) and found(twice) == brute(asks, list(texts.items()), 5)


def test_partitions_are_gathered_up_to_four(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = lambda n: W.gathered(spark.range(0, 1000, 1, n)).rdd.getNumPartitions()
    assert [rows(n) for n in (1, cores, 2 * cores, 3 * cores, 20 * cores)] == [1, cores, 2 * cores, 2 * cores, 5 * cores]


def test_settings_come_back_where_a_write_fails(spark, tmp_path):
    name, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    t = B.Buckets(spark, str(tmp_path / "t"), ["id"], KIND, 4)
    with pytest.raises(Exception, match="no such row"):
        t.write(spark.range(9).select("id", F.raise_error(F.lit("no such row")).cast("string").alias("v")), in_place=True)
    assert spark.conf.get(name) == before and t.version() == 0
    t.write(spark.range(900).select("id", F.lit("a").alias("v")), in_place=True)
    t.write(spark.range(900, 950).select("id", F.lit("b").alias("v")), spark.range(3).select("id"))
    assert rows_of(t.read()) == [(i, "a" if i < 900 else "b") for i in range(3, 950)]


def test_recommendations_shuffle_no_words_to_build_their_index(spark, tmp_path):
    from lodestone.plans import registry
    from lodestone.stored import shared_dir

    os.symlink("/root/testdata/sf0.001", sf := str(tmp_path / "sf"))
    rows = registry.QUERIES["recommendations"](spark, sf)
    where = f"{shared_dir(spark).rstrip('/').removeprefix('file://')}/words/{hashlib.sha256(sf.encode()).hexdigest()[:16]}-texts/terms"
    plans = write_plans(spark, where)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    # the one exchange deals the texts of a small table to all cores
    assert len(plans) == 1 and "rebalance" not in plans[0].lower() and "words" not in "".join(re.findall(r"\) Exchange\n.*?\n\n", plans[0], re.DOTALL))
    assert 0 < rows.count() <= asked


def test_a_changed_table_is_indexed_without_a_shuffle_of_words(spark, tmp_path):
    """Many changes: written anew in place, and read as it lies. Few: the buckets they fall into are one folder again, others stay."""
    texts = {i: f"w{i % 7} w{i % 11}" for i in range(400)}
    frame = lambda: spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(40)
    asks = [(1, "w1 w3"), (2, "w6 w10 w9")]
    q = spark.createDataFrame(asks, "query_id long, text string")
    found = lambda words: {(x.query, x.doc): (round(x.score, 5), x["rank"]) for x in words.search(q, 5, fill=False).collect()}
    index = W.WordIndex(spark, str(tmp_path / "ix"), buckets=8)
    folders = lambda: index.table.log.latest()[1]["folders"]
    index.refresh(frame(), "a")
    first = folders()
    # many: texts of a hundred ids are others, and 600 ids are new, 50 are gone
    texts = {i: f"w{i % 5} w{i % 13} w{i % 5}" if i < 150 or i >= 400 else t for i, t in ({**texts, **{i: "" for i in range(400, 1000)}}).items() if i >= 50}
    stored = len(write_plans(spark, tmp_path / "ix/terms"))
    words = index.refresh(frame(), "b")
    plans = write_plans(spark, tmp_path / "ix/terms")[stored:]
    assert len(plans) == 1 and "words" not in "".join(re.findall(r"\) Exchange\n.*?\n\n", plans[0], re.DOTALL)) and "Sort" not in plans[0]
    assert all(len(f) == 1 and f != first.get(b) for b, f in folders().items())
    assert "Exchange" not in words.terms._jdf.queryExecution().toString()
    assert found(words) == brute(asks, list(texts.items()), 5) and words.terms.count() == len(texts)
    # few
    before = folders()
    texts[60], texts[2000] = "w1 w1 w3", "w9"
    del texts[61]
    words = index.refresh(frame(), "c")
    changed = [b for b, f in folders().items() if f != before.get(b)]
    assert 0 < len(changed) <= 3 and all(len(f) == 1 for f in folders().values())
    assert "Exchange" not in words.terms._jdf.queryExecution().toString()
    assert found(words) == brute(asks, list(texts.items()), 5) and words.terms.count() == len(texts)
    assert index.table.notes() == {"fingerprint": "c"}
