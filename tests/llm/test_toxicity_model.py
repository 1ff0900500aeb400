"""Toxicity's matching and counting by brute force, learning that does not hang on order, and hot or clashing rows."""

import math
import random
import time

import xxhash
from pyspark.sql import functions as F

from lodestone.llm import toxicity as X


def brute_hits(model, text):
    """start -> weight, by trying every entry and exception at every place."""
    t = X.fold(text)
    hits, spared = {}, []
    for r in X.readings(t):
        for at in range(len(r)):
            for p in model.exceptions:
                if r.startswith(p, at):
                    spared.append((at, at + len(p) - 1))
            for p, w in model.entries.items():
                whole = p.endswith(" ")
                if r.startswith(p, at) and (whole or r[at + len(p)] != " "):
                    hits[at] = max(w, hits.get(at, 0.0))
    return {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}, len(t.split())


def test_matching_equals_brute_force():
    r = random.Random(5)
    model = X.Model({" bad ": 3.0, " bade": 2.0, " badly ": 5.0, " réu": 1.5, " reu": 1.0, " so ": 0.5}, [" bad luck ", " so so ", " not bad "])
    words = ["bad", "badly", "bädly", "bade", "badest", "luck", "not", "so", "réunion", "reunion", "b4d", "вad", "ｂａｄ", "b​ad", "b́ad", "x"]
    scan = model.matcher()
    for _ in range(500):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        weight, n, hits, _ = scan(text)
        want, words_seen = brute_hits(model, text)
        assert dict(hits) == want and math.isclose(weight, sum(want.values())) and n == words_seen


def test_folding_of_scripts_and_forms():
    assert X.fold("ＩＤＩＯＴ 𝐢𝐝𝐢𝐨𝐭 i​d­iot íd̀iot мoron ΤRΑSH ﬁ") == " idiot idiot idiot ídiot moron trash fi "
    assert X.readings(X.fold("élan"))[1] == " elan "


def test_many_hits_and_exceptions_in_one_text():
    """Hits and phrases are swept once: 60,000 of each would take hours if each were held against each."""
    scan = X.Model({" idiot ": 5.0}, [" idiot proof "]).matcher()
    began = time.perf_counter()
    assert scan("idiot proof idiot " * 60_000)[0] == 5.0 * 60_000
    assert time.perf_counter() - began < 20


def labelled(spark, n=400):
    r = random.Random(3)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[r.randrange(40)] = "vile"
        elif i % 7 == 0:
            words[5:7] = ["vile", "weather"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")


def test_counts_and_curve_equal_brute_force(spark):
    docs, labels = labelled(spark)
    model = X.learn(docs, labels)
    rows = {r.doc_id: (r.text, r.toxic) for r in docs.join(labels, "doc_id").collect()}
    held = {r.doc_id for r in docs.filter(X.held_out()).collect()}
    copies = {}  # near copies count once: the least doc_id of a label and the three least word hashes
    for d in sorted(rows.keys() - held):
        text, t = rows[d]
        copies.setdefault((t, *sorted({xxhash.xxh64_intdigest(w) for w in X.fold(text).split()})[:3]), (text, t))
    train = list(copies.values())
    n = {t: sum(x == t for _, x in train) for t in (0, 1)}
    seen = {t: {} for t in (0, 1)}
    for text, t in train:
        for term in X._terms(text):
            seen[t][term] = seen[t].get(term, 0) + 1
    want = {}
    for term, k in seen[1].items():
        c = seen[0].get(term, 0)
        low, high = max(k - 1.28 * math.sqrt(k), 0) / n[1], (c + 1.28 * math.sqrt(c) + 1) / n[0]
        if k >= max(X.LEAST_SEEN, X.LEAST_SHARE * n[1]) and low / high >= X.LEAST_RATIO:
            want[term] = min(math.log(low / high), 6.0)
    assert model.entries.keys() == want.keys() and all(math.isclose(model.entries[k], want[k]) for k in want)
    assert " vile " in want and model.exceptions == [" vile weather "]


def test_learning_does_not_hang_on_order_or_on_repeated_numbers(spark):
    docs, labels = labelled(spark)
    hot = spark.range(2000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("other words of one number "), "id").alias("text"))
    docs = docs.unionByName(hot)
    assert X.sample(docs, labels).groupBy("doc_id").count().filter("count > 1").isEmpty() and X.sample(docs, labels, 10).count() == 10
    a, b = (X.learn(docs.repartition(k).sortWithinPartitions(F.rand(k)), labels.union(labels)) for k in (2, 7))
    assert a.entries == b.entries and a.exceptions == b.exceptions and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a.curve, b.curve, strict=True))


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([(1, "vile", "mine", 7)], "doc_id long, text string, Score string, `a.b` int")
    got = X.score(df, X.Model({" vile ": 6.0}), prefix="__t_").first().asDict()
    assert (got["Score"], got["a.b"], got["__t_hits"]) == ("mine", 7, 1)
    assert X.score(df, X.Model()).columns == ["doc_id", "text", "a.b", "score", "predicted", "hits", "weight"]
