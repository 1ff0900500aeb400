"""Secret scans of texts with many spans, the models' spans by brute force, and samples where one number or text is hot."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import secrets as S

N = len(S.ALPHABET) + 1


def brute_all(text, ratios):
    """(kind, start, end) of base and model spans, by testing everything against everything."""
    base = [(m.start(), i, m.end(), k) for i, (k, (p, g, n)) in enumerate(S.BASE.items()) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    out = list(base)
    for m in re.finditer(S.MODEL_PATTERN, text):
        codes = [S.ALPHABET.index(c) + 1 for c in m[0]]
        total = sum(float(f"{ratios[a * N + b]:.5f}") for a, b in zip([0, *codes], codes, strict=False))
        if total >= S.LEAST_TOTAL and total >= S.LEAST_MEAN * len(m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), len(S.BASE), m.end(), "model"))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def brute_redact(text, spans):
    out, at = "", 0
    for _, a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_all_spans_and_redaction_equal_brute_force(spark):
    r = random.Random(11)
    ratios = S.train(S.labelled_samples(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    key = lambda n: "".join(r.choice(S.ALPHABET[:62]) for _ in range(n))
    bits = [lambda: "password=" + key(r.randint(3, 9)), lambda: "AKIA" + key(18).upper(), lambda: key(26), lambda: "".join(r.choice("0123456789abcdef") for _ in range(30)), lambda: "é日本 ", lambda: " ", lambda: "a_plain_identifier_of_some_length", lambda: "secret: token:" + key(20), lambda: "=" * 17]
    texts = ["".join(r.choice(bits)() + r.choice(["", " ", "\n", "é"]) for _ in range(r.randint(0, 25))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base_spans", F.lit("mine"))
    got = S.scan(docs, ratios, prefix="__").withColumn("x", S.redact(F.col("text"), F.col("__all_spans"))).collect()
    assert len(got) == 400
    for g in got:
        want = brute_all(texts[g.doc_id], ratios)
        assert [(s.kind, s.start, s.end) for s in g["__all_spans"]] == want and g.x == brute_redact(texts[g.doc_id], want) and g.base_spans == "mine"


def test_a_text_of_many_spans(spark):
    """200,000 spans in a text, and masked: hours, if the work grew with their square."""
    n = 200_000
    df = spark.range(1).select(F.repeat(F.lit("é api_key=abcdef12 " + "Zz9" * 8 + " "), F.lit(n // 2)).alias("text"))
    got = S.scan(df, [1.0] * (N * N)).select(F.size("base_spans"), F.size("all_spans"), F.sha2(S.redact(F.col("text"), F.col("all_spans")), 256)).first()
    assert tuple(got) == (n // 2, n, hashlib.sha256(("é [SECRET] [SECRET] " * (n // 2)).encode()).hexdigest())


@pytest.mark.parametrize("copies", [1, 3000])
def test_the_sample_is_of_distinct_texts(spark, copies):
    """One text of one number 3,000 times, and one number with 3,000 texts: the sample is the same whatever the order, and distinct."""
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.range(copies).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same words").alias("text")))
    got = [sorted((r.doc_id, r.text) for r in S._distinct_sample(docs.repartition(k), 50).collect()) for k in (2, 5)]
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) == 50
