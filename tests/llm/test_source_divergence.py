"""Source divergence against a plain computation and against its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import source_divergence as D


def brute(rows, least, top):
    words = [((g or ""), (s or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, g, s in rows]
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for g, s, w in words:
        groups[g].add(s)
        count[g, s].update(w)
        docs[g].update(set(w))
    out = set()
    for g, sources in groups.items():
        kept = [w for w, n in docs[g].items() if n >= least]
        v = len(kept)
        of = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * v) for w in kept}
        p, q = {s: of(count[g, s]) for s in sources}, of(sum((count[g, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            out |= {(g, s, "pair", o, -f, k + 1) for k, (f, _, o) in enumerate(pair)}
            term = sorted((-(p[s][w] - q[w]), w.encode(), w) for w in kept if count[g, s][w] and p[s][w] > q[w])[:top]
            out |= {(g, s, "term", w, -f, k + 1) for k, (f, _, w) in enumerate(term)}
    return out


def some_rows(n, seed):
    r = random.Random(seed)
    words = ["the", "The", "naïve", "İstanbul", "日本語", "a1b", "x_y", "😀", "straße", "ZEBRA"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 25))), r.choice(["en", "en", "en", "de", None]), r.choice(["s1", "s2", "s3", "", None, "é", "z"])) for _ in range(n)]
    return [*rows, (None, "xx", "silent"), ("", "xx", "other"), ("123 !!", "xx", None), ("one", "yy", "alone"), *[rows[0]] * 3]


@pytest.mark.parametrize("least, top", [(30, 50), (3, 4), (1000, 50)])
def test_audit_equals_brute_force(spark, least, top):
    rows = some_rows(300, 5)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = [tuple(r) for r in D.audit(docs, least=least, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least, top)


def test_sql_equals_brute_force(spark):
    import pandas as pd

    rows = some_rows(400, 6)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]))
    assert set(c.sql(D.SQL["op11_source_divergence"]).fetchall()) == brute(rows, 30, 50)


def test_counts_beyond_64_bits_stay_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_000, 80_000_000_000_001, 1_234_567
    row = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(terms).cast("long")).alias("p"))
    assert row.first().p == 1 + 10**9 * (n + 5) // (total + 5 * terms) and row.dtypes == [("p", "bigint")]


def test_no_rows_give_none(spark, no_docs, edge_docs):
    assert D.audit(no_docs).count() == 0
    assert D.audit(edge_docs).count() == 0  # one source, no term of thirty documents
