"""The similarity join, components and the pipeline against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join as J
from lodestone.llm.components import connected_components


def sets_of(text):
    w = re.findall(r"\w+", text.lower())
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """rows: (key, text). Gives key -> (least key of its class, number of links)."""
    s = {k: sets_of(t) for k, t in rows}
    t = dict(rows)
    links = defaultdict(set)
    for a in s:
        for b in s:
            if a < b and (len(s[a] & s[b]) * 5 >= len(s[a] | s[b]) * 4 if s[a] and s[b] else not s[a] and not s[b] and t[a] == t[b]):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for k in sorted(s):
        if k not in root:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = k
                    todo += links[x]
    return {k: (root[k], len(links[k])) for k in s}


def near_copies(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n // 6):
        base = [r.choice(words) for _ in range(r.randint(3, 90))]
        out.append(base)
        for _ in range(5):
            c = list(r.choice(out[-5:]))
            for _ in range(r.randint(0, 2)):
                c[r.randrange(len(c))] = r.choice(words)
            out.append(c)
    return [(i, " ".join(c)) for i, c in enumerate(out)]


@pytest.mark.parametrize("limits", [(J.BUCKET_LIMIT, J.FAMILY_LIMIT), (4, 3)])
def test_join_equals_brute_force(spark, limits):
    rows = near_copies(240, 5) + [(9000, "..."), (9001, "..."), (9002, "!!"), (9003, ""), (9004, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.similarity_classes(docs, bucket_limit=limits[0], family_limit=limits[1]).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [None, 0])
def test_hot_numbers_and_texts(spark, monkeypatch, most):
    """5,000 rows under one doc_id (2,500 texts, copies and near copies), with a Bloom filter and without: as brute force has it, no
    row too many, and what is shuffled is less than the texts."""
    if most is not None:
        monkeypatch.setattr(J.bloom, "MOST_BROADCAST", most)
    filler = lambda i: " ".join(f"u{i}x{k}" for k in range(12))
    rows = [(7, filler(i)) for i in range(2400)] + near_copies(100, 8)[:100] + [(8, "one text under one number many times over")] * 2500
    rows = [(7 if i < 2500 else d, t) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("mine")).repartition(4)
    got = J.similarity_classes(docs).collect()
    texts = sorted({t for _, t in rows})
    want = brute(list(enumerate(texts)))
    groups = defaultdict(set)
    for i, t in enumerate(texts):
        groups[want[i][0]].add(t)
    assert len(got) == len(rows) and len({r.class_key for r in got}) == len(groups)
    size = defaultdict(int)
    for _, t in rows:
        size[t] += 1
    assert {r.n_links for r in got if r.doc_id == 8} == {2499}
    kept = J.one_of_each_class(docs).collect()
    assert len(kept) == len(groups) and {r.node for r in kept} == {"mine"}
    for g in groups.values():
        assert sum(r.text in g for r in kept) == 1


def test_blocks_by_bytes(spark, monkeypatch):
    """Families whose shingles exceed a block's bytes are dealt out, with the same result."""
    monkeypatch.setattr(J, "BLOCK_BYTES", 2000)
    rows = near_copies(240, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.similarity_classes(docs).collect()} == brute(rows)


def test_recall_at_the_threshold(spark):
    """1,500 texts, each with a partner whose similarity is 0.8 or a little more: every link is found."""
    r = random.Random(12)
    rows, linked = [], 0
    for i in range(1500):
        a = [f"v{r.randrange(5000)}" for _ in range(r.randint(40, 120))]
        b = list(a)
        while True:
            c = list(b)
            c[r.randrange(len(c))] = f"z{r.randrange(5000)}"
            x, y = sets_of(" ".join(a)), sets_of(" ".join(c))
            if 5 * len(x & y) < 4 * len(x | y):
                break
            b = c
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        linked += a != b
    got = {x.doc_id: x for x in J.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert linked > 1300 and all(got[2 * i].class_id == got[2 * i + 1].class_id == 2 * i and got[2 * i].n_links == 1 for i in range(1500))


def test_least_matches():
    assert J.least_matches(96) < 70 and J.least_matches(16) <= J.least_matches(32) <= J.least_matches(96)


def test_join_edges(spark, edge_docs, no_docs):
    got = J.similarity_classes(edge_docs).collect()
    assert len(got) == 9
    same = [r for r in got if r.doc_id == 5]
    assert [(r.class_id, r.n_copies, r.n_links) for r in same] == [(5, 2, 1)] * 2
    empty = {r.class_id for r in got if r.doc_id in (1, 2)}
    assert empty == {1}
    assert J.similarity_classes(no_docs).count() == 0
    kept = J.one_of_each_class(edge_docs)
    assert kept.columns == edge_docs.columns and kept.filter("doc_id = 5").count() == 1 and kept.count() == 7


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(30)] + [(7, 7)]
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for k in near:
        seen, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert got[k] == min(seen)
    assert set(got) == set(near)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_equals_stage_by_stage_brute_force(spark):
    import corpus_pipeline as P
    from lodestone.llm import quality, secrets

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(after["quality"]) == {d for d, t in after["toxicity"].items() if (m := quality.measure(t)) and m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] and m["line_coverage"] <= quality.LINE_LIMIT and m["n_symbols"] <= quality.SYMBOL_LIMIT * m["n_words"] and all(m[f"coverage_{n}"] <= x for n, x in quality.NGRAM_LIMITS.items())}
    assert set(after["near_duplicates"]) == {v[0] for v in brute(list(after["quality"].items())).values()}
    for d, t in after["secrets"].items():
        left = [m for p, g, n in secrets.BASE.values() for m in re.finditer(p, t) if len(m.group(g)) >= n]
        assert not left and ("[SECRET]" in t or t == after["near_duplicates"][d])
    packed = P.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == len(after["secrets"])
    got = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t"))
    assert got.filter("n <> t").count() == 0


def test_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    """Nulls, empties, ties, repeated rows and clashing columns: which rows stay, and that the caller's columns do."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(5, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    names = ["n_words", "base_failed", "predicted", "hits", "weight", "a.b", "base_spans", "listed"]
    docs = edge_docs.select("*", *(F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(n) for n in names))
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    left = {"toxicity": 9, "quality": 0, "near_duplicates": 7, "secrets": 9}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert len(got) == left[name] if name != "quality" else all(len((r.text or "").split()) >= 10 for r in got)
        for r in got:
            x = r.asDict()
            assert (x["score"], x["kept"], x["ids"], x["node"], x["all_spans"]) == (1.0, "y", "z", "x", "w")
            assert all(x[n] == f"{n} of {'?' if r.doc_id is None else r.doc_id}" for n in names)
            assert (r.doc_id, r.text) in rows or name == "secrets" and "[SECRET]" in r.text and r.n_chars == len(r.text)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 7
    assert P.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
