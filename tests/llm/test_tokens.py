"""BPE automaton, packing and token files against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing, token_files
from lodestone.llm.common import fresh_dir
from lodestone.llm.library_tokens import library_tokens

WORD, BYTE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "\n \t", "hello world's don't 12 3.5 a_b __", "aaaa aaaaaaa bbbb", "日本語 é ÅΣΣ İstanbul \x1c ½²", "<|endoftext|>x <|startoftext|> <|end", "😀😀 𝔘ni", "zzzz----____===", "ﬁ ſ ǅ ª"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdehinorst  'éß.,0\n") for _ in range(r.randint(0, 200))) for _ in range(n)]


def test_automaton_equals_library():
    mine, lib = bpe.word_bpe(WORD), Tokenizer.from_file(WORD)
    texts = ODD + random_texts(300, 1)
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded, n = mine.encode_text(text)
        assert (ids, n) == (" ".join(map(str, e.ids)), len(e.ids))
        assert decoded == lib.decode(e.ids, skip_special_tokens=False)


def test_automaton_of_a_small_merge_list():
    """Against merging by hand: every string over two letters up to length nine."""
    import itertools

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ab"), ("b", "b")]
    vocab = {s: i for i, s in enumerate(["a", "b", *(x + y for x, y in merges)])}
    auto = bpe.Automaton(vocab, merges, None)
    for n in range(1, 10):
        for w in itertools.product("ab", repeat=n):
            parts = list(w)
            for x, y in merges:
                i, out = 0, []
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (x, y):
                        out.append(x + y)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert [auto.label[i] for i in auto.encode("".join(w))] == parts


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library_tokens_equal_library(path):
    lib, texts = Tokenizer.from_file(path), ODD + random_texts(300, 2)
    got = library_tokens(path).encode_many(texts)
    assert [x.tolist() for x in got] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_edges(spark, edge_docs, no_docs):
    out = bpe.encode(edge_docs, WORD)
    assert out.count() == 9 and out.filter("n_tokens = 0").count() == 3
    assert bpe.encode(no_docs, WORD).count() == 0


def check_packing(pieces, want, size):
    """want: list of id lists, one a row. Pieces of one document and text tile it; sequences are gapless."""
    seqs = {}
    total = 0
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and p.length > 0
        total += p.length
    assert total == sum(map(len, want))
    padding = 0
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert padding == 0


def test_packing(spark, edge_docs, no_docs):
    lib = Tokenizer.from_file(BYTE)
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    want = {t: lib.encode(t, add_special_tokens=False).ids + [1] for _, t in rows}
    pieces = packing.pack(edge_docs, BYTE, size=64, windows=2).collect()
    check_packing(pieces, [want[t] for _, t in rows], 64)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (doc, n), ps in by_doc.items():
        texts = [t for d, t in rows if d == doc and len(want[t]) == n]
        ids = {}
        for p in ps:
            ids.setdefault(p.start, struct.unpack(f"<{p.length}I", p.ids))
        if len(texts) == 1:
            at, got = 0, []
            while at in ids:
                got += ids[at]
                at += len(ids[at])
            assert got == want[texts[0]]
    assert packing.pack(no_docs, BYTE).count() == 0
    crc = packing.digested(packing.pack(edge_docs.filter("doc_id = 2"), BYTE)).first()
    assert crc.ids_crc32 == zlib.crc32(np.array([1], "<u4").tobytes())


def test_packer_fills_windows():
    p = packing.Packer(8, 2)
    for i, n in enumerate([3, 5, 7, 6, 2, 9, 1, 4]):
        p.add(i, np.arange(n))
    p.finish()
    used = {}
    for _, _, ids, _, seq, _ in p.take():
        used[seq] = used.get(seq, 0) + len(ids)
    assert sum(used.values()) == 37 and sorted(used.values()) == [1, 4, 8, 8, 8, 8]


def test_token_files(spark, edge_docs, no_docs):
    files = token_files.write(edge_docs, WORD, fresh_dir(spark, "t"))
    got = token_files.read(spark, files).orderBy("start").collect()
    lib, at = Tokenizer.from_file(WORD), 0
    want = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for (doc, text), r in zip(want, got, strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids)) and list(struct.unpack(f"<{len(ids)}I", r.ids)) == ids
        at += len(ids)
    empty = token_files.write(no_docs, WORD, fresh_dir(spark, "t"))
    assert empty.shards == [] and token_files.read(spark, empty).count() == 0


def test_digests_of_the_query(spark):
    from lodestone.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(WORD)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe_automaton"](spark, sf).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    at = 0
    for r in QUERIES["op8_token_files"](spark, sf).orderBy("doc_id").collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_one_number(spark):
    """5,000 rows under one doc_id, most of them with one text: dealt over tasks, whole, in order; nothing is left behind."""
    docs = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("text "), "id")).otherwise(F.lit("the same text")).alias("text"), F.lit("x").alias("head"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join these few rows again
    files = token_files.write(docs.unionByName(spark.createDataFrame([(1, "a", ""), (9, "b", "")], docs.schema)), WORD, fresh_dir(spark, "t"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read(spark, files).orderBy("start").collect()
    assert len(got) == 5002 and got[0].doc_id == 1 and got[-1].doc_id == 9 and max(s[3] for s in files.shards) < 2600
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    import os

    folder = files.where.removeprefix("file://")
    assert {x.split(".")[0] for x in os.listdir(folder)} == {s[1] for s in files.shards}
    files.delete()
    assert not os.path.exists(folder)


def test_other_split_rules_go_to_the_library(tmp_path):
    import json

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    lib, texts = Tokenizer.from_file(str(path)), ["a1b2 c3'll", *random_texts(50, 4)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in library_tokens(str(path)).encode_many(texts)] == want
    assert [bpe.word_bpe(str(path)).encode_text(t)[0] for t in texts] == [" ".join(map(str, w)) for w in want]
