"""The prefix trie against a plain walk."""

import hashlib
import random
import zlib

import pytest

from lodestone.llm import prefix_trie as P


def brute(rows):
    """rows: (conv_id, turn, role, text), turns of a conversation distinct. Gives a row a node as the query does."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], set()).add(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = set()
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in who if paths[c] == p))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks(n, seed, most=10):
    r = random.Random(seed)
    starts = [("user", "hello"), ("user", "héllo 😀"), ("system", None), (None, "")]
    rows = []
    for c in r.sample(range(3 * n), n):
        for t in range(r.randint(1, most)):
            role, text = r.choice(starts)
            rows.append((c, None if t == 0 and r.random() < 0.2 else t, role, text))
    return rows


KIND = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("seed, chunk", [(1, 10), (2, 1 << 18)])
def test_trie_equals_a_walk(spark, seed, chunk):
    rows = [*talks(80, seed), (None, 0, "user", "nobody's")] + [(c, 0, "user", "hello") for c in range(1000, 1200)]
    df = spark.createDataFrame([(*r, b"x", 3) for r in rows], KIND + ", digest binary, pos int").repartition(3)
    got = [tuple(r)[:8] for r in P.trie(P.rebuilt(P.numbered_turns(df)), chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_long_conversation_and_turnless_ones(spark):
    """Five thousand turns are a chain of as many nodes; conversations whose own turns are replaced by none end at the root."""
    rows = [(0, t, "user", str(t % 3)) for t in range(5000)] + [(c, 0, "user", "x") for c in range(8000, 8040) if c % 5]
    got = {(r.conv_id, r.depth): r for r in P.trie(P.rebuilt(P.numbered_turns(spark.createDataFrame(rows, KIND)))).collect()}
    assert got[0, 5000].n_children == 0 and got[0, 1].n_leaves == 1 and len([k for k in got if k[0] == 0]) == 5001
    root = got[0, 0]
    empty = sorted(c for c in range(8000, 8040) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert root.ends_sha256 == hashlib.sha256(",".join(map(str, empty)).encode()).hexdigest() and root.n_convs == 33


def test_ties_repeats_and_no_rows(spark):
    rows = [(5, 0, "user", "b"), (5, 0, "user", "a"), (5, 0, "assistant", "z"), (5, 0, "user", "a")]
    a = P.trie(P.rebuilt(P.numbered_turns(spark.createDataFrame(rows, KIND)))).collect()
    b = P.trie(P.rebuilt(P.numbered_turns(spark.createDataFrame(rows[::-1], KIND).repartition(4)))).collect()
    assert sorted(a) == sorted(b) and len(a) == 5
    none = P.trie(P.rebuilt(P.numbered_turns(spark.createDataFrame([], KIND))))
    assert none.count() == 0 and none.dtypes[0] == ("conv_id", "bigint")
