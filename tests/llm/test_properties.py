"""Property tests of the pieces that need no session."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard_join, media, packing, quality


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(3, 6), st.integers(1, 5))
def test_packing_tiles_every_document(lengths, power, windows):
    size = 2**power
    p = packing.Packer(size, windows)
    most = 0
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n))
        most = max(most, len(p.open))
    p.finish()
    docs, seqs = {}, {}
    for doc, start, ids, total, seq, offset in p.take():
        docs.setdefault(doc, []).append((start, ids.tolist(), total))
        seqs.setdefault(seq, []).append((offset, len(ids)))
    assert most <= windows and set(docs) == set(range(len(lengths)))
    for doc, pieces in docs.items():
        assert [x for _, ids, _ in sorted(pieces) for x in ids] == list(range(lengths[doc])) and {t for *_, t in pieces} == {lengths[doc]}
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0
    assert sum(sum(n for _, n in s) != size for s in seqs.values()) <= power


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=4000))
def test_png_holds_any_payload(raw):
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é", max_size=120))
def test_repeats_need_a_repeat(text):
    m = quality.measure(text)
    words = text.encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    assert (m["n_repeat_words"] > 0) == (len(set(windows)) < len(windows)) and 0 <= m["coverage_5"] <= 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=40), min_size=1, max_size=12))
def test_links_equal_brute_force(lists):
    sets = [np.unique(np.array(x, np.uint64)) for x in lists]
    k = len(sets)
    texts, docs, root = jaccard_join.count_links(sets, np.arange(1, k + 1), np.zeros(k, int), 0, 0)
    near = [[i != j and 5 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 4 * len({*sets[i].tolist()} | {*sets[j].tolist()}) for j in range(k)] for i in range(k)]
    assert texts.tolist() == [sum(r) for r in near] and docs.tolist() == [sum(j + 1 for j in range(k) if r[j]) for r in near]
    for i in range(k):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [j for j in range(k) if near[x][j]]
        assert root[i] == min(seen)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 8), min_size=1), st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=14))
def test_links_of_groups_of_near_copies(rows):
    """Sets with elements of their own, so that several have the same shared ones; in one block, and across two."""
    sets = [np.unique(np.array([*s, *range(100 * (i + 1), 100 * (i + 1) + own)], np.uint64)) for i, (s, own, _) in enumerate(rows)]
    block, k = np.array([x for _, _, x in rows]), len(rows)
    sets = [np.unique(np.append(s, np.uint64(9000 + i))) if any(np.array_equal(s, o) for o in sets[:i]) else s for i, s in enumerate(sets)]
    for across in (False, True):
        texts, docs, root = jaccard_join.count_links(sets, np.arange(1, k + 1), block, 0, int(across))
        near = [[i != j and (not across or block[i] != block[j]) and 5 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 4 * len({*sets[i].tolist()} | {*sets[j].tolist()}) for j in range(k)] for i in range(k)]
        assert texts.tolist() == [sum(r) for r in near] and docs.tolist() == [sum(j + 1 for j in range(k) if r[j]) for r in near]
        for i in range(k):
            seen, todo = set(), [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [j for j in range(k) if near[x][j]]
            assert root[i] == min(seen)


def test_near_copies_cost_about_their_number():
    """Copies with one word changed, 20,000 and 40,000 of them: counts right, and twice as many take about twice as long."""
    import random
    import time

    took = []
    for n in (20_000, 40_000):
        r, texts = random.Random(1), set()
        while len(texts) < n:
            w = [f"b{i}" for i in range(68)]
            w[r.randrange(68)] = f"n{r.randrange(10**9)}"
            texts.add(" ".join(w))
        sets = [jaccard_join.shingles(t) for t in sorted(texts)]
        began = time.process_time()
        links, _, root = jaccard_join.count_links(sets, np.ones(n, np.int64), np.zeros(n, np.int64), 0, 0)
        took.append(time.process_time() - began)
        for i in (0, n // 2, n - 1):
            both = np.array([len(np.intersect1d(sets[i], x, True)) for x in sets])
            size = np.array([len(x) for x in sets])
            assert links[i] == (5 * both >= 4 * (size + len(sets[i]) - both)).sum() - 1
        assert len(set(root.tolist())) == 1
    assert took[1] < 4 * took[0] + 1


def test_forest_spans_what_survives():
    g = np.random.default_rng(4)
    for n in (1, 2, 60, 300):
        base = g.integers(0, 256, (5, 96))
        marks = base[g.integers(0, 5, n)]
        noise = g.random((n, 96)) < g.choice([0.05, 0.2, 0.5], (n, 1))
        marks[noise] = g.integers(0, 256, int(noise.sum()))
        marks = marks.astype(np.uint8)
        # pair by pair
        least = dict(jaccard_join._LEAST)
        stays = [[i != j and all((marks[i, :m] == marks[j, :m]).sum() >= at for m, at in least.items()) for j in range(n)] for i in range(n)]

        def components(near):
            out = list(range(n))
            for i in range(n):
                todo, seen = [i], set()
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        todo += near[x]
                out[i] = min(seen)
            return out

        edges = jaccard_join.forest(marks)
        both = [[] for _ in range(n)]
        for x, y in edges:
            both[x].append(y)
            both[y].append(x)
        assert components(both) == components([[j for j in range(n) if stays[i][j]] for i in range(n)])
