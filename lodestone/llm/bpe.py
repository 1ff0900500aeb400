"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. It begins with one state that
every base symbol loops on. The gadget of a merge (u, v) -> uv takes the state s that u leads to; where v leaves s,
s is copied for u without its v arc (nor its uv arc, where u = v), u is redirected to the copy, and uv gets an arc
beside every u arc, to where v led. All arcs with one label lead to one state, so the automaton is kept as: the
state of each label, and for each copied state its parent, its time and the arcs it lacks. A sequence of tokens is
accepted just if it is what BPE makes of its text; each text has one accepted path.

Encoding a pre-split word finds that path from left to right: at each position the one label that ends there and
whose arc leaves the state reached before it (transitions are kept in a table once looked up). Decoding emits the
labels of the arcs.

Edge cases: a null text is empty: no ids, an empty decoded text. Empty tables give no rows. Repeated rows and ties of
doc_id are encoded each. Very long texts are encoded whole; the table of words is emptied when it is full, so memory is
bounded. Only doc_id and text are read, so other columns cannot clash. A tokenizer file whose pre-split is not the one
known here is split by the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UNSAFE, WORD_SPLIT, ids_and_text, map_batches, rule_of, table, texts_of

WORDS_KEPT, ARCS_KEPT, PREFIXES_KEPT = 200_000, 1_000_000, 60_000
#: Lengths of the word beginnings whose positions are kept.
PREFIXES = (3, 6)


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


class Automaton:
    """Deterministic automaton of a merge list; labels are token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str | None):
        self.label = {i: s for s, i in vocab.items()}
        self.suffix = suffix or ""
        made: dict[int, tuple[int, int, int]] = {}
        self.parts = made  # token -> (time, left, right); base symbols are not in it
        self.target: dict[int, int] = {}  # label -> state, 0 where it is not there
        self.parent, self.born, self.lacks = [0], [0], [(-1, -1)]
        self.table: dict[int, bool] = {}  # state << 20 | label -> whether the arc is there
        self.prefixes: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.lacked: dict[int, dict[int, int]] = {}  # state -> label -> time of the gadget that took its arc
        cut = len(self.suffix)
        tail = lambda b: b[:-cut] if cut and b.endswith(self.suffix) else b
        for time, (a, b) in enumerate(merges, 1):
            u, v, uv = vocab[a], vocab[b], vocab[a + b]
            s = self.target.get(u, 0)
            if uv in made or not self._leaves(s, v):
                continue
            made[uv] = (time, u, v)
            self.target[uv] = self.target.get(v, 0)
            self.parent.append(s)
            self.born.append(time)
            self.lacks.append((v, uv if u == v else -1))
            self.target[u] = len(self.parent) - 1
        # every label by its text; symbols that end a word carry the suffix, so the two kinds cannot meet
        self.ids = {s: i for s, i in vocab.items() if i in made or len(tail(s)) == 1}
        # by the last three symbols: the longest label that ends so (a bound on where an arc can begin)
        self.reach: dict[str, int] = {}
        for x in self.ids:
            key, n = (tail(x)[-3:], x != tail(x)), len(tail(x))
            key = key[0] + self.suffix if key[1] else key[0]
            self.reach[key] = max(n, self.reach.get(key, 0))

    def _leaves(self, state: int, label: int) -> bool:
        """Whether `label` leaves `state`. A state lacks what its gadgets took; a merged label leaves where its left part
        did at the time of the merge."""
        while True:
            part = self.parts.get(label)
            time = part[0] if part else 0
            while self.born[state] > time:
                if label in self.lacks[state]:
                    return False
                state = self.parent[state]
            if part is None:
                return True
            if label in self.lacks[state]:
                return False
            label = part[1]

    def leaves(self, state: int, label: int) -> bool:
        """As _leaves, once all merges are compiled: all that a state and its ancestors lack is gathered on first use."""
        lacked = self.lacked.get(state)
        if lacked is None:
            lacked, s = {}, state
            while s:
                lacked.update(dict.fromkeys(self.lacks[s], self.born[s]))
                s = self.parent[s]
            self.lacked[state] = lacked
        bound = len(self.parent)
        while True:
            if lacked.get(label, bound + 1) <= bound:
                return False
            part = self.parts.get(label)
            if part is None:
                return True
            bound, label = part[0], part[1]

    def _advance(self, word: str, first: int, n: int, closed: bool, state: list[int], last: list[int], start: list[int]) -> None:
        """Fills state, last and start of the positions from `first` to n; the symbol at n ends the word if it is closed."""
        ids, target, table, reach, suffix = self.ids, self.target, self.table, self.reach, self.suffix
        for end in range(first, n + 1):
            tail = suffix if closed and end == n else ""
            most = reach.get(word[end - 3 if end > 3 else 0 : end] + tail, 2)
            for at in range(end - most if end > most else 0, end):
                label = ids.get(word[at:end] + tail)
                if label is not None:
                    key = state[at] << 20 | label
                    ok = table.get(key)
                    if ok is None:
                        ok = table[key] = self.leaves(state[at], label)
                    if ok:
                        state[end], last[end], start[end] = target.get(label, 0), label, at
                        break
            else:
                raise ValueError(f"no path for {word!r}")

    def _prefix(self, word: str, k: int) -> tuple[list[int], list[int], list[int]]:
        """The positions of word[:PREFIXES[k]], as they are in every longer word; kept, as many words begin alike."""
        n = PREFIXES[k]
        head = word[:n]
        got = self.prefixes.get(head)
        if got is None:
            before, done = PREFIXES[k - 1] if k else 0, ([0], [0], [0])
            if k:
                done = self._prefix(word, k - 1)
            more = [0] * (n - before)
            got = tuple(x + more for x in done)
            self._advance(head, before + 1, n, False, *got)
            if len(self.prefixes) >= PREFIXES_KEPT:
                self.prefixes.clear()
            self.prefixes[head] = got
        return got

    def encode(self, word: str) -> list[int]:
        """The ids of a word in byte letters."""
        n = len(word)
        if not n:
            return []
        whole = self.ids.get(word + self.suffix)
        if whole is not None:  # every label leaves the first state
            return [whole]
        k = 1 if n > PREFIXES[1] else 0 if n > PREFIXES[0] else -1
        before = PREFIXES[k] if k >= 0 else 0
        more = [0] * (n - before)
        state, last, start = (x + more for x in (self._prefix(word, k) if k >= 0 else ([0], [0], [0])))
        self._advance(word, before + 1, n, True, state, last, start)
        out, end = [], n
        while end:
            out.append(last[end])
            end = start[end]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels, joined by spaces, as the library joins them where a file names no decoder."""
        return " ".join([self.label[i] for i in ids])


class WordBpe:
    """A tokenizers file of the kind: normalise, pre-split, byte letters, BPE with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path = path
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton.label.update({i: s for s, i in self.special.items()})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self)
        self.before: dict[str, tuple[str, str]] = {}
        self.known = rule_of(spec) == "words"
        self._library = None

    def split(self, text: str) -> list[str]:
        """Pre-split words in byte letters (other texts than plain Latin ones by the library's own rules)."""
        if self.known and not UNSAFE.search(text):
            return WORD_SPLIT.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        normalizer = self._library.normalizer
        got = self._library.pre_tokenizer.pre_tokenize_str(normalizer.normalize_str(text) if normalizer else text)
        return [bytes(_LETTER_BYTES[c] for c in w).decode("utf-8") for w, _ in got]

    def word(self, w: str) -> tuple[str, str]:
        if len(self.words) >= WORDS_KEPT:  # two generations: words of the older one come back as they are met
            self.before = dict(self.words)
            self.words.clear()
        if len(self.automaton.table) >= ARCS_KEPT:
            self.automaton.table.clear()
            self.automaton.lacked.clear()
        out = self.before.get(w)
        if out is None:
            ids = self.automaton.encode(w.encode("utf-8").decode("latin-1").translate(LETTERS))
            out = (" ".join(map(str, ids)), self.automaton.decode(ids))
        self.words[w] = out
        return out

    def encode_text(self, text: str) -> tuple[str, str, int]:
        """(ids in decimal, decoded text, number of ids), the first two joined by spaces."""
        found: list[tuple[str, str]] = []
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                found.append((str(self.special[part]), part))
            else:
                found += map(self.words.__getitem__, self.split(part))
        if not found:
            return "", "", 0
        ids, labels = zip(*found, strict=True)
        said = " ".join(ids)
        return said, " ".join(labels), said.count(" ") + 1


class Words(dict):
    """word -> (ids in decimal, labels), each joined by spaces; a word that is not there is encoded by `bpe`."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, w: str) -> tuple[str, str]:
        return self.bpe.word(w)


_LETTER_BYTES = {c: b for b, c in LETTERS.items()}


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One automaton a worker process."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by spaces), decoded, n_tokens."""

    def make():
        bpe = word_bpe(path)

        def f(b: pa.RecordBatch) -> dict:
            rows = [bpe.encode_text(x) for x in texts_of(b)]
            return {"doc_id": b.column("doc_id"), "ids": [r[0] for r in rows], "decoded": [r[1] for r in rows], "n_tokens": [r[2] for r in rows]}

        return f

    return map_batches(ids_and_text(docs), make, "doc_id long, ids string, decoded string, n_tokens long", 128)


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_automaton": op5_bpe_automaton}
