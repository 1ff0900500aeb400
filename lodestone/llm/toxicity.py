"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding homoglyphs and digit substitutions.

Folding lower-cases a text, undoes Unicode's compatibility forms (full-width letters, ligatures, styled letters), drops
stray accents and invisible characters, maps look-alike letters and digits to plain ones, and leaves only letter runs
between single spaces. Letters that have an accent of their own are read twice, with it and without. Lexicon entries are whole words (` word `) or beginnings of longer words (` begi`); where several fit one
word, the heaviest counts. Entries inside an exception phrase do not count. The sum of the weights, as it is and relative
to the length in words, goes through a logistic curve to a score from 0 to 1.

Everything is learned from labelled rows: those of at most MAX_SAMPLE doc_ids, chosen by a hash of doc_id, one text
each (the one with the least hash); near copies among them count once, the one of the least doc_id. What is learned is
the same in every run. Entry weights are log rate ratios with cautious bounds; exceptions are two-word phrases with an
entry that clean rows use and toxic ones do not. Neither list is cut: an entry needs LEAST_SHARE of the toxic rows, so
there are at most 1 / LEAST_SHARE times as many as a toxic row has terms on average; an exception needs LEAST_SEEN rows.

Edge cases: a null text is empty and scores as the curve does at zero; rows with a null label or doc_id are not learned
from. Without toxic or clean samples the score is a constant. Empty tables give no rows. Repeated rows, and rows under
one doc_id with the same text, score alike. Texts are scanned whole, whatever their length, in time linear in it and its
hits. score, predicted, hits and weight (after `prefix`) replace columns of docs of these names; all others stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, durable, ids_and_text, table, texts_of

#: Bound of what is learned from: labelled documents read.
MAX_SAMPLE = 20_000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(4, 9)
LEAST_RATIO, LEAST_SEEN, LEAST_SHARE = 4.0, 3, 0.015
THRESHOLD = 0.7

#: Look-alikes of Latin letters and digits used for letters, by script; forms that compatibility folding undoes are not here.
CYRILLIC = dict(zip("авекмнорстухіјѕԁԛԝһгпшьё", "abekmhopctyxijsdqwhrnwbe", strict=True))
GREEK = dict(zip("αβεικνορτυχωηγσ", "abeikvoptuxwnys", strict=True))
OTHER = dict(zip("ıɑɡɩʟɴʀօսոհցɪʏ", "iagilnrounhgiy", strict=True))
HOMOGLYPHS = CYRILLIC | GREEK | OTHER
DIGITS = dict(zip("0134578@$!|", "oieastbasil", strict=True))
_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS})
_INSIDE = re.compile(r"[^\W\d_]+")
#: Accents, and characters that are not seen: soft hyphens, joiners, marks of direction, variation selectors.
_UNSEEN = re.compile("[\u0300-\u036f\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]+")


#: Marks at a word's end are punctuation, not letters.
_END_MARKS = re.compile(r"[!|.,;:?]+(?=\s|\Z)")
_TRICK = re.compile(r"[\d@$!|" + "".join(HOMOGLYPHS) + "]")


def fold(text: str) -> str:
    """` word word ... word `: lower case, look-alikes mapped, everything but letters a space."""
    t = text.lower()
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKC", t)).lower()
    if _TRICK.search(t):
        t = _END_MARKS.sub("", t).translate(_FOLD)
    return " " + " ".join(_INSIDE.findall(t)) + " "


#: Accented Latin letters -> the letters without.
_PLAIN = str.maketrans({c: d[0] for c in map(chr, [*range(0xDF, 0x250), *range(0x1E00, 0x1F00)]) if (d := unicodedata.normalize("NFKD", c))[0].isascii() and len(d) > 1 and c.islower()})


def readings(folded: str) -> list[str]:
    """A folded text, and the text of equal length without accents where it has any."""
    return [folded] if folded.isascii() or (plain := folded.translate(_PLAIN)) == folded else [folded, plain]


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def matcher(self):
        """text -> (weight, words): the scan by one automaton of entries and exceptions."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for p in self.exceptions:
            a.add_word(p, (len(p), 0.0))
        for p, w in self.entries.items():
            a.add_word(p, (len(p), w))
        ready = bool(len(a))
        if ready:
            a.make_automaton()

        def scan(text: str) -> tuple[float, int, list[tuple[int, float]], str]:
            t = fold(text)
            hits: dict[int, float] = {}
            spared: list[tuple[int, int]] = []

            def read(reading: str) -> None:
                for end, (n, w) in a.iter(reading):
                    start = end - n + 1
                    if w:
                        if reading[end] != " " and reading[end + 1] == " ":  # a beginning that is a whole word
                            continue
                        hits[start] = max(w, hits.get(start, 0.0))
                    else:
                        spared.append((start, end))

            if ready:
                read(t)
                if not t.isascii():
                    # the second reading can matter only where something was found, or an accented word holds an entry without its accents
                    accented = f" {' '.join([w for w in t.split(' ') if not w.isascii()])} ".translate(_PLAIN)
                    if hits or any(w for _, (_, w) in a.iter(accented)):
                        for reading in readings(t)[1:]:
                            read(reading)
            if spared and hits:
                # of the phrases that begin up to a hit, the one that reaches furthest decides; both lists are in order
                spared.sort()
                kept, at, reach = {}, 0, -1
                for s, w in sorted(hits.items()):
                    while at < len(spared) and spared[at][0] <= s:
                        reach, at = max(reach, spared[at][1]), at + 1
                    if s >= reach:
                        kept[s] = w
                hits = kept
            return sum(hits.values()), t.count(" ") - 1 if len(t) > 2 else 0, sorted(hits.items()), t

        return scan

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = features(weight, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1, the weight, and the weight normalised by length (a thousand words; short texts count as twenty)."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / np.maximum(words, 20))], axis=1)


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; the ridge keeps separable samples finite."""
    x, w = features(weight, words), np.zeros(3)
    keep = np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (toxic - p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(doc_id, toxic, text) of at most max_sample labelled documents that are not held out. The labels' side of the join
    is that bounded sample (a doc_id with several labels counts as toxic if one says so), so it is broadcast and only the
    sample's texts are shuffled: of rows that share a doc_id the text with the least hash is taken, which tasks settle first."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out())
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    rows = ids_and_text(docs).join(F.broadcast(some), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))
    return rows.groupBy("doc_id", "toxic").agg(least.alias("t")).select("doc_id", "toxic", F.col("t.text").alias("text"))


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """Drops rows that share the three least word hashes with another of the same label and a lesser doc_id: mostly near copies."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            keys = []
            for t in texts_of(b):
                h = sorted({xxhash.xxh64_intdigest(w) for w in fold(t).split()})[:3]
                keys.append(xxhash.xxh64_intdigest(repr(h)) - (1 << 63))
            return {"copy_key": keys}

        return f

    return add_columns(rows, make, "copy_key long").groupBy("toxic", "copy_key").agg(F.min_by("text", "doc_id").alias("text")).drop("copy_key")


def _terms(text: str) -> set[str]:
    out = set()
    for w in {w for reading in readings(fold(text)) for w in reading.split()}:
        if len(w) > 2:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in BEGINNINGS if len(w) > n)
    return out


def _count(rows: DataFrame, terms_of_rows) -> DataFrame:
    """(term, toxic, clean): in how many rows of either label a term is; counted inside tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        f = terms_of_rows()
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), texts_of(b), strict=True):
                seen[int(toxic > 0)].update(f(text))
        terms = list(seen[0].keys() | seen[1].keys())
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "toxic": pa.array([seen[1][t] for t in part], pa.int64()), "clean": pa.array([seen[0][t] for t in part], pa.int64())})

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE) -> Model:
    rows = durable(_one_of_copies(sample(docs, labels, max_sample)))
    n = {int(r["t"]): r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("t")).count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(curve=(3.0 if n.get(1) else -3.0, 0.0, 0.0))
    # terms of enough toxic rows first; only those are counted in the clean ones
    toxic = _count(rows.filter("toxic > 0"), lambda: _terms).filter(F.col("toxic") >= max(LEAST_SEEN, LEAST_SHARE * n[1]))
    seen = {r["term"]: r["toxic"] for r in toxic.collect()}
    clean = {r["term"]: r["clean"] for r in _count(rows.filter("toxic <= 0"), lambda: lambda text: _terms(text) & seen.keys()).collect()}
    entries = {}
    for term, k in sorted(seen.items()):
        c = clean.get(term, 0)
        ratio = max(k - 1.28 * math.sqrt(k), 0.0) / n[1] / ((c + 1.28 * math.sqrt(c) + 1) / n[0])
        if ratio >= LEAST_RATIO:
            entries[term] = min(math.log(ratio), 6.0)
    plain = Model(entries)

    def phrases():
        scan = plain.matcher()

        def f(text: str) -> set[str]:
            _, _, hits, t = scan(text)
            out = set()
            for at, _ in hits:
                end = t.index(" ", at + 1)
                if at > 0:
                    out.add(t[t.rindex(" ", 0, at) : end + 1])
                if end < len(t) - 1:
                    out.add(t[at : t.index(" ", end + 1) + 1])
            return out

        return f

    spare = _count(rows, phrases).filter(f"toxic = 0 and clean >= {LEAST_SEEN}").orderBy("term").collect()
    model = Model(entries, [r["term"] for r in spare])

    def weigh():
        scan = model.matcher()

        def f(b: pa.RecordBatch) -> dict:
            got = [scan(t)[:2] for t in texts_of(b)]
            return {"weight": [w for w, _ in got], "words": [n for _, n in got]}

        return f

    seen = add_columns(rows, weigh, "weight double, words long").select("toxic", "weight", "words").toPandas()
    model.curve = fit_curve(seen["weight"].to_numpy(float), seen["words"].to_numpy(float), (seen["toxic"] > 0).to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """All columns of docs, and (after `prefix`) score, predicted, and the hits' number and weight (hits, weight)."""

    def make():
        scan = model.matcher()

        def f(b: pa.RecordBatch) -> dict:
            got = [scan(t)[:3] for t in texts_of(b)]
            weight, words = np.array([w for w, _, _ in got]), np.array([n for _, n, _ in got])
            s = model.score(weight, words) if len(got) else np.zeros(0)
            return {"score": s.tolist(), "predicted": (s >= THRESHOLD).astype(int).tolist(), "hits": [len(h) for _, _, h in got], "weight": weight.tolist()}

        return f

    return add_columns(docs, make, "score double, predicted int, hits long, weight double", prefix=prefix)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ids_and_text(table(spark, sf_dir, "documents"))
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "hits")


QUERIES = {"op6_toxicity": op6_toxicity}
