"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy, measured in characters.

The words' codes (exact: a dictionary of the text's own words) are mixed and summed with the powers of an odd base. The
hash of a window of n words, for every n, is a difference of two of these sums, brought to the window's beginning by the
base's inverse: a polynomial hash modulo 2**64 that rolls by one subtraction and one product. The coverage is the share
of the word characters inside windows that occur at least twice. Lines are measured alike. Any n of NGRAM_LIMITS over
its limit, or lines over theirs, reject a document.

Edge cases: a null text has no words and fails the base rules, as empty texts do. Empty tables give no rows. Repeated
rows, and ties of doc_id, are judged alike, each for itself. Very long texts are processed whole: memory is a few arrays
of a text's word count. The added columns (after `prefix`) replace columns of docs of these names; all others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, ids_and_text, table, texts_of

SYMBOLS = "#*$%&|<>"

#: n -> largest share of word characters inside n-grams found twice or more.
NGRAM_LIMITS = {2: 0.65, 3: 0.5, 5: 0.3, 8: 0.25, 10: 0.25}
LINE_LIMIT = 0.3
SYMBOL_LIMIT = 0.25

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Windows:
    """Rolling hashes of the windows of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        powers = lambda x: np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(len(codes) - 1, 0), x, np.uint64)]), dtype=np.uint64)[: len(codes)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * powers(_BASE), dtype=np.uint64)])
        self.back = powers(_INVERSE)

    def hashes(self, n: int) -> np.ndarray:
        """Polynomial hash modulo 2**64 of each window of n codes."""
        m = max(len(self.sums) - n, 0)
        return (self.sums[n:] - self.sums[:m]) * self.back[:m]

    def repeated(self, n: int) -> np.ndarray:
        """Per code: whether it lies in a window of n that is found twice or more (the first included)."""
        h, size = self.hashes(n), len(self.back)
        if len(h) < 2:
            return np.zeros(size, bool)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if not same.any():
            return np.zeros(size, bool)
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(size + 1, np.int64)
        edge[: len(h)] += twice
        edge[n : n + len(h)] -= twice
        return np.cumsum(edge[:-1]) > 0


def measure(text: str) -> dict:
    """All figures of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly \x20 and \x09-\x0D
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    chars = np.array([len(w) for w in known], np.int64) if raw.isascii() else np.array([len(w.decode("utf-8", "surrogatepass")) for w in known], np.int64)
    lengths = chars[codes] if len(words) else np.zeros(0, np.int64)
    total = int(lengths.sum())
    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for x in lines:
        if x in seen:
            if y := x.encode("utf-8", "surrogatepass").split():
                dup += 1
                dup_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in y)
        else:
            seen.add(x)
    out = {"n_words": len(words), "word_chars": total, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": dup, "line_coverage": dup_chars / max(total, 1)}
    windows = Windows(codes) if len(known) < len(words) else None
    for n in NGRAM_LIMITS:
        mask = windows.repeated(n) if windows else np.zeros(len(words), bool)
        out[f"coverage_{n}"] = float(lengths[mask].sum()) / max(total, 1)
        if n == 5:
            out["n_repeat_words"] = int(mask.sum())
    return out


COVERAGES = ["line_coverage", *(f"coverage_{n}" for n in NGRAM_LIMITS)]
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
ADDED = ", ".join(f"{x} long" for x in LONGS) + ", " + ", ".join(f"{x} double" for x in COVERAGES)


def repetition(docs: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of docs, and (after `prefix`) the figures, base_failed and kept, for every row."""

    def make():
        def f(b: pa.RecordBatch) -> dict:
            rows = [measure(x) for x in texts_of(b)]
            return {k: [r[k] for r in rows] for k in (*LONGS, *COVERAGES)}

        return f

    out, c = add_columns(docs, make, ADDED, prefix=prefix), lambda name: F.col(prefix + name)
    base = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    bad = (c("line_coverage") > LINE_LIMIT) | (c("n_symbols") > SYMBOL_LIMIT * c("n_words"))
    for n, limit in NGRAM_LIMITS.items():
        bad = bad | (c(f"coverage_{n}") > limit)
    return out.withColumn(f"{prefix}base_failed", base).withColumn(f"{prefix}kept", ~base & ~bad)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(ids_and_text(table(spark, sf_dir, "documents"))).select("doc_id", *LONGS, "base_failed", "kept", *(F.round(c, 6).alias(c) for c in COVERAGES))


def _sql() -> str:
    """The same figures from windows of joined words; every whole text."""
    ns = list(NGRAM_LIMITS)
    keys = ", ".join(f"CASE WHEN lead(word, {n - 1}) OVER o IS NOT NULL THEN " + " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))]) + f" END AS k{n}" for n in ns)
    counts = ", ".join(f"CASE WHEN k{n} IS NOT NULL AND COUNT(*) OVER (PARTITION BY doc_id, k{n}) > 1 THEN 1 ELSE 0 END AS c{n}" for n in ns)
    marks = ", ".join(f"MAX(c{n}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS r{n}" for n in ns)
    sums = ", ".join(f"SUM(n * r{n}) AS s{n}" for n in ns)
    covered = ", ".join(f"round(COALESCE(s{n}, 0) / greatest(word_chars, 1), 6) AS coverage_{n}" for n in ns)
    bad = " OR ".join([f"line_chars / greatest(word_chars, 1) > {LINE_LIMIT}", f"n_symbols > {SYMBOL_LIMIT} * n_words", *(f"COALESCE(s{n}, 0) / greatest(word_chars, 1) > {x}" for n, x in NGRAM_LIMITS.items())])
    base = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return rf"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents), l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, length(word) AS n, {keys} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT doc_id, pos, n, {counts} FROM k), r AS (SELECT doc_id, n, {marks} FROM c), g AS (SELECT doc_id, {sums}, SUM(r5) AS reps FROM r GROUP BY doc_id),
i AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS at_line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM t)),
j AS (SELECT doc_id, COUNT(*) AS dups, SUM(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY at_line) AS nth FROM i) WHERE nth > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(dups, 0) AS n_dup_lines, CAST(COALESCE(reps, 0) AS BIGINT) AS n_repeat_words, COALESCE(j.chars, 0) AS line_chars, {", ".join(f"s{n}" for n in ns)} FROM l LEFT JOIN g USING (doc_id) LEFT JOIN j USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT {base} AND NOT ({bad}) AS kept, round(line_chars / greatest(word_chars, 1), 6) AS line_coverage, {covered} FROM f"""


SQL = {"op3_quality": _sql()}
QUERIES = {"op3_quality": op3_quality}
