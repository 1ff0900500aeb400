"""Secret scans by character Markov models (native: DataFrame functions only).

Base patterns find assignments, access keys and hexadecimal runs. Beside them, every other run of at least
MODEL_LENGTH key characters is scored by two first-order Markov models over those characters, one of random strings and
one of ordinary identifiers; a log-likelihood ratio above the thresholds, in all and a character, makes it a span of
kind `model`. The models are counted from labelled samples with add-one smoothing: at most 2 * 66**2 counts reach the driver.

Positions come from splitting the text at its matches, so all of a text is scanned, whatever its length; the work is
linear in the text and its spans (sorting aside), as positions are running sums and nothing tests all spans against all.

Edge cases: a null text is empty and has no spans. Empty tables give no rows (the models then know the random samples
alone, and are not used). Repeated rows get the same spans; spans that begin together are ordered by kind. base_spans
and all_spans (after `prefix`) replace columns of df of these names; all others stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, ids_and_text, let, running, table

#: Kind -> (pattern, the group whose length counts, the least length), in the order of the kinds.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Cheap tests that a text must pass to hold a match that counts.
GATES = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_"
MODEL_LENGTH = 16
MODEL_PATTERN = rf"[A-Za-z0-9+/=_]{{{MODEL_LENGTH},}}"
LEAST_TOTAL, LEAST_MEAN = 14.0, 0.5
#: Bounds of the labelled samples: random strings made, and documents whose words are the ordinary identifiers.
RANDOM_SAMPLES, IDENTIFIER_DOCUMENTS = 3000, 400
#: Words that are joined to one identifier in camel case.
JOINED = 8

SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string,match:string,byte_start:bigint,byte_end:bigint>>"


def spans(text: Column, kind: str, kind_no: int, pattern: str, gate: str, group: int = 0, least: int = 0) -> Column:
    """The spans of a pattern: leftmost, non-overlapping, those whose group is shorter than `least` dropped."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(group)) if group else found, lambda g: F.length(g))
    before = lambda m: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
    rows = lambda m: F.arrays_zip(before(m).alias("gap"), m.alias("match"), sizes.alias("n"))

    def placed(rows: Column) -> Column:
        ends = lambda size: running(F.transform(rows, lambda x: (size(x["gap"]) + size(x["match"])).cast("long")), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            start, byte = at["c"] + F.length(x["gap"]), at["b"] + F.octet_length(x["gap"])
            return F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), (start + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), byte.alias("byte_start"), (byte + F.octet_length(x["match"])).alias("byte_end"))

        at = F.zip_with(ends(F.length), ends(F.octet_length), lambda c, b: F.struct(c.alias("c"), b.alias("b")))
        return F.array_compact(F.zip_with(rows, at, lambda x, y: F.when(x["n"] >= least, span(x, y))))

    return F.when(text.rlike(gate), let(let(found, rows), placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def _pairs(codes: Column) -> Column:
    """Transitions as one number each: previous code times the alphabet's size plus one, plus code (0: other or none)."""
    n = len(ALPHABET) + 1
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.size(codes) - 1)), codes, lambda a, b: a * n + b)


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(text, random): strings made from digests, and the words of a bounded sample of documents, alone and joined."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    b64 = F.base64(F.unhex(digest))
    made = F.element_at(F.array(b64, F.translate(b64, "+/=", "xyz"), F.substring(digest, 1, 40), F.upper(F.translate(b64, "+/=", "789"))), (F.col("id") % 4 + 1).cast("int"))
    random = docs.sparkSession.range(RANDOM_SAMPLES).select(made.alias("text"), F.lit(True).alias("random"))
    clean = F.col("text")
    for pattern, _, _ in BASE.values():
        clean = F.regexp_replace(clean, pattern if pattern != BASE["hex"][0] else GATES["hex"] + "[0-9a-f]*", " ")
    some = _distinct_sample(ids_and_text(docs).filter("doc_id is not null and text is not null"), IDENTIFIER_DOCUMENTS)
    words = some.select(F.regexp_extract_all(clean, F.lit(r"[A-Za-z0-9]{3,}"), F.lit(0)).alias("w"))
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    groups = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / JOINED).cast("int"), F.lit(0)))
    camel = let(F.transform("w", lambda x: F.initcap(x)), lambda c: F.transform(groups, lambda i: F.array_join(F.slice(c, i * JOINED + 1, F.lit(JOINED)), "")))
    every = F.concat("w", pairs(F.col("w")), F.transform(pairs(F.col("w")), F.upper), camel)
    return random.unionByName(words.select(F.explode(every).alias("text"), F.lit(False).alias("random")))


def _distinct_sample(rows: DataFrame, n: int) -> DataFrame:
    """The distinct (doc_id, text) with the n least hashes. Rows whose hash is above a bound are left out before any are
    gathered; the bound follows from the number of rows, and rises where repeated rows leave too few."""
    total, part = rows.count(), 5 * n
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    while True:
        share = min(1.0, part / max(total, 1))
        low = rows if share == 1.0 else rows.filter(F.col("h") < F.lit(int(-(1 << 63) + share * (1 << 64))))
        low = durable(low.dropDuplicates(["doc_id", "text"]))
        least = [r["h"] for r in low.select("h").distinct().orderBy("h").limit(n).collect()]
        if share == 1.0 or len(least) == n:
            return low.filter(F.col("h") <= F.lit(least[-1] if least else 0)).drop("h")
        part *= 16


def train(samples: DataFrame) -> list[float] | None:
    """Log-likelihood ratios of the transitions (random against ordinary), or None where a label has no sample."""
    n = len(ALPHABET) + 1
    counts = samples.select("random", F.explode(_pairs(_codes(F.col("text")))).alias("pair")).groupBy("random", "pair").count().collect()
    seen = {label: [0] * (n * n) for label in (True, False)}
    for r in counts:
        seen[r["random"]][r["pair"]] += r["count"]
    if not all(map(any, seen.values())):
        return None
    total = {label: [sum(seen[label][a * n : (a + 1) * n]) for a in range(n)] for label in seen}
    return [math.log((seen[True][k] + 1) / (total[True][k // n] + n)) - math.log((seen[False][k] + 1) / (total[False][k // n] + n)) for k in range(n * n)]


def _before(events: Column) -> Column:
    """For each query (w = 0) of sorted (at, tie, w) events: how many events of weight 1 come before it."""
    e = let(F.array_sort(events), lambda e: F.zip_with(e, running(F.transform(e, lambda x: x["w"]), lambda a, b: a + b), lambda x, n: F.when(x["w"] == 0, n)))
    return F.array_compact(e)


def untouched(runs: Column, base: Column) -> Column:
    """Those of disjoint sorted runs that no base span overlaps: as many base spans begin before a run's end as end up to its start."""
    event = lambda at, tie, w: F.struct(at.alias("at"), F.lit(tie).alias("tie"), F.lit(w).cast("long").alias("w"))
    ended = _before(F.concat(F.transform(base, lambda b: event(b["end"], 0, 1)), F.transform(runs, lambda r: event(r["start"], 1, 0))))
    begun = _before(F.concat(F.transform(base, lambda b: event(b["start"], 1, 1)), F.transform(runs, lambda r: event(r["end"], 0, 0))))
    free = F.zip_with(ended, begun, lambda x, y: x == y)
    return F.when(F.size(base) == 0, runs).otherwise(F.array_compact(F.zip_with(runs, free, lambda r, f: F.when(f, r))))


def model_spans(text: Column, ratios: list[float], base: Column) -> Column:
    """Runs of key characters that touch no base span and look random."""
    table_ = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")

    def looks_random(s: Column) -> Column:
        total = F.aggregate(_pairs(_codes(s["match"])), F.lit(0.0), lambda a, p: a + F.get(table_, p))
        return (total >= LEAST_TOTAL) & (total >= LEAST_MEAN * F.length(s["match"]))

    def chosen(runs: Column) -> Column:
        # the models first: few runs look random, and only those are held against the base spans
        return F.when(F.size(runs) == 0, runs).otherwise(let(F.filter(runs, looks_random), lambda r: untouched(r, base)))

    return let(spans(text, "model", len(BASE), MODEL_PATTERN, MODEL_PATTERN), chosen)


def scan(docs: DataFrame, ratios: list[float] | None, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds base_spans and all_spans (after `prefix`): arrays of (start, kind_no, end, kind, match, byte_start, byte_end), start and
    end in code points, ends exclusive."""
    t, base = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(f"{prefix}base_spans")
    parts = [spans(t, kind, i, pattern, GATES[kind], group, least) for i, (kind, (pattern, group, least)) in enumerate(BASE.items())]
    docs = docs.withColumn(f"{prefix}base_spans", F.array_sort(F.concat(*parts)))
    more = model_spans(t, ratios, base) if ratios else F.array().cast(SPAN)
    return docs.withColumn(f"{prefix}all_spans", F.array_sort(F.concat(base, more)))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (sorted) replaced by the mark; a null text stays null. What lies between
    the runs is cut by bytes, from the furthest end so far to the next start that is not before it."""
    cut = lambda b, x, y: F.substring(b, (x + 1).cast("int"), (y - x).cast("int")).cast("string")

    def pieces(b: Column) -> Column:
        ends = running(F.transform(found, lambda s: s["byte_end"]), F.greatest)
        parts = F.array_compact(F.zip_with(found, ends, lambda s, e: F.when(s["byte_start"] >= e, F.concat(cut(b, e, s["byte_start"]), F.lit(mark)))))
        last = F.array_max(F.transform(found, lambda s: s["byte_end"]))
        return F.concat(F.array_join(parts, ""), cut(b, last, F.octet_length(b)))

    return F.when(F.size(found) > 0, let(text.cast("binary"), pieces)).otherwise(text)


def _said(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ids_and_text(table(spark, sf_dir, "documents"))
    out = scan(docs, train(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(_said(F.col("base_spans")), 256).alias("base_sha256"), _said(F.col("all_spans")).alias("spans"))


QUERIES = {"op7_secrets": op7_secrets}
