"""URL filters by a Bloom filter cascade (native: DataFrame functions only).

Level 0 encodes the listed keys; each further level encodes the keys of the other side that the level before
let through by mistake, over the complete universe of keys, until nothing is left. Membership of any key of that
universe is then exact, and it is tested row by row with integer operations. Up to max_filter_bytes the levels are
literals of the plan: no join, no shuffle of the rows. A larger list is dealt by a hash of the key to shards of 64 KiB,
a cascade each, and rows meet their shard's levels by the shard's number (a broadcast up to 256 MiB in all).

Edge cases: a null url, or one without `://`, has an empty host and path, and is never listed; a null key is not
listed. An empty table gives an empty result; an empty list gives a cascade without levels, which lists nothing.
Repeated rows are judged alike. Long urls are read whole. host, path, rule, verdict and listed (after `prefix`) replace
columns of the input of these names; all others stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unused
from . import bloom
from .common import durable, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules (host, path, verdict) of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Host labels whose hosts the query lists.
LISTED_LABELS = ["cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x", "spam-farm"]


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def with_host_and_path(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no `://`."""
    rest = unused(df, "__rest")[0]
    df = df.withColumn(rest, F.coalesce(_rest(F.col(url)), F.lit("")))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumn(f"{prefix}host", host).withColumn(f"{prefix}path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).drop(rest)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = [], []
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule.append(F.when(fits, F.lit(h + p)))
        verdict.append(F.when(fits, F.lit(v)))
    return F.coalesce(*rule), F.coalesce(*verdict)


@dataclass
class Level:
    """Bits and hashes of a level; its words where they are a literal."""

    bits: int
    hashes: int
    words: list[int] | None = None


@dataclass
class Cascade:
    """Exact membership of the keys of the universe it was built on. Where `table` is set, it holds for each of
    `shards` a row (shard, w0, w1, ...) with the words of the levels."""

    levels: list[Level] = field(default_factory=list)
    shards: int = 1
    table: DataFrame | None = None

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            # a literal of a checked size, folded once
            words = F.col(f"__w{i}") if level.words is None else F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
            out = F.when(bloom.passes(words, [key], i, level.bits, level.hashes), out).otherwise(F.lit(i % 2 == 1))
        return key.isNotNull() & out

    def flag(self, df: DataFrame, key: str, name: str = "listed") -> DataFrame:
        if self.table is None:
            return df.withColumn(name, self.listed(F.col(key)))
        size = self.shards * sum(x.bits for x in self.levels) // 8
        # the table is written out, so that beyond a broadcast both sides have a plain exchange, and adaptive execution splits
        # the shard of a host with many rows; the caller's columns have other names meanwhile
        plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
        at = plain[f"c{df.columns.index(key)}"]
        met = plain.withColumn("__shard", bloom.shard_of([at], self.shards)).join(bloom.meeting(self.table, size), "__shard")
        kept = [(c, n) for c, n in zip(plain.columns, df.columns, strict=True) if n.lower() != name.lower()]
        return met.select(*(F.col(c) for c, _ in kept), self.listed(at).alias("__listed")).toDF(*(n for _, n in kept), name)


def build_cascade(universe: DataFrame, max_filter_bytes: int = 4 << 20) -> Cascade:
    """universe: (key string, listed boolean), each key once. Every level's size is computed from a count before it is
    built. Where the first level exceeds max_filter_bytes, all levels are dealt to shards and stay tables; else their
    words (bits / 64) reach the driver."""
    universe = durable(universe.select("key", "listed").filter("key is not null"))
    n_all, n_listed = universe.agg(F.count("*"), F.count_if("listed")).first()
    first = min(0.5, max(1e-4, 0.7 * n_listed / max(1, n_all - n_listed)))
    size = lambda n, p: max(64, -(-int(n * -math.log(p) / math.log(2) ** 2) // 64) * 64)
    shards = 1 if size(n_listed, first) // 8 <= max_filter_bytes else -(-size(n_listed, first) // 8 // min(bloom.SHARD_BYTES, max_filter_bytes))
    out, include, tables = Cascade(shards=shards), True, []
    passed = universe.withColumn("shard", bloom.shard_of([F.col("key")], shards))
    while remaining := passed.filter(F.col("listed") == F.lit(include)).groupBy("shard").count().agg(F.max("count")).first()[0]:
        i = len(out.levels)
        p = first if i == 0 else 0.5
        level = Level(size(remaining, p), max(1, round(-math.log2(p))))
        words = bloom.words_by_shard(passed.filter(F.col("listed") == F.lit(include)), ["key"], "shard", shards, i, level.bits, level.hashes)
        if shards == 1:
            level.words = words.first()["words"]
            literal = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
            passed = passed.filter((F.col("listed") == F.lit(include)) | bloom.passes(literal, [F.col("key")], i, level.bits, level.hashes))
        else:
            tables.append(durable(words.withColumnRenamed("words", f"__w{i}")))
            met = passed.join(bloom.meeting(tables[-1], shards * level.bits // 8), "shard")
            passed = durable(met.filter((F.col("listed") == F.lit(include)) | bloom.passes(F.col(f"__w{i}"), [F.col("key")], i, level.bits, level.hashes)).drop(f"__w{i}"))
        out.levels.append(level)
        include = not include
        # of the side just encoded, all pass; the other side keeps only its false positives
    if tables:
        out.table = durable(reduce(lambda a, b: a.join(b, "shard"), tables).withColumnRenamed("shard", "__shard"))
    return out


def judge_urls(pages: DataFrame, listed: Column, rules: list[tuple[str, str, str]], url: str = "url", max_filter_bytes: int = 4 << 20, prefix: str = "") -> DataFrame:
    """Adds (after `prefix`) host, path, rule, verdict and listed. `listed` is a condition on the column `key` (a host) that
    marks the blocklist inside the universe of hosts; the universe is one aggregation on hosts, which combines before it shuffles."""
    pages, name = with_host_and_path(pages, url, prefix), lambda x: f"{prefix}{x}"
    hosts = pages.groupBy(F.col(name("host")).alias("key")).agg(F.lit(1).alias("__one"))
    cascade = build_cascade(hosts.select("key", listed.alias("listed")), max_filter_bytes)
    rule, verdict = matching_rule(F.col(name("host")), F.col(name("path")), rules)
    out = cascade.flag(pages, name("host"), name("listed"))
    return out.withColumn(name("rule"), rule).withColumn(name("verdict"), F.coalesce(verdict, F.when(F.col(name("listed")), "block").otherwise("allow")))


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.col("key").rlike(r"(^|\.)(" + "|".join(LISTED_LABELS) + r")(\.|$)")
    return judge_urls(table(spark, sf_dir, "pages"), listed, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def _case(what: int) -> str:
    rows = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'" for h, p, v in rows) + " END"


SQL = {
    "op9_url_cascade": rf"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
l AS (SELECT *, regexp_matches(host, '(^|\.)({"|".join(LISTED_LABELS)})(\.|$)') AS listed FROM h)
SELECT page_id, host, path, {_case(0)} AS rule, COALESCE({_case(1)}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM l
"""
}
QUERIES = {"op9_url_cascade": op9_url_cascade}
