"""BM25 over a stored index of words: texts are tokenised once, each to its length, its distinct words and their counts.

The index is a table in buckets by document (sources.buckets): where few texts change, only those are tokenised again, and the buckets
they fall into are joined at once, as every search reads all of them; where many do, the index is written anew. Beside it lie, for
each version, the number of documents with each word, and the sums that scores need; both come from the index, not from texts.

Queries are a table of any size. They are dealt into blocks of about MOST_ASKED words; a block's words go to every task,
which scores its documents batch by batch from the postings of that batch, and keeps the k best of each query as it goes. So k
rows a query and task are shuffled, never pairs; each block takes one pass over the index, and its result is written before the next begins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import tokens
from ..sources.buckets import Buckets
from ..stored import durable

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Words of queries (each counted once a query) that go to every task at once; documents, and postings and scores, worked on at once in a task.
MOST_ASKED, DOCUMENTS, MOST_POSTINGS = 1_000_000, 2_500, 250_000
#: Kinds of queries that documents are told apart by, and documents of one kind that are looked at, or left out, at once.
KINDS, GROUP = 8, 512
#: Documents that queries of more words than that meet before all others, to know what the best are at least.
SHOWN = 2048
#: Share of the pairs of a query and a document from which on a word that both have is weighed in a matrix; how many words are.
HEAVY, MOST_HEAVY = 0.002, 1024
#: Share, and number, of documents not as stored beyond which an index is written anew; as many ids go to every task at most.
MANY, MOST_PICKED = 0.1, 500_000


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Adds a rank from 1 in each group; with k, only the first k rows stay (a group limit runs before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col(name) <= k) if k else out


def raw_idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(n_docs) - df + 0.5) - F.log(df + 0.5)


class Nearest:
    """For each of n queries the k rows with the least value (rounded to six places, then the least name), taken batch by batch."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [(np.zeros(0), np.zeros(0, object))] * n
        self.worst = np.full(n, np.inf)

    def add(self, names: np.ndarray, values: np.ndarray, there: np.ndarray | None = None, which: np.ndarray | None = None) -> None:
        """values: one row for each query, or for those of `which`; `there`: which values count."""
        close = np.round(values, 6) <= (self.worst if which is None else self.worst[which])[:, None]
        if there is not None:
            close &= there
        for row in np.flatnonzero(close.any(axis=1)).tolist():
            i = row if which is None else int(which[row])
            d, x = np.append(self.rows[i][0], values[row, close[row]]), np.append(self.rows[i][1], names[close[row]])
            first = np.lexsort((x, np.round(d, 6)))[: self.k]
            self.rows[i] = d[first], x[first]
            if len(first) == self.k:
                self.worst[i] = np.round(d[first[-1]], 6)

    def batches(self, queries: list, names: list[str], sign: float = 1.0) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(queries), 256):
            found = [(q, x, sign * d) for q, (ds, xs) in zip(queries[at : at + 256], self.rows[at : at + 256], strict=True) for d, x in zip(ds.tolist(), xs.tolist(), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than there are cores, such as one file, dealt to all; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gathered(df: DataFrame) -> DataFrame:
    """A table of many small partitions in fewer, without a shuffle: up to four of them go to a task, as long as each core has two tasks."""
    n = df.rdd.getNumPartitions()
    return df.coalesce(min(n, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // 4))))


def word_counts(docs: DataFrame, doc: str, text: str, words_of: Callable[[Column], Column] = tokens) -> DataFrame:
    """(doc, dl, words, counts): a row a document, its distinct words with their counts; null texts have none."""
    kind = dict(docs.select(F.col(doc).alias("doc")).dtypes)["doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                size = np.diff(b.column(1).offsets.to_numpy())
                coded = b.column(1).flatten().dictionary_encode()
                pairs = np.repeat(np.arange(b.num_rows), size) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
                found, counts = np.unique(pairs, return_counts=True)
                row, word = np.divmod(found, max(1, len(coded.dictionary)))
                at = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                words = coded.dictionary.take(pa.array(word))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(at, words), pa.ListArray.from_arrays(at, pa.array(counts.astype(np.int32)))], names=["doc", "dl", "words", "counts"])

    return spread(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))).select("doc", words_of(F.col("text")).alias("t")).mapInArrow(run, f"doc {kind}, dl long, words array<string>, counts array<int>")


class Words:
    """An index in hand: `terms` (as word_counts gives them), `vocab` (token, df), and the sums over it. `plain`: a document's score
    is not BM25's but the number of distinct words that it shares with the query."""

    def __init__(self, terms: DataFrame, vocab: DataFrame | None = None, words_of: Callable[[Column], Column] = tokens, plain: bool = False):
        self.terms, self.words_of, self.plain = terms, words_of, plain
        self.vocab = vocab if vocab is not None else durable(vocabulary_of(terms))
        self._sums: tuple[int, float, float] | None = None

    def sums(self) -> tuple[int, float, float]:
        """(documents, mean length, mean idf over all words)."""
        if self._sums is None:
            n, total = self.terms.agg(F.count("*"), F.sum("dl")).first()
            mean = self.vocab.agg(F.avg(raw_idf(F.col("df"), n))).first()[0]
            self._sums = n, (total or 0) / max(n, 1), mean or 0.0
        return self._sums

    def search(self, queries: DataFrame, k: int, query: str = "query_id", query_text: str = "text", fill: bool = True, most_asked: int = MOST_ASKED) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query. A repeated query word counts each time; an idf below
        zero becomes a quarter of the mean over all words. With `fill`, documents that share no word follow with score 0 in
        their own order, so that k rows come where there are as many documents. Scores are compared to six places."""
        n_docs, avgdl, mean = self.sums()
        raw = raw_idf(F.col("df"), n_docs)
        weight = F.when(raw < 0, FLOOR * mean).otherwise(raw)
        own = queries.select(F.to_json(F.struct(F.col(query).alias("query"))).alias("key"), F.col(query).alias("query"), F.col(query_text).alias("said"))
        # a number for each key, whatever its type
        numbered = durable(own.select("key", "query").distinct().withColumn("i", F.monotonically_increasing_id()))
        asked = own.join(numbered.select("key", "i"), "key").select("i", F.explode_outer(self.words_of(F.col("said"))).alias("token")).filter("token is not null").groupBy("i", "token").agg(F.count("*").alias("qn"))
        asked = durable(asked.join(self.vocab, "token").select("i", "token", (F.lit(1.0) if self.plain else F.col("qn") * weight).alias("w"), "df"))
        n_asked = asked.count()
        blocks = max(1, -(-n_asked // most_asked))
        parts, some = [], None
        if n_asked > SHOWN and n_docs > 4 * SHOWN:
            # longer documents, which most of the best are, so that few of them say much
            by_chance = F.pmod(F.xxhash64("doc"), F.lit(max(1, n_docs // (4 * SHOWN)))) == 0
            some = self.terms.select("doc", "dl", "words", "counts").filter(by_chance & F.col("doc").isNotNull() & F.col("dl").between(avgdl, 8 * avgdl)).limit(2 * SHOWN).toArrow()
        for block in range(blocks):
            rows = asked.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toArrow()
            if rows.num_rows:
                best = ranked(_scored(rows, self.terms, k, n_docs, avgdl, self.plain, some), ["i"], [F.desc(F.round("score", 6)), F.asc("doc")], k)
                parts.append(durable(best) if blocks > 1 else best)
        kind = dict(self.terms.dtypes)["doc"]
        top = reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], f"i long, doc {kind}, score double, rank int")
        top = top.join(numbered.select("i", "query"), "i").select("query", "doc", "score", "rank")
        if not fill:
            return top
        top = durable(top)
        short = numbered.select("query").join(top.groupBy("query").agg(F.count("*").alias("n")), "query", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query")
        first = self.terms.select("doc").filter("doc is not null").orderBy("doc").limit(2 * k)  # fewer than k of these can be hits
        zero = short.crossJoin(F.broadcast(first)).join(top.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
        return ranked(top.select("query", "doc", "score").unionByName(zero), ["query"], [F.desc(F.round("score", 6)), F.asc("doc")], k)


def vocabulary_of(terms: DataFrame) -> DataFrame:
    return terms.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


class Best:
    """For each of n queries the k documents with the greatest score (rounded to six places, then the least name), taken many queries at once."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        """least: scores that the k best of each query reach anyhow, if known."""
        self.k, self.scores, self.names = k, np.full((n, k), -np.inf), None
        self.worst = np.full(n, -np.inf) if least is None else least.copy()

    def close(self, which: np.ndarray, scores: np.ndarray, there: np.ndarray | float, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, at): which scores may be among the k best. scores: a row for each query of `which`, right but for a share of each, of which
        `short` is what is left at least; `there`: which of them count, or the least that does."""
        sure = lambda least: ((least - 1e-6) * short)[:, None]
        close = scores >= np.maximum(sure(self.worst[which]), there if isinstance(there, float) else -np.inf)
        if not isinstance(there, float):
            close &= there
        if scores.shape[1] > 4 * self.k and np.count_nonzero(close) > 2 * self.k * len(scores):
            kth = np.partition(np.where(close, scores, -np.inf), scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            close &= scores >= sure(kth)
        return np.divmod(np.flatnonzero(close), scores.shape[1])

    def add(self, names: np.ndarray, row: np.ndarray, scores: np.ndarray) -> None:
        """names and scores of documents, and whose they are; all that a query has at once, as close() gives them."""
        if not len(row):
            return
        if self.names is None:
            self.names = np.zeros(self.scores.shape, names.dtype)
        met = np.unique(row)
        old, place = np.nonzero(np.isfinite(self.scores[met]))
        owner = np.concatenate([row, met[old]])
        score = np.concatenate([scores, self.scores[met[old], place]])
        name = np.concatenate([names, self.names[met[old], place]])
        order = np.lexsort((name, -np.round(score, 6), owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = rank < self.k
        owner, rank, order = owner[kept], rank[kept], order[kept]
        self.scores[owner, rank], self.names[owner, rank] = score[order], name[order]
        self.worst[met] = np.maximum(self.worst[met], np.round(self.scores[met, -1], 6))

    def batches(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(queries) if self.names is not None else 0, 512):
            row, place = np.nonzero(np.isfinite(self.scores[at : at + 512]))
            if len(row):
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(row + at)), pa.array(self.names[row + at, place], kind), pa.array(self.scores[row + at, place])], names=["i", "doc", "score"])


def runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, which): the places from each begin to its end, one run after another, and the run that each is of."""
    many = (end - begin).astype(np.intp)
    which = np.repeat(np.arange(len(many)), many)
    return (begin - (np.cumsum(many) - many))[which] + np.arange(len(which)), which


def _kinds(owner: np.ndarray, cols: np.ndarray, weighs: np.ndarray, heavy: np.ndarray, n: int) -> np.ndarray:
    """A row of weights of the heavy words for each of a few kinds of queries, such as those of one language: the middles that some of the n queries
    gather around. They only say which documents are looked at together."""
    taken = np.unique(np.linspace(0, n - 1, min(n, 2048)).astype(np.int64))
    row, col = np.full(n, -1), np.full(cols.max() + 1, -1)
    row[taken], col[heavy] = np.arange(len(taken)), np.arange(len(heavy))
    mine = (row[owner] >= 0) & (col[cols] >= 0)
    said = np.zeros((len(taken), max(1, len(heavy))))
    said[row[owner[mine]], col[cols[mine]]] = weighs[mine]
    said /= np.maximum(np.linalg.norm(said, axis=1, keepdims=True), 1e-30)
    middles = said[:1]
    while len(middles) < KINDS:  # the query that is least like those taken so far
        middles = np.vstack([middles, said[(said @ middles.T).max(axis=1).argmin()]])
    for _ in range(8):
        near = (said @ middles.T).argmax(axis=1)
        middles = np.vstack([said[near == i].sum(axis=0) if (near == i).any() else m for i, m in enumerate(middles)])
        middles = middles / np.maximum(np.linalg.norm(middles, axis=1, keepdims=True), 1e-30)
    return middles[:, : len(heavy)]


def _scored(asked: pa.Table, terms: DataFrame, k: int, n_docs: int, avgdl: float, plain: bool = False, some: pa.Table | None = None) -> DataFrame:
    """(i, doc, score): of each task the k best documents of each query. asked: (i, token, w, df).

    A word that many queries and many documents have is weighed as a row of a matrix of batch after batch, others by their postings. The
    matrices are multiplied in single precision, which is off by a known share at most, as all is above zero; what may be among the best is
    then worked out again in double precision. Documents of one kind are looked at together, and by no query that cannot find one of its
    best among them. `some`: documents that each query meets before all others, in one task: no task needs to keep what is worse than the
    k best of them. No document is left out for it."""
    asked = asked.select(["i", "token", "w", "df"]).combine_chunks().sort_by([("i", "ascending"), ("token", "ascending")])
    said, told = (asked.column(c).combine_chunks().dictionary_encode() for c in ("i", "token"))
    queries, words = said.dictionary, told.dictionary
    # the queries' words one after another: whose they are, which words, and what a match weighs
    owner, cols = said.indices.to_numpy(), told.indices.to_numpy()
    weighs = asked.column("w").to_numpy()
    always, kind = bool((weighs > 0).all()), dict(terms.dtypes)["doc"]
    df = np.zeros(len(words))
    df[cols] = asked.column("df").to_numpy()
    share = np.bincount(cols, minlength=len(words)) / len(queries) * df / max(n_docs, 1)
    heavy = np.argsort(-share, kind="stable")[: min(MOST_HEAVY, int((share > HEAVY).sum()))] if always else np.zeros(0, np.int64)

    kinds, doc_kind = _kinds(owner, cols, weighs, heavy, len(queries)), to_arrow_type(terms.schema["doc"].dataType)
    every_owner, every_col, every_weight = owner, cols, weighs

    def best_of(batches: Iterator[pa.RecordBatch], lo: int, hi: int, least: np.ndarray | None = None) -> Best:
        """The best of the documents for the queries from lo on to hi."""
        n_queries, mine = hi - lo, slice(*np.searchsorted(every_owner, [lo, hi]).tolist())
        owner, cols, weighs = every_owner[mine] - lo, every_col[mine], every_weight[mine]
        best = Best(n_queries, k, least)
        row_of = np.full(len(words), -1, np.int32)
        row_of[heavy] = np.arange(len(heavy))
        rows, every = row_of[cols], np.arange(n_queries + 1)
        thick, thin = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        thick_rows, thick_weighs, thick = rows[thick], weighs[thick], owner[thick]
        thin_cols, thin_weighs, thin = cols[thin], weighs[thin], owner[thin]
        from_thick, from_thin = np.searchsorted(thick, every), np.searchsorted(thin, every)
        # a sum of n products in single precision, each of two rounded numbers, keeps this share of itself at least
        short = 1 - (np.diff(from_thick) + 8) * 2.0**-23 if len(heavy) else np.ones(n_queries)
        step = max(1, MOST_POSTINGS // GROUP)
        for b in batches:
            for start in range(0, b.num_rows, DOCUMENTS):
                part = b.slice(start, DOCUMENTS)
                n, dl = part.num_rows, part.column(1).to_numpy()
                found = pc.index_in(part.column(2).flatten(), value_set=words)
                there = found.is_valid().to_numpy(zero_copy_only=False)
                word = found.drop_null().to_numpy()
                if not len(word):
                    continue
                doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(part.column(2).offsets.to_numpy()))[there]
                tf = part.column(3).flatten().to_numpy()[there].astype(np.float64)
                value = np.ones(len(tf)) if plain else tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / (avgdl or 1.0)))
                of_heavy = row_of[word] >= 0
                matrix = np.zeros((n, len(heavy)))
                matrix[doc[of_heavy], row_of[word[of_heavy]]] = value[of_heavy]
                # documents of one kind side by side, long ones first, in groups
                kind_of = (matrix @ kinds.T).argmax(axis=1)
                order = np.lexsort((-dl, kind_of))
                ends = np.cumsum(np.bincount(kind_of, minlength=len(kinds)))
                edges = sorted({*ends.tolist(), *(x for lo, hi in zip([0, *ends], ends, strict=False) for x in range(lo, hi, GROUP))})
                place = np.empty(n, np.int32)
                place[order] = np.arange(n, dtype=np.int32)
                names, matrix, doc = part.column(0).to_numpy(zero_copy_only=False)[order], matrix[order], place[doc]
                quick = matrix.astype(np.float32)
                # postings by group and word: where a word's begin, how many they are, what they are worth at most
                group = np.searchsorted(edges, np.arange(n), side="right").astype(np.int32)[doc] - 1
                sorted_by = np.argsort(group.astype(np.int64) * len(words) + word, kind="stable")
                word, doc, value, group = word[sorted_by], doc[sorted_by], value[sorted_by], group[sorted_by]
                from_group = np.searchsorted(group, np.arange(len(edges)))
                for g, (first, last) in enumerate(zip(edges, edges[1:], strict=False)):
                    mine = slice(from_group[g], from_group[g + 1])
                    if mine.start == mine.stop:
                        continue
                    held = np.bincount(word[mine], minlength=len(words)).astype(np.int32)
                    begin = (np.cumsum(held) - held + mine.start).astype(np.int32)
                    asked_for = np.flatnonzero(held)
                    top = np.zeros(len(words))
                    top[asked_for] = np.maximum.reduceat(value[mine], begin[asked_for] - mine.start)
                    # no document of the group can have more than this: queries that have better ones leave it out
                    most = np.bincount(owner, weighs * top[cols], minlength=n_queries) if always else np.full(n_queries, np.inf)
                    alive = np.flatnonzero(most >= np.maximum(best.worst - 1e-6, 1e-30))
                    for at in range(0, len(alive), step):
                        which = alive[at : at + step]
                        spot, row = runs(from_thin[which], from_thin[which + 1])
                        many = held[thin_cols[spot]]
                        met = np.flatnonzero(many)
                        spot, many, width = spot[met], many[met], last - first
                        here = np.repeat(begin[thin_cols[spot]] - (np.cumsum(many) - many).astype(np.int32), many) + np.arange(many.sum(), dtype=np.int32)
                        cell = np.repeat((row[met] * width - first).astype(np.int32), many)
                        cell += doc[here]
                        weight = np.repeat(thin_weighs[spot], many)
                        weight *= value[here]
                        rare = np.bincount(cell, weight, minlength=len(which) * width).astype(np.float64, copy=False).reshape(-1, width)
                        if not len(heavy):
                            row, col = best.close(which, rare, 1e-30 if always else np.bincount(cell, minlength=len(which) * width).reshape(-1, width) > 0, short[which])
                            best.add(names[first + col], which[row], rare[row, col])
                            continue
                        spot, row = runs(from_thick[which], from_thick[which + 1])
                        dense = np.zeros((len(which), len(heavy)))
                        dense[row, thick_rows[spot]] = thick_weighs[spot]
                        row, col = best.close(which, rare + dense.astype(np.float32) @ quick[first:last].T, 1e-30, short[which])
                        best.add(names[first + col], which[row], rare[row, col] + np.einsum("ij,ij->i", dense[row], matrix[first + col]))
        return best

    least = None
    if some is not None:
        n, tasks, shown = len(queries), terms.sparkSession.sparkContext.defaultParallelism, some.combine_chunks().to_batches()

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in b.column(0).to_pylist():
                    lo, hi = n * t // tasks, n * (t + 1) // tasks
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), pa.array(best_of(iter(shown), lo, hi).worst)], names=["query", "least"])

        known = terms.sparkSession.range(0, tasks, 1, tasks).mapInArrow(first, "query long, least double").toArrow()
        least = np.full(n, -np.inf)
        least[known.column("query").to_numpy()] = known.column("least").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from best_of(batches, 0, len(queries), least).batches(queries, doc_kind)

    # each task keeps k documents a query: few tasks, each with many documents
    read = terms.select("doc", "dl", "words", "counts").filter("doc is not null")
    return read.coalesce(2 * terms.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"i long, doc {kind}, score double")


class WordIndex:
    """The index of a table of texts, kept in a folder."""

    def __init__(self, spark: SparkSession, where: str, kind: str = "bigint", buckets: int = 64, words_of: Callable[[Column], Column] = tokens, plain: bool = False):
        self.spark, self.where, self.words_of, self.plain = spark, where.rstrip("/"), words_of, plain
        self.table = Buckets(spark, f"{self.where}/terms", ["doc"], f"doc {kind}, dl long, words array<string>, counts array<int>, text_hash long", buckets, most_folders=1)

    def refresh(self, docs: DataFrame, fingerprint: str, doc: str = "doc_id", text: str = "text") -> Words:
        """Brings the index up to date, and opens it. A fingerprint as stored: nothing is read. Else ids and hashes of texts are compared. Few
        changes: only texts that are new or not as stored are tokenised, and documents that are gone go. Many: the index is written anew, as
        the first one is, without a shuffle of texts or words. Doc ids are unique; of repeated ones one row stays."""
        if self.table.notes().get("fingerprint") != fingerprint:
            hashed = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")).filter("doc is not null")
            whole, gone = not self.table.version(), None
            if not whole:
                held = self.table.read(columns=["doc", "text_hash"]).select("doc", F.col("text_hash").alias("held"))
                unlike = hashed.select("doc", "text_hash").join(held, "doc", "full_outer").filter(~F.col("held").eqNullSafe(F.col("text_hash")))
                unlike = durable(unlike.select("doc", F.col("text_hash").isNull().alias("gone")))
                n = unlike.count()
                whole = n > MOST_PICKED or n > MANY * docs.count()
            if whole:
                hashed = gathered(hashed)
            else:
                gone = unlike.filter("gone").select("doc")
                hashed = hashed.join(F.broadcast(unlike.filter("not gone").select("doc")), "doc", "left_semi")
            new = word_counts(hashed.withColumn("doc", F.struct("doc", "text_hash")), "doc", "text", self.words_of).select("doc.doc", "dl", "words", "counts", "doc.text_hash")
            unique = hashed.groupBy("doc").count().filter("count > 1").isEmpty()
            # a whole table's words are several times its files: they are written where they were counted
            self.table.write(new if unique else new.dropDuplicates(["doc"]), gone, notes={"fingerprint": fingerprint}, whole=whole, in_place=whole and unique)
        return self.open()

    def open(self) -> Words:
        path = f"{self.where}/vocab/v={self.table.version()}"
        try:
            vocab = self.spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            vocabulary_of(self.table.read()).write.mode("overwrite").parquet(path)
            vocab = self.spark.read.parquet(path)
        return Words(self.table.read(), vocab, self.words_of, self.plain)


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a table's files; no text is read."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = m.agg(F.count("*"), F.sum(F.xxhash64(*m.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((path, *row)).encode()).hexdigest()
