"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids are taken in whole windows while it has as
many; the rest goes to the window it fits best. Where it fits none and no more may be opened, the fullest window is
filled up with the head of the piece and emitted, and the rest is placed again. At the end the partition's leftovers
are merged: their pieces are laid end to end and cut into full windows, and what is left over is cut into sequences
whose lengths are powers of two, which need no padding. Nothing is shuffled, and memory is bounded by the windows.

Edge cases: a null text is empty; every document has at least its end id. Empty tables give no rows. Repeated rows and
ties of doc_id are packed each. A very long text is encoded whole and cut into windows as it comes. Only doc_id and text
are read, so other columns cannot clash. The same split of the input gives the same result, whichever executor runs it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_and_text, table, texts_of
from .library_tokens import library_tokens

Piece = tuple  # (doc_id, start, ids, doc_tokens)


class Packer:
    """pieces() takes the placed pieces of the sequences emitted so far: (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, size: int = 2048, windows: int = 32):
        self.size, self.windows = size, windows
        self.open: list[list] = []  # [used, [Piece, ...]]
        self.done: list[tuple] = []
        self.sequences = 0

    def emit(self, pieces: list[Piece]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, ids, total, self.sequences, at))
            at += len(ids)
        self.sequences += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.size:
            self.emit([(doc_id, at, ids[at : at + self.size], total)])
            at += self.size
        while at < total:
            n = total - at
            fits = [w for w in self.open if self.size - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                self.open.append(best := [0, []])
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.size - best[0]
            best[1].append((doc_id, at, ids[at : at + n], total))
            best[0] += n
            at += n
            if best[0] == self.size:
                self.open.remove(best)
                self.emit(best[1])

    def finish(self) -> None:
        """Merges the leftovers of all open windows, the fullest first."""
        rest = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        left = sum(len(p[2]) for p in rest)
        self.open = []
        while left:
            size = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            pieces, need = [], size
            while need:
                doc_id, start, ids, total = rest.pop(0)
                if len(ids) > need:
                    rest.insert(0, (doc_id, start + need, ids[need:], total))
                    ids = ids[:need]
                pieces.append((doc_id, start, ids, total))
                need -= len(ids)
            self.emit(pieces)
            left -= size

    def take(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, path: str, size: int = 2048, windows: int = 32, end_id: int = 1) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    sequence_id: the partition's number in the upper bits, the sequence's number inside it in the lower 33."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = library_tokens(path), Packer(size, windows)
        first = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[pa.RecordBatch]:
            got = packer.take()
            if got:
                d, s, i, t, q, o = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((d, s, [len(x) for x in i], [x.astype("<u4").tobytes() for x in i], t, [first + x for x in q], o), OUT, strict=True)], schema=OUT)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode_many(texts_of(part)), strict=True):
                    packer.add(doc_id, np.append(ids, tokens.type.type(end_id)))
                yield from rows()
        packer.finish()
        yield from rows()

    return ids_and_text(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op2_packing": op2_packing}
