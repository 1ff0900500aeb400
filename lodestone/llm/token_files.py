"""Token-id files: flat unsigned integers with 64-bit document offsets, written in order and read by memory map.

Documents are dealt by ranges, so that shard files follow one another in ascending order of doc_id. The ranges also go
by the text's beginning and by a number of the row, so that neither a doc_id nor a text that many rows share fills one
task. Each task sorts its range, and streams three files to the shared folder: .ids (unsigned 16- or 32-bit, as the
vocabulary needs), .off (unsigned 64-bit offsets, one more than documents) and .doc (the doc_ids). Its one manifest row
(counts and the file's name) goes to the driver; bases are prefix sums over as many rows as there are shards. File names
are unique to an attempt and only those of the manifest are read, so a task that runs twice, or is lost, does no harm;
what it left is deleted once the manifest is complete. TokenFiles.delete() removes a set that is no longer needed.

Edge cases: a null text is empty (its end id only); a null doc_id comes first. Ties of doc_id are ordered by the first
16 characters of their text, and stay apart; repeated rows are written each. An empty table writes no shards. Very long
texts are written whole. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, ids_and_text, table, texts_of
from .library_tokens import library_tokens

MANIFEST = "shard int, name string, kind string, n_docs long, n_null long, n_tokens long"


def _open(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where if "://" in where else f"file://{where}")


class Stored:
    """A file of the shared folder as an array: a memory map where the folder is mounted, else slices read from the store."""

    def __init__(self, where: str, kind: str):
        files, path = _open(where)
        self.kind, self.mapped, self.file = np.dtype(kind), None, None
        if files.get_file_info(path).size == 0:
            self.mapped = np.zeros(0, kind)
        elif files.type_name == "local":
            self.mapped = np.memmap(path, kind, "r")
        else:
            self.file = files.open_input_file(path)

    def __getitem__(self, cut: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[cut]
        return np.frombuffer(self.file.read_at((cut.stop - cut.start) * self.kind.itemsize, cut.start * self.kind.itemsize), self.kind)


@dataclass
class TokenFiles:
    """A written set: its folder and one (shard, name, kind, n_docs, n_null, n_tokens, base) a shard, in order."""

    where: str
    shards: list[tuple]

    def delete(self) -> None:
        files, folder = _open(self.where)
        if files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir(folder)

    def drop_leftovers(self) -> None:
        """Deletes files that the manifest does not name: those of attempts that failed or ran twice."""
        files, folder = _open(self.where)
        names = {r[1] for r in self.shards}
        for x in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if x.type == pafs.FileType.File and x.base_name.split(".")[0] not in names:
                files.delete_file(x.path)


def write(docs: DataFrame, path: str, where: str, end_id: int = 1) -> TokenFiles:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = library_tokens(path)
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        n_docs = n_null = n_tokens = 0
        out: list = []
        try:
            for b in batches:
                for k in range(0, b.num_rows, 512):
                    part = b.slice(k, 512)
                    ids = [np.append(x, tokens.type.type(end_id)) for x in tokens.encode_many(texts_of(part))]
                    ends = n_tokens + np.cumsum([len(x) for x in ids])
                    if not out:
                        files, folder = _open(where)
                        files.create_dir(folder)
                        out = [files.open_output_stream(f"{folder}/{name}.{x}") for x in ("ids", "off", "doc")]
                        out[1].write(np.zeros(1, "<u8").tobytes())
                    doc = part.column(0)
                    out[0].write(np.concatenate(ids).tobytes())
                    out[1].write(ends.astype("<u8").tobytes())
                    out[2].write(np.array([x or 0 for x in doc.to_pylist()], "<i8").tobytes())
                    n_docs, n_null, n_tokens = n_docs + part.num_rows, n_null + doc.null_count, int(ends[-1])
        finally:
            for x in out:
                x.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "kind": [tokens.type.str], "n_docs": [n_docs], "n_null": [n_null], "n_tokens": [n_tokens]})

    keys = ["doc_id", "head", "row"]
    numbered = ids_and_text(docs).withColumns({"head": F.substring("text", 1, 16), "row": F.monotonically_increasing_id()})
    dealt = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows = sorted(tuple(r) for r in dealt.mapInArrow(run, MANIFEST).collect())
    bases = np.cumsum([0, *(r[5] for r in rows)]).tolist()
    done = TokenFiles(where, [(*r, base) for r, base in zip(rows, bases, strict=False)])
    done.drop_leftovers()
    return done


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), from the files."""
    where = files.where

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, off, doc = (Stored(f"{where}/{r['name']}.{x}", k) for x, k in (("ids", r["kind"]), ("off", "<u8"), ("doc", "<i8")))
                for k in range(0, r["n_docs"], 512):
                    end = min(k + 512, r["n_docs"])
                    at = off[k : end + 1].astype(np.int64).tolist()
                    found = [None if k + i < r["n_null"] else x for i, x in enumerate(doc[k:end].tolist())]
                    block, cuts = ids[at[0] : at[-1]].astype("<u4"), list(zip(at[:-1], at[1:], strict=True))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found, pa.int64()), "start": [r["base"] + x for x, _ in cuts], "n_tokens": [y - x for x, y in cuts], "ids": [block[x - at[0] : y - at[0]].tobytes() for x, y in cuts]})

    shards = spark.createDataFrame(files.shards, MANIFEST + ", base long").repartition(max(1, len(files.shards)))
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), fresh_dir(spark, "token-files"))
    return read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op8_token_files": op8_token_files}
