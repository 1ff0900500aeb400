"""Helpers that several operators share: the shared folder, checkpoints, Arrow mapping and word splitting."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stored import durable, shared_dir

__all__ = ["durable", "shared_dir"]

#: Capitals up to ɏ whose small letters come after it, and so would not be letters to the rules below.
_LOWERED_BEYOND = "ƁƆƉƊƏƐƓƔƖƗƜƝƟƦƩƮƱƲƷȺȾɄɅ"

#: Characters on which Python's `re` and `str.lower` agree with the tokenizers library; other texts go to the library whole.
UNSAFE = re.compile(r"[^\t\n\r\x20-\x7e¡¿À-į" + "".join(c for c in map(chr, range(ord("ı"), ord("ɏ") + 1)) if c not in _LOWERED_BEYOND) + "]")

#: The letters among the other characters, and the rules below on them alone: explicit ranges are matched fastest.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Byte-level pre-split (a word takes the space before it) for texts without UNSAFE characters.
BYTE_SPLIT = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")

#: Pre-split into words, single digits and runs of marks, for lower-cased texts without UNSAFE characters.
WORD_SPLIT = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_L}]+")


#: The pre-split rules of tokenizer files that the patterns above stand for.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
BYTE_RULE = (None, {**_BYTE_LEVEL, "use_regex": True})
WORD_RULE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {**_BYTE_LEVEL, "use_regex": False}],
    },
)


def rule_of(spec: dict) -> str | None:
    """"bytes" or "words" where a tokenizer file (its JSON) splits as BYTE_SPLIT or WORD_SPLIT does, None for any other."""
    rule = (spec.get("normalizer"), spec.get("pre_tokenizer"))
    return "bytes" if rule == BYTE_RULE else "words" if rule == WORD_RULE else None


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = 512) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows; `make` runs once in a task and returns the function of a slice."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                got = f(b.slice(k, rows))
                yield pa.RecordBatch.from_arrays([got[x.name] if isinstance(got[x.name], pa.Array) else pa.array(got[x.name], x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def add_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: str, rows: int = 512, prefix: str = "") -> DataFrame:
    """As map_batches, but every column of df stays and `added` come after them, their names after `prefix`. A column of
    df with one of those names (in any case) is replaced; callers that must keep theirs pass a prefix."""
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    new = StructType.fromDDL(added)
    taken = {(prefix + n).lower() for n in new.fieldNames()}
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    out, names = to_arrow_schema(new), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for k in range(0, b.num_rows, rows):
                part = b.slice(k, rows)
                got = f(pa.RecordBatch.from_arrays(part.columns, names=names))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i, _ in kept), *(pa.array(got[x.name], x.type) for x in out)], names=[f"c{i}" for i in range(len(kept) + len(out))])

    # plain names on the way through, as Python maps take no others
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate([*(f for _, f in kept), *new.fields])])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, plain).toDF(*(f.name for _, f in kept), *(prefix + n for n in new.fieldNames()))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; a lambda's body would work out again whatever expression it holds."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of bigint what `fold` (associative, 0 its neutral value: sums, maxima of positive
    numbers) makes of all elements before it. Folded inside blocks, then over them, as a fold that grows an array copies it at each step."""
    block = 128

    def scan(xs: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, first, lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def blocks(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / block).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: scan(F.slice(v, i * block + 1, F.lit(block))))

    def joined(s: Column, tops: Column) -> Column:
        return F.flatten(F.zip_with(s, tops, lambda x, t: F.transform(x["out"], lambda y: fold(t, y))))

    return let(values, lambda v: let(blocks(v), lambda s: let(scan(F.transform(s, lambda x: x["at"]))["out"], lambda tops: joined(s, tops))))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a slice; null: empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def ids_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; further columns cannot clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
