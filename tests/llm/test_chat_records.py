"""Chat records: what selects a mapping, large records, and clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat_format as C
from lodestone.llm.common import let, running


def layouts(spark, records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "i int, record string").withColumn("layout", F.lit("clash"))
    return [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in C.canonical_turns(df).orderBy("i").collect()]


def test_other_fields_are_passed_over_and_elements_merged(spark):
    odd = 'a "quoted\\" : [text] {with: marks}, null, 1.5 \\u0001'
    got = layouts(
        spark,
        [
            {"id": 7, "messages": [{"role": "user", "content": odd, "name": "n"}, {"role": "assistant", "content": None}, {"role": "tool"}], "meta": {"messages": [1], "prompt": "x"}},
            {"prompt": odd, "response": 5, "tags": ["a", {"b": None}]},
            {"prompt": "a", "response": "b", "completion": "c"},
            {"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}, {"role": "user", "content": "y"}]},
            {"system": "s", "conversations": [{"from": "human", "value": "q"}]},
            '{"prompt": "a", "response": b}',
            '{"prompt": "a", "response": "b"',
            "[]",
            "null",
            "",
            None,
            '  { "question" :\n "q" ,"answer":true }',
        ],
    )
    assert got[0] == ("messages", [("user", odd), ("assistant", ""), ("tool", "")])
    assert got[1] == ("prompt_response", [("user", odd), ("assistant", "5")])
    assert got[4] == ("system_conversations", [("system", "s"), ("user", "q")])
    assert got[11] == ("question", [("user", "q"), ("assistant", "true")])
    assert [got[i] for i in (2, 3, 5, 6, 7, 8, 9, 10)] == [(None, None)] * 8


def test_structs_are_mapped_by_their_schema(spark):
    df = spark.createDataFrame([(1, ("a", "b", 3)), (2, None)], "i int, record struct<instruction:string,output:string,rating:int>")
    got = {r.i: r for r in C.canonical_turns(df).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "a"), ("assistant", "b")] and got[1].fingerprint == C.hash_of({"instruction", "output"})
    assert got[2].turns is None and got[2].layout is None
    assert C.canonical_turns(spark.createDataFrame([((1,),)], "record struct<x:int>")).first().layout is None


@pytest.mark.parametrize("as_json", [True, False])
def test_a_text_of_twenty_million_characters(spark, as_json):
    n = 20_000_001
    text = F.concat(F.repeat(F.lit("é"), F.lit(n - 1)), F.lit("<"))
    record = F.struct(F.lit("x").alias("instruction"), text.alias("output"))
    df = spark.range(1).select((F.to_json(record) if as_json else record).alias("record"))
    out = C.format_turns(C.canonical_turns(df))
    got = out.select(F.sha2(C.loss_text(F.col("formatted"), F.col("loss_spans")), 256) == F.sha2(text, 256), F.length(C.parse_formatted(F.col("formatted"))[1]["text"]), "layout").first()
    assert tuple(got) == (True, n, "instruction")


def test_many_turns_of_one_conversation(spark):
    """200,000 turns in one record: would take hours if the work grew with their square."""
    n = 200_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("tür & "), "id").alias("text"))
    out = C.format_turns(C.canonical_turns(C.records_from_rows(rows)))
    got = out.select(F.size("loss_spans"), F.sha2(C.loss_text(F.col("formatted"), F.col("loss_spans")), 256).alias("loss"), F.size(C.parse_formatted(F.col("formatted"))), F.col("loss_spans")[n // 2 - 1].alias("last"), F.length("formatted").alias("length")).first()
    import hashlib

    assert got[0] == n // 2 and got[2] == n and got.loss == hashlib.sha256("".join(f"tür & {i}" for i in range(1, n, 2)).encode()).hexdigest()
    assert got.last.start + got.last.length + len(C.Template().end) == got.length


def test_running_folds(spark):
    xs = [[], [5], list(range(1000)), [3, 1, 2] * 129]
    df = spark.createDataFrame([(x,) for x in xs], "x array<bigint>")
    for r in df.select("x", running(F.col("x"), lambda a, b: a + b).alias("s"), running(F.col("x"), F.greatest).alias("m"), let(F.size("x"), lambda n: n + n).alias("d")).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max([0, *r.x[:i]]) for i in range(len(r.x))] and r.d == 2 * len(r.x)
