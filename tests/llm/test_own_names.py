"""Columns of a caller that have the names an operator uses for itself."""

from pyspark.sql import functions as F

from lodestone.llm import chat_format, url_filter

OWN = ["__record", "__parts", "__v", "__rest", "__u", "__r", "__shard", "__w0", "__w1", "__listed", "c0", "c1"]


def mine(df):
    return df.count() > 0 and all(all(r[n] == f"mine {n}" for n in OWN) for r in df.collect())


def test_chat_records_keep_all_columns(spark):
    extra = [F.lit(f"mine {n}").alias(n) for n in OWN]
    df = spark.createDataFrame([('{"instruction": "a", "output": "b"}',)], "record string").select("*", *extra)
    out = chat_format.format_turns(chat_format.canonical_turns(df))
    assert mine(out) and out.first().layout == "instruction"


def test_judged_urls_keep_all_columns(spark):
    extra = [F.lit(f"mine {n}").alias(n) for n in OWN]
    df = spark.createDataFrame([(i, f"http://h{i}.example/p?x") for i in range(50)] + [(99, None)], "page_id long, url string").select("*", *extra)
    listed = F.col("key").rlike("[02468][.]")
    rows = lambda x: {(r.page_id, r.host, r.path, r.listed) for r in x.collect()}
    a, b = (url_filter.judge_urls(df, listed, url_filter.RULES, max_filter_bytes=n) for n in (4 << 20, 8))
    assert mine(a) and mine(b) and rows(a) == rows(b) and (4, "h4.example", "/p", True) in rows(a)
