"""Document sources: binary files, uploads, decoded text, word-processor files, workbooks, parsed pages.

Parsers of binary formats run as mapInArrow over a binaryFile scan, a file at a time; what cannot be read goes to a
quarantine with its reason, and never ends the job. PDF and OCR engines are outside: a parser is passed in.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MOST_BYTES = 15 << 20
SUFFIXES = ("pdf", "docx", "txt", "md")
PAGES_READ = 40
HEADER_ROWS = 25
#: Headings that name the id column of a workbook.
ID_COLUMNS = ["is_number", "is_no", "is_num", "standard_id", "standard_no", "standard_number", "standard", "isnumber"]


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(filename, path, size, sha256, content): files of a folder with the hash of their bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return f.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select(F.col("filename").alias("source"), "sha256")


#: What the bytes 0x80 to 0x9F stand for in the Western single-byte set, where they stand for anything.
_WESTERN = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are that, UTF-16 where they have its byte-order mark (without one, any even number
    of bytes would pass for it), else the Western single-byte set, in which every byte has a meaning."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    return F.coalesce(F.when(marked, F.decode(content, "UTF-16")), utf8, F.translate(F.decode(content, "ISO-8859-1"), "".join(_WESTERN), "".join(_WESTERN.values())))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by a bar."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    body = root.find(f"{_W}body")
    out = [x for p in body.findall(f"{_W}p") if (x := said(p)).strip()]
    for row in body.iter(f"{_W}tr"):
        cells = [x for c in row.findall(f"{_W}tc") if (x := " ".join(said(p) for p in c.iter(f"{_W}p")).strip())]
        if cells:
            out.append(" | ".join(cells))
    return "\n".join(out)


def xlsx_rows(data: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number from 0, cells) of a workbook's sheets."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        for i, row in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_S}row")):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                at = 0
                for ch in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
            yield name, i, cells


def parsed_uploads(files: DataFrame, pdf_pages: Callable[[bytes, int], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """files: (filename, content). Gives (filename, suffix, text, characters) and the quarantine (filename, reason)."""
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    size = F.octet_length("content")
    early = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MOST_BYTES, "too large").when(~suffix.isin(*SUFFIXES), "unsupported type")
    f = files.select("filename", suffix.alias("suffix"), early.alias("reason"), "content")
    plain = f.filter("reason is null and suffix in ('txt', 'md')").select("filename", "suffix", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("reason"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"filename": [], "suffix": [], "text": [], "reason": []}
            for name, kind, data in zip(b.column("filename").to_pylist(), b.column("suffix").to_pylist(), b.column("content").to_pylist(), strict=True):
                text = reason = None
                try:
                    if kind == "docx":
                        text = docx_text(data)
                    elif pdf_pages is None:
                        reason = "no parser"
                    else:
                        text = "\n\n".join(p for p in pdf_pages(data, PAGES_READ) if p)
                except Exception as e:  # one file that a parser cannot read is one row of the quarantine
                    reason = f"unreadable: {type(e).__name__}"
                for k, v in zip(out, (name, kind, text, reason), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})

    read = f.filter("reason is null and suffix in ('pdf', 'docx')").select("filename", "suffix", "content").mapInArrow(run, "filename string, suffix string, text string, reason string")
    got = plain.unionByName(read).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    got = got.withColumn("reason", F.coalesce("reason", F.when(F.coalesce("text", F.lit("")) == "", F.lit("no text"))))
    bad = f.filter("reason is not null").select("filename", "reason").unionByName(got.filter("reason is not null").select("filename", "reason"))
    return got.filter("reason is null").select("filename", "suffix", "text", F.length("text").alias("characters")), bad


def page_table(pages: DataFrame, hindi: bool = False) -> DataFrame:
    """pages: (filename, page, text, ocr_text, legacy_font). Adds the cleaned text, method, counts and flags."""
    clean = T.strip_watermarks(F.col("text"))
    p = pages.withColumn("__c", clean).withColumn("__m", T.page_method(F.col("__c.text"), T.strip_watermarks(F.col("ocr_text"))["text"], F.col("legacy_font"), hindi))
    return p.select("filename", "page", F.col("__m.text").alias("text"), F.col("__m.method").alias("method"), F.length("__m.text").alias("chars"), F.col("__c.removed").alias("boilerplate_removed"), F.col("__m.legacy_font").alias("legacy_font"))


def pdf_summary(pages: DataFrame) -> DataFrame:
    g = pages.groupBy("filename").agg(F.count("*").alias("total_pages"), F.sum("chars").alias("total_chars"), F.count_if(F.col("method").startswith("ocr")).alias("ocr_pages"), F.count_if(F.col("method") == "empty").alias("empty_pages"), F.count_if("legacy_font").alias("legacy_font_pages"), F.sum("boilerplate_removed").alias("boilerplate_chars_removed"))
    return g.withColumn("chars_per_page", F.coalesce(F.round(F.try_divide("total_chars", "total_pages"), 1), F.lit(0.0)))


def file_warnings(report: DataFrame, low: int = 500) -> DataFrame:
    """report: pdf_summary with standard_id and chunks. Adds warnings."""
    w = F.array(
        F.when(F.col("standard_id").isNull(), F.lit("no catalogue entry")),
        F.when((F.col("chars_per_page") < low) & (F.col("total_pages") > 0), F.lit("low yield")),
        F.when(F.col("empty_pages") > 0, F.lit("empty pages")),
        F.when(F.col("legacy_font_pages") > 0, F.lit("legacy-font pages")),
        F.when(F.coalesce("chunks", F.lit(0)) == 0, F.lit("no chunks")),
    )
    return report.withColumn("warnings", F.array_compact(w))


# --- sheets ---------------------------------------------------------------------------------------------------


def sheet_rows(files: DataFrame) -> DataFrame:
    """(filename, sheet, row, cells) of workbooks (filename, content); a damaged workbook gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, data in zip(b.column("filename").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out += [(name, *r) for r in xlsx_rows(data)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            f, s, r, c = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"filename": pa.array(f, pa.string()), "sheet": pa.array(s, pa.string()), "row": pa.array(r, pa.int32()), "cells": pa.array(c, pa.list_(pa.string()))})

    return files.select("filename", "content").mapInArrow(run, "filename string, sheet string, row int, cells array<string>")


def sheet_layout(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, is_table, header_row): a table has a row of more than two filled cells; its header is the first best of the
    first HEADER_ROWS rows by known headings, label-like cells and filled cells; -1 without a row of two."""
    keys = keys or ["filename", "sheet"]
    clean = F.transform("cells", lambda c: T.squeeze(c))
    filled = F.size(F.filter("c", lambda x: x != ""))
    label = F.size(F.filter("c", lambda x: (x != "") & (F.length(x) <= 40) & ~x.rlike("^[0-9]+$")))
    known = F.size(F.filter("c", lambda x: T.column_key(x).isin(*ID_COLUMNS)))
    s = rows.withColumn("c", clean).withColumn("filled", filled).withColumn("score", F.when((F.col("row") < HEADER_ROWS) & (F.col("filled") >= 2), known * 100 + label * 2 + F.col("filled")))
    return s.groupBy(*keys).agg(F.coalesce(F.max(F.col("filled") > 2), F.lit(False)).alias("is_table"), F.coalesce(F.min_by("row", F.when(F.col("score") > 0, F.struct(-F.col("score"), F.col("row")))), F.lit(-1)).alias("header_row"))


def sheet_records(rows: DataFrame) -> DataFrame:
    """(filename, sheet, row, data map): one map a data row of tables, one a key/value sheet; unnamed and personal columns
    are dropped, values redacted, empty ones left out; of equal keys in a key/value sheet the first counts."""
    lay = sheet_layout(rows)
    j = rows.join(lay, ["filename", "sheet"])
    private = lambda k: k.rlike(T.PRIVATE_COLUMN)
    head = j.filter("is_table and row = header_row").select("filename", "sheet", F.transform("cells", lambda c: T.column_key(c)).alias("head"))
    body = j.filter("is_table and header_row >= 0 and row > header_row").join(head, ["filename", "sheet"])
    cells = F.filter(F.arrays_zip(F.col("head").alias("k"), F.transform("cells", lambda c: T.redact(T.squeeze(c))).alias("v")), lambda e: (F.coalesce(e["k"], F.lit("")) != "") & ~private(e["k"]) & (F.coalesce(e["v"], F.lit("")) != ""))
    table_ = body.select("filename", "sheet", "row", F.map_from_entries(F.aggregate(cells, F.filter(F.transform(cells, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))), lambda e: F.lit(False)), lambda a, e: F.concat(F.filter(a, lambda y: y["key"] != e["k"]), F.array(F.struct(e["k"].alias("key"), e["v"].alias("value")))))).alias("data"))
    two = F.filter(F.transform("cells", lambda c: T.squeeze(c)), lambda x: x != "")
    kv = j.filter("not is_table").withColumn("two", two).filter(F.size("two") >= 2).select("filename", "sheet", "row", T.column_key(F.regexp_replace(F.get("two", F.lit(0)), ":+$", "")).alias("k"), T.redact(F.get("two", F.lit(1))).alias("v")).filter((F.col("k") != "") & ~private(F.col("k")))
    first = kv.groupBy("filename", "sheet", "k").agg(F.min_by("v", "row").alias("v"))
    pairs = first.groupBy("filename", "sheet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("data"))
    return table_.unionByName(pairs.withColumn("row", F.lit(0)))


def standard_records(records: DataFrame) -> DataFrame:
    """Rows of `data` maps that have an id: standard_id, title, status, dates, edition, scope, source and excerpt."""
    get = lambda *ks: F.coalesce(*(F.nullif(F.col("data")[k], F.lit("")) for k in ks))
    sid = get(*ID_COLUMNS)
    out = records.withColumn("sid", sid).filter("sid is not null")
    return out.select(
        T.normalise_id(F.col("sid")).alias("standard_id"), F.coalesce(get("title", "subject"), T.squeeze(F.col("sid"))).alias("title"), F.coalesce(get("status"), F.lit("UNKNOWN")).alias("status"), get("last_amendment_date", "amendment_date").alias("last_amendment_date"),
        get("publication_date").alias("publication_date"), get("edition", "revision").alias("edition"), get("scope").alias("scope"), F.col("filename").alias("source_artifact"), F.substring(F.to_json("data"), 1, 5000).alias("raw_text_excerpt"),
    )


#: Labelled fields of a record kept as text.
IS_NUMBER = r"(?i)\bIS\s+[0-9]{1,6}(?:\s*\([^)]*\))?(?:\s*:\s*\d{4})?"
TEXT_FIELDS = {
    "title": r"(?i)(?:Title|Subject|Name)\s*[:\-]\s*(.{5,200}?)(?:\s{2,}|Status|Edition|Amendment|Publication|Scope|$)",
    "status": r"(?i)Status\s*[:\-]\s*([A-Za-z ]{2,40})",
    "last_amendment_date": r"(?i)(?:Last\s+)?Amendment(?:\s+Date)?\s*[:\-]\s*([0-9A-Za-z./ -]{4,30})",
    "publication_date": r"(?i)(?:Publication\s+Date|Published\s+on)\s*[:\-]\s*([0-9A-Za-z./ -]{4,30})",
    "edition": r"(?i)(?:Edition|Revision)\s*[:\-]\s*([A-Za-z0-9./ -]{1,40})",
    "scope": r"(?i)Scope\s*[:\-]\s*(.{10,500}?)(?:\s{2,}|Committee|Status|$)",
}


def text_record(text: Column, source: Column) -> Column:
    """A record of labelled text: the first id, or the file's stem; fields; warnings."""
    t = T.squeeze(text)
    sid = F.nullif(F.regexp_extract(t, IS_NUMBER, 0), F.lit(""))
    field = {k: F.nullif(T.squeeze(F.regexp_extract(t, p, 1)), F.lit("")) for k, p in TEXT_FIELDS.items()}
    name = F.coalesce(F.when(sid.isNotNull(), T.normalise_id(sid)), F.upper(F.regexp_replace(F.regexp_extract(source, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")))
    warn = F.array_compact(F.array(F.when(sid.isNull(), F.lit("No IS number found")), F.when(field["title"].isNull(), F.lit("Title not confidently extracted"))))
    return F.struct(name.alias("standard_id"), F.coalesce(field["title"], name).alias("title"), F.coalesce(field["status"], F.lit("UNKNOWN")).alias("status"), *(field[k].alias(k) for k in ("last_amendment_date", "publication_date", "edition", "scope")), source.alias("source_artifact"), F.substring(t, 1, 5000).alias("raw_text_excerpt"), warn.alias("extraction_warnings"))


def transcript_scores(segments: DataFrame) -> DataFrame:
    """(audio, segments): the mean of avg_logprob, the largest no_speech_prob and the number of segments."""
    return segments.groupBy("audio").agg(F.avg("avg_logprob").alias("avg_logprob"), F.max("no_speech_prob").alias("no_speech_prob"), F.count("*").alias("segments"))
