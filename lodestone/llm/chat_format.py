"""Chat formatting by schema fingerprints (native: DataFrame functions only).

A record of any layout, as a struct or as JSON text, has a set of nested field paths. Those that some mapping names are
hashed, and the hash selects the declarative mapping that turns the layout into canonical turns (role, text); other
fields are passed over, and the elements of an array are merged. A struct's paths come from its schema. A JSON text's
come from its skeleton, in which every scalar is an empty string; Spark's variant and its size limit are not used. A
template then marks the turns, escaping inside texts every character that a control string can begin with, so that
formatting can be undone exactly.

Edge cases: a null text or role counts as empty. A record that fits no mapping, fits two, has a nested value where a
text should be, is malformed or null gets null turns and a null layout (it stays, flagged). A conversation's turns are
ordered by turn, then role, then text (nulls first); repeated rows stay, ties are equal rows; an empty table gives no
rows. A conversation or record is one row, so it is bounded by what a row may hold (2 GB); beyond that Spark fails, and
nothing is cut or nulled. Work is linear in the number of turns and characters. Only the named columns are read, so
others cannot clash; layout, fingerprint, turns, formatted and loss_spans replace columns of the same names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions.names import unused
from .common import let, running, table

TURNS = "array<struct<role:string,text:string>>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


@dataclass(frozen=True)
class Fixed:
    """One turn for each role, in order, of one field's text or of several, the empty ones left out, on lines of their own."""

    name: str
    texts: dict[str, tuple[str, ...]]

    def paths(self) -> set[str]:
        return {f for fields in self.texts.values() for f in fields}

    def turns(self, v: Column) -> Column:
        said = lambda fields: v[fields[0]] if len(fields) == 1 else F.concat_ws("\n", *(F.nullif(v[f], F.lit("")) for f in fields))
        return F.array(*(_turn(F.lit(role), said(fields)) for role, fields in self.texts.items()))


@dataclass(frozen=True)
class Messages:
    """A turn for each element of an array, after one of the field `system` where that is named; roles may be renamed."""

    name: str
    array: str
    role: str
    text: str
    renamed: dict[str, str] = field(default_factory=dict)
    system: str | None = None

    def paths(self) -> set[str]:
        return {f"{self.array}[]", f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"} | ({self.system} if self.system else set())

    def turns(self, v: Column) -> Column:
        def one(x: Column) -> Column:
            role = x[self.role]
            for a, b in self.renamed.items():
                role = F.when(x[self.role] == a, F.lit(b)).otherwise(role)
            return _turn(role, x[self.text])

        every = F.transform(v[self.array], one)
        return F.concat(F.array(_turn(F.lit("system"), v[self.system])), every) if self.system else every


@dataclass(frozen=True)
class NoMessages:
    """An array without elements: no turns."""

    name: str
    array: str

    def paths(self) -> set[str]:
        return {f"{self.array}[]"}

    def turns(self, v: Column) -> Column:
        return F.array().cast(TURNS)


Mapping = Fixed | Messages | NoMessages
SHARED_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
MAPPINGS: list[Mapping] = [
    Messages("messages", "messages", "role", "content"),
    NoMessages("messages_empty", "messages"),
    Messages("conversations", "conversations", "from", "value", SHARED_ROLES),
    Messages("system_conversations", "conversations", "from", "value", SHARED_ROLES, "system"),
    Messages("turns", "turns", "speaker", "text", SHARED_ROLES),
    Fixed("prompt_response", {"user": ("prompt",), "assistant": ("response",)}),
    Fixed("prompt_completion", {"user": ("prompt",), "assistant": ("completion",)}),
    Fixed("instruction", {"user": ("instruction",), "assistant": ("output",)}),
    Fixed("instruction_input", {"user": ("instruction", "input"), "assistant": ("output",)}),
    Fixed("question", {"user": ("question",), "assistant": ("answer",)}),
    Fixed("system_question", {"system": ("system",), "user": ("question",), "assistant": ("answer",)}),
]


def hash_of(paths: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()


def _known(mappings: list[Mapping]) -> list[str]:
    return sorted({p for m in mappings for p in m.paths()})


def paths_of_type(t: DataType, known: list[str]) -> set[str]:
    """The nested field paths of a struct type, those known."""
    out = set()
    for f in t.fields if isinstance(t, StructType) else ():
        if isinstance(f.dataType, ArrayType):
            out.add(f"{f.name}[]")
            if isinstance(f.dataType.elementType, StructType):
                out |= {f"{f.name}[].{x.name}" for x in f.dataType.elementType.fields}
        else:
            out.add(f.name)
    return out & set(known)


def _ddl(known: list[str]) -> str:
    """One schema with all known paths, scalars as strings."""
    arrays = {p.split("[]")[0]: [q.split("[].")[1] for q in known if q.startswith(p.split("[]")[0] + "[].")] for p in known if "[]" in p}
    fields = [f"`{p}` string" for p in known if "[]" not in p] + [f"`{a}` array<struct<{', '.join(f'`{x}`: string' for x in xs)}>>" for a, xs in arrays.items()]
    return ", ".join(fields)


_SCALAR = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:\s*+)|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s{}\[\],:"]++'
_LARGE = {"maxStringLen": str((1 << 31) - 1)}


def skeleton(json: Column) -> Column:
    """A JSON text with every scalar made an empty string: its names and nesting alone. Marks are characters that JSON
    texts hold escaped only, so no name or text can hold one."""
    marked = F.regexp_replace(json, _SCALAR, "$1\u0001")  # a name is followed by one mark, and by two where its value is a scalar
    out = F.replace(marked, F.lit("\u0001\u0001"), F.lit('""'))
    for opening in "{[":
        out = F.replace(out, F.lit("\u0001" + opening), F.lit(opening))
    return F.replace(out, F.lit("\u0001"), F.lit('""'))


def paths_of_json(json: Column, known: list[str]) -> Column:
    """The known paths of a JSON text, sorted, joined by commas; a path whose value is nested in any element gets a mark."""

    def some(s: Column, array: str, name: str, plain: bool) -> Column:
        return F.exists(s[array], lambda x: (x[name] == "") if plain else (x[name] != ""))

    def found(s: Column) -> Column:
        out = []
        for p in known:
            array, listed, inner = p.partition("[]")
            if not listed:
                out += [F.when(s[p] == "", F.lit(p)), F.when(s[p] != "", F.lit(p + "{}"))]
            elif not inner:
                out.append(F.when(s[array].isNotNull(), F.lit(p)))
            else:
                out += [F.when(some(s, array, inner[1:], True), F.lit(p)), F.when(some(s, array, inner[1:], False), F.lit(p + "{}"))]
        return F.concat_ws(",", *out)

    return let(F.from_json(skeleton(json), _ddl(known), _LARGE), found)


def canonical_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Adds fingerprint, layout and turns to records, a column of structs or of JSON texts."""
    known, by_hash = _known(mappings), {hash_of(m.paths()): m for m in mappings}
    kind = records.schema[record].dataType
    if isinstance(kind, StructType):
        print_ = hash_of(paths_of_type(kind, known))
        m, there = by_hash.get(print_), F.col(record).isNotNull()
        turns = m.turns(F.col(record)) if m else F.lit(None)
        return records.withColumns({"fingerprint": F.when(there, F.lit(print_)), "layout": F.when(there, F.lit(m.name if m else None)), "turns": F.when(there, turns).cast(TURNS)})
    json = F.col(record)
    df = records.withColumn("fingerprint", F.when(json.isNotNull(), F.sha2(paths_of_json(json, known), 256)))
    own = unused(df, "__record")[0]
    df = df.withColumn(own, F.from_json(json, _ddl(known) + ", _corrupt_record string", _LARGE))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for print_, m in by_hash.items():
        hit = (F.col("fingerprint") == print_) & F.col(f"{own}._corrupt_record").isNull()
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, m.turns(F.col(own)).cast(TURNS)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns).drop(own)


@dataclass(frozen=True)
class Template:
    """begin + role + newline + text + end. Every control string begins with one of the escaped characters."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
    role_escapes: tuple[tuple[str, str], ...] = (("\n", "&#10;"),)

    def escape(self, c: Column, role: bool = False) -> Column:
        for a, b in self.escapes + (self.role_escapes if role else ()):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def unescape(self, c: Column, role: bool = False) -> Column:
        for a, b in reversed(self.escapes + (self.role_escapes if role else ())):
            c = F.replace(c, F.lit(b), F.lit(a))
        return c


def format_turns(df: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds formatted (the text), and loss_spans: array of (start, length, byte_start, bytes) of the trained texts, in code
    points and in bytes of UTF-8."""
    t = template
    head = lambda x: F.concat(F.lit(t.begin), t.escape(F.coalesce(x["role"], F.lit("")), True), F.lit("\n"))
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), t.escape(F.coalesce(x["text"], F.lit(""))).alias("body"), F.coalesce(x["role"].isin(*t.trained), F.lit(False)).alias("trained")))

    def starts(parts: Column, size) -> Column:
        whole = F.transform(parts, lambda p: (size(p["head"]) + size(p["body"]) + size(F.lit(t.end))).cast("long"))
        return running(whole, lambda a, b: a + b)

    def spans(parts: Column) -> Column:
        at = F.zip_with(starts(parts, F.length), starts(parts, F.octet_length), lambda c, b: F.struct(c.alias("c"), b.alias("b")))

        def span(p: Column, x: Column) -> Column:
            return F.struct((x["c"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length"), (x["b"] + F.octet_length(p["head"])).alias("byte_start"), F.octet_length(p["body"]).cast("long").alias("bytes"))

        return F.array_compact(F.zip_with(parts, at, lambda p, x: F.when(p["trained"], span(p, x))))

    own = unused(df, "__parts")[0]
    df = df.withColumn(own, parts)
    df = df.withColumn("formatted", F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(t.end))), ""))
    return df.withColumn("loss_spans", let(F.col(own), spans)).drop(own)


def parse_formatted(formatted: Column, template: Template = Template()) -> Column:
    """The turns read back from the formatted text."""
    t = template
    quoted = "\\Q" + t.end + "\\E"
    body = F.filter(F.split(formatted, quoted, -1), lambda x: x.startswith(t.begin))
    cut = len(t.begin)
    return F.transform(body, lambda x: F.struct(t.unescape(F.substring_index(x, "\n", 1).substr(F.lit(cut + 1), F.length(x)), True).alias("role"), t.unescape(x.substr(F.locate("\n", x) + 1, F.length(x))).alias("text")))


def loss_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped. Cut by bytes, as a cut by code points reads from the beginning each time."""
    cut = lambda b, s: F.substring(b, (s["byte_start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")
    return let(formatted.cast("binary"), lambda b: F.array_join(F.transform(spans, lambda s: template.unescape(cut(b, s))), ""))


def records_from_rows(rows: DataFrame) -> DataFrame:
    """One record a conversation from rows by turn: conv_id, and record, a struct in the messages layout. The exchange is
    by conversation, and each task sorts its own."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), x["content"].alias("content")))
    return got.select("conv_id", F.struct(messages.alias("messages")).alias("record"))


CONTROL = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_json(F.struct(F.lit(CONTROL).alias("instruction"), F.lit(CONTROL).alias("output"))).alias("record"))
    turns = canonical_turns(records_from_rows(rows)).drop("record").unionByName(canonical_turns(extra).drop("record"))
    out = format_turns(turns).drop("turns")
    back = out.withColumn("back", parse_formatted(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout", "fingerprint")


SQL = {
    "op1_chat_format": f"""
WITH t AS (SELECT conv_id, turn, role AS r0, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', 'assistant', '{CONTROL}')
SELECT conv_id, COUNT(*) AS n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, text)) AS turns_sha256,
CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(SUM(12 + 1 + 11 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))) AS BIGINT) AS formatted_chars,
CASE WHEN conv_id = -1 THEN 'instruction' ELSE 'messages' END AS layout, sha256(CASE WHEN conv_id = -1 THEN 'instruction,output' ELSE 'messages[],messages[].content,messages[].role' END) AS fingerprint
FROM t GROUP BY conv_id
"""
}
QUERIES = {"op1_chat_format": op1_chat_format}
