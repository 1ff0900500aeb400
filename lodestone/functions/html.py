"""HTML as tokens: one scan cuts a page into comments, raw elements, tags and texts, and folds over them follow the open elements.

A closing tag closes the last open element of its name and all within; one without such an element is passed over; elements that
have no content open nothing. Entities are not resolved; texts of scripts and styles, and comments, are no texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------
DROPPED = ["script", "style", "noscript", "iframe"]
VOLATILE, VOLATILE_PARTS = ["style", "onclick", "onload", "onchange", "nonce"], "csrf|token|session"
VOLATILE_TEXT = r"(?i)\b(?:csrf|session|token|timestamp|time)\s*[=:]\s*[\w./+-]+"
FURNITURE = ["nav", "footer", "header"]
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
HEADING, LINK, LEVELS = (2, 90), (3, 220), 6
# ----------------------------------------------------------------------------------------------------------------

_ATTRIBUTE = r"""\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*))?"""


def token_pattern(raw: Sequence[str]) -> str:
    """Comments and declarations; `raw` elements with all within; tags, whose attributes may hold anything between quotes; texts."""
    whole = "|".join(rf"<{n}\b.*?</{n}\s*>" for n in raw)
    return rf"""(?is)<!--.*?-->|<[!?][^>]*>|{whole}|</?[a-z](?:[^>"']+|"[^"]*"|'[^']*')*>|</?[a-z][^>]*>|[^<]+|<"""


def let(value: Column, f) -> Column:
    """f of a value that is worked out once; a lambda's body would work out again whatever expression it holds."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens(html: Column, raw: Sequence[str] = DROPPED) -> Column:
    """array of (kind, name, said): kind is comment, raw, open, void, close or text; name a tag's, in small letters."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(token_pattern(raw)), F.lit(0))

    def one(x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][^\s/>]*)", 1))
        kind = (
            F.when(x.rlike(r"^<[!?]"), "comment")
            .when(name == "", "text")
            .when(name.isin(*raw) & x.rlike(r"(?s)>.*</"), "raw")
            .when(x.startswith("</"), "close")
            .when(name.isin(*VOID) | x.endswith("/>"), "void")
            .otherwise("open")
        )
        return F.struct(kind.alias("kind"), name.alias("name"), x.alias("said"))

    return F.transform(found, one)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, whatever its quotes; null where the tag has none."""
    found = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^\s+([^\s=]+)", 1)) == name)
    value = F.regexp_extract(F.get(found, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1)
    return F.when(F.size(found) > 0, F.regexp_replace(value, r"""(?s)^(["'])(.*)["']$""", "$2"))


def stable_tag(tag: Column) -> Column:
    """A tag without the attributes that change from visit to visit."""
    name = lambda a: F.lower(F.regexp_extract(a, r"^\s+([^\s=]+)", 1))
    kept = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: ~name(a).isin(*VOLATILE) & ~name(a).rlike(VOLATILE_PARTS))
    return F.concat(F.regexp_extract(tag, r"^</?[A-Za-z][^\s/>]*", 0), F.array_join(kept, ""), F.when(tag.endswith("/>"), "/>").otherwise(">"))


def stable(html: Column) -> Column:
    """The page without dropped elements, volatile attributes, and volatile marks in texts that are all an element holds; white space squeezed.
    Other texts stay as they are, whatever they say."""

    def cleaned(ts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before, after = F.get(ts, i - 1), F.get(ts, i + 1)
            alone = F.coalesce((before["kind"] == "open") & (after["kind"] == "close") & (before["name"] == after["name"]), F.lit(False))
            return F.when(x["kind"] == "raw", "").when(x["kind"].isin("open", "void"), stable_tag(x["said"])).when((x["kind"] == "text") & alone, F.regexp_replace(x["said"], VOLATILE_TEXT, "")).otherwise(x["said"])

        return F.array_join(F.transform(ts, one), "")

    return F.trim(F.regexp_replace(let(tokens(html), cleaned), r"\s+", " "))


def search_links(html: Column) -> Column:
    """array of (text, href, heading): the links to a search, and the heading of each: the last text before it of a heading's length that is in no
    link, and is within its LEVELS nearest enclosing elements. Navigation, headers and footers are passed over."""
    none = F.lit(None).cast("string")
    # open elements; the link at hand: how many are around it, its address, heading and text; the last heading, and the fewest open since
    names = F.array().cast("array<string>")
    out = F.array().cast("array<struct<text:string,href:string,heading:string>>")
    first = F.struct(names.alias("open"), F.lit(-1).alias("link"), none.alias("href"), none.alias("above"), F.lit("").alias("said"), none.alias("heading"), F.lit(0).alias("least"), out.alias("out"))

    def with_link(a: Column, ends: Column) -> Column:
        """The links so far, with the one at hand where it ends and is one to a search."""
        told, href = F.trim(a["said"]), F.coalesce(a["href"], F.lit(""))
        good = href.contains("/search") & ~F.regexp_replace(href, "/+$", "").isin("/search", "search") & (F.length(told) > LINK[0]) & (F.length(told) < LINK[1])
        return F.when(ends & good, F.concat(a["out"], F.array(F.struct(told.alias("text"), href.alias("href"), a["above"].alias("heading"))))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        hidden = F.exists(a["open"], lambda n: n.isin(*FURNITURE))
        at = F.when(x["kind"] == "close", F.size(a["open"]) - F.array_position(F.reverse(a["open"]), x["name"])).otherwise(-1)
        shut = F.array_contains(a["open"], x["name"]) & (x["kind"] == "close")
        opened = F.when(x["kind"] == "open", F.concat(a["open"], F.array(x["name"]))).when(shut, F.slice(a["open"], F.lit(1), at.cast("int"))).otherwise(a["open"])
        begins = (x["kind"] == "open") & (x["name"] == "a") & (a["link"] < 0) & ~hidden
        ends = shut & (a["link"] >= 0) & (at <= a["link"])
        text = F.trim(F.regexp_replace(x["said"], r"\s+", " "))
        heads = (x["kind"] == "text") & (a["link"] < 0) & ~hidden & ~F.array_contains(a["open"], "a") & (F.length(text) > HEADING[0]) & (F.length(text) < HEADING[1])
        return F.struct(
            opened.alias("open"),
            F.when(begins, F.size(a["open"])).when(ends, -1).otherwise(a["link"]).alias("link"),
            F.when(begins, F.trim(attribute(x["said"], "href"))).otherwise(a["href"]).alias("href"),
            F.when(begins, F.when(a["least"] >= F.size(a["open"]) - (LEVELS - 1), a["heading"])).otherwise(a["above"]).alias("above"),
            F.when(begins, F.lit("")).when((x["kind"] == "text") & (a["link"] >= 0), F.concat(a["said"], F.lit(" "), text)).otherwise(a["said"]).alias("said"),
            F.when(heads, text).otherwise(a["heading"]).alias("heading"),
            F.when(heads, F.size(a["open"])).when(shut, F.least(a["least"], at.cast("int"))).otherwise(a["least"]).alias("least"),
            with_link(a, ends).alias("out"),
        )

    return F.aggregate(tokens(html), first, step, lambda a: with_link(a, a["link"] >= 0))


def named_in_attributes(html: Column, keys: Sequence[str], wanted) -> Column:
    """array of (text, href): of each tag the first attribute of `keys` whose trimmed value is `wanted`."""
    tags = F.filter(tokens(html), lambda x: x["kind"].isin("open", "void"))
    found = F.transform(tags, lambda x: F.struct(F.get(F.filter(F.array(*(F.trim(attribute(x["said"], k)) for k in keys)), lambda v: v.isNotNull() & wanted(v)), F.lit(0)).alias("text"), attribute(x["said"], "href").alias("href")))
    return F.filter(found, lambda x: x["text"].isNotNull())


def stable_sql(html: str) -> str:
    """stable() as SQL of DuckDB."""
    q = lambda s: s.replace("'", "''")
    name = "lower(regexp_extract({}, '^</?([A-Za-z][^\\s/>]*)', 1))"
    kind = f"CASE WHEN regexp_matches(x, '^<[!?]') THEN 'comment' WHEN {name.format('x')} = '' THEN 'text' WHEN {name.format('x')} IN ({', '.join(repr(d) for d in DROPPED)}) AND regexp_matches(x, '(?s)>.*</') THEN 'raw' WHEN x[1:2] = '</' THEN 'close' WHEN {name.format('x')} IN ({', '.join(repr(d) for d in VOID)}) OR x[-2:] = '/>' THEN 'void' ELSE 'open' END"
    own = "lower(regexp_extract(a, '^\\s+([^\\s=]+)', 1))"
    tag = f"regexp_extract(x, '^</?[A-Za-z][^\\s/>]*') || array_to_string(list_filter(regexp_extract_all(x, '{q(_ATTRIBUTE)}'), lambda a: {own} NOT IN ({', '.join(repr(v) for v in VOLATILE)}) AND NOT regexp_matches({own}, '{VOLATILE_PARTS}')), '') || CASE WHEN x[-2:] = '/>' THEN '/>' ELSE '>' END"
    cut = f"regexp_extract_all(COALESCE({html}, ''), '{q(token_pattern(DROPPED))}')"
    alone = f"i > 1 AND k[i - 1] = 'open' AND k[i + 1] = 'close' AND {name.format('t[i - 1]')} = {name.format('t[i + 1]')}"
    said = f"list_transform(t, lambda x, i: CASE WHEN k[i] = 'raw' THEN '' WHEN k[i] IN ('open', 'void') THEN {tag} WHEN k[i] = 'text' AND COALESCE({alone}, FALSE) THEN regexp_replace(x, '{VOLATILE_TEXT}', '', 'g') ELSE x END)"
    return f"(SELECT trim(regexp_replace(array_to_string({said}, ''), '\\s+', ' ', 'g')) FROM (SELECT t, list_transform(t, lambda x: {kind}) AS k FROM (SELECT {cut} AS t)))"
