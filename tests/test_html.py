"""HTML by tokens against a walk with the standard library's parser."""

import os
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as T

SF = "/root/testdata/sf0.001"


class Walk(HTMLParser):
    """Elements as a tree: [name, attributes, children, parent]; texts are children that are strings."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.root = self.at = ["", {}, [], None]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        new = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(new)
        if tag not in H.VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at[2].append([tag, dict(attrs), [], self.at])

    def handle_endtag(self, tag):
        x = self.at
        while x[3] is not None and x[0] != tag:
            x = x[3]
        if x[3] is not None:
            self.at = x[3]

    def _text(self, said):
        if self.at[0] in ("script", "style"):
            return
        if self.at[2] and isinstance(self.at[2][-1], str):
            self.at[2][-1] += said
        else:
            self.at[2].append(said)

    handle_data = _text

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")


def walked(x):
    yield x
    for c in x[2] if isinstance(x, list) else []:
        yield from walked(c)


def above(x):
    while x[3] is not None:
        x = x[3]
        yield x


def squeezed(s):
    return " ".join(s.split())


def brute_links(html):
    root = Walk(html).root
    out = []
    parents = {id(c): p for p in walked(root) if isinstance(p, list) for c in p[2] if isinstance(c, list)}
    order = []

    def lay(x):
        for c in x[2]:
            order.append((c, x))
            if isinstance(c, list):
                lay(c)

    lay(root)
    for n, (a, parent) in enumerate(order):
        if not isinstance(a, list) or a[0] != "a" or any(p[0] in H.FURNITURE for p in above(a)) or any(p[0] == "a" for p in above(a)):
            continue
        text = squeezed(" ".join(c for c in walked(a) if isinstance(c, str)))
        href = squeezed(a[1].get("href", ""))
        if "/search" not in href or href.rstrip("/") in ("/search", "search") or not 3 < len(text) < 220:
            continue
        near = list(above(a))[: H.LEVELS]
        heading = None
        for c, p in order[:n]:
            if isinstance(c, str) and 2 < len(squeezed(c)) < 90 and any(q is p or any(q is g for g in above(p)) for q in near):
                if p[0] != "a" and not any(g[0] == "a" or g[0] in H.FURNITURE for g in [p, *above(p)]):
                    heading = squeezed(c)
        out.append((text, href, heading))
    assert parents is not None
    return out


def pages_of(seed, n):
    r = random.Random(seed)
    words = ["Pump", "Valve (V1)", "Rope", "x", "a longer heading of some words", "time: 5pm", "token=abc", "&copy; 5"]

    def node(depth):
        kind = r.random()
        if kind < 0.3 or depth > 7:
            return r.choice(words)
        if kind < 0.45:
            q = r.choice(['"', "'"])
            return f"<a class=b href={q}{r.choice(['/search?q=' + str(r.randint(0, 9)), '/search', '/other', '/search/'])}{q}>{r.choice(words)}<b>{r.choice(words)}</b></a>"
        if kind < 0.5:
            return r.choice(["<br>", "<img alt='x > y'>", "<!-- a <b> -->", "<script>var t=\"</p>\";</script>", "</div>", "<p>", "<hr/>"])
        tag = r.choice(["div", "div", "li", "section", "nav", "footer", "span", "p"])
        return f"<{tag} {r.choice(['', 'style=x', 'data-token=1 id=k', 'onclick=\"a>b\"'])}>" + "".join(node(depth + 1) for _ in range(r.randint(0, 4))) + (f"</{tag}>" if r.random() < 0.9 else "")

    return ["<html><body>" + "".join(node(0) for _ in range(6)) + "</body></html>" for _ in range(n)]


def test_links_and_headings_equal_a_walk(spark):
    html = pages_of(1, 150) + ["<div>" * k + "Head" + "</div>" * d + "<div>" * d + '<a href="/search?q=1">Pump (V1)</a>' for k in range(1, 10) for d in range(k)]
    html += ["", "<", "no tags", '<a href="/search?q=1">never closed', '<a href="/search?q=2">Pump</a>']
    if os.path.isdir(SF):
        own = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(40).collect()]
        html += [h.replace('href="/', 'href="/search?q=').replace("<nav>", "<div>Topics").replace("</nav>", "</div>") for h in own]
    df = spark.createDataFrame(list(enumerate(html)) + [(-1, None)], "i long, html string").repartition(4)
    got = {r.i: [tuple(x) for x in r.l] for r in df.select("i", H.search_links(F.col("html")).alias("l")).collect()}
    assert got.pop(-1) == []
    for i, h in enumerate(html):
        assert got[i] == brute_links(h), h


def test_only_what_changes_goes(spark):
    said = lambda h: spark.createDataFrame([(h,)], "h string").select(T.normalise_html(F.col("h"))).first()[0]
    assert said("<p  style='a>b' ONCLICK=f() id = k data-csrf=1>A\n B</p>") == "<p id = k>A B</p>"
    assert said("<p onmouseover=x stylesheet=y>a</p>") == "<p onmouseover=x stylesheet=y>a</p>"
    assert said("<p>token: abc</p><p>see token: abc <b>now</b></p>") == "<p></p><p>see token: abc <b>now</b></p>"
    assert said('style="x" and onclick=1 are words here') == 'style="x" and onclick=1 are words here'
    assert said("<noscript><p>x</p></noscript><iframe src=a></iframe>a<script>if (a<b) x</script> b") == "a b"
    assert said(None) == "" and said("<input type=text nonce='q' />") == "<input type=text/>"


def test_attributes_in_any_quotes(spark):
    h = """<img alt='Rope (V1)'><div title="no" data-name=Pump(V2)>prose title="Fake (V3)"</div><i title='Long "x" (V4)'></i>"""
    df = spark.createDataFrame([(h,)], "h string")
    got = df.select(H.named_in_attributes(F.col("h"), ["title", "data-name", "alt"], lambda v: v.contains("(V"))).first()[0]
    assert [x.text for x in got] == ["Rope (V1)", "Pump(V2)", 'Long "x" (V4)']


def test_long_pages(spark):
    h = "<div>" * 300 + "<p class='x'>word</p>" * 3000 + '<a href="/search?q=1">Pump</a>'
    df = spark.createDataFrame([(h,)], "h string")
    assert df.select(F.size(H.tokens(F.col("h")))).first()[0] == 300 + 9000 + 3 and df.select(F.length(T.normalise_html(F.col("h")))).first()[0] == len(h)
    assert [x.heading for x in df.select(H.search_links(F.col("h"))).first()[0]] == ["word"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pages_hash_the_same_whatever_changes_between_visits(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html")
    again = p.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<div class", "<div nonce='q7' onclick=\"go('x > y')\" class"), r"track\(\d+\)", "track(99)"))
    hashes = lambda df: {r[0]: r[1] for r in df.select("page_id", F.sha2(T.normalise_html(F.col("html")), 256)).collect()}
    assert hashes(p) == hashes(again)
