import random
import re
import time
from html.parser import HTMLParser

import pytest

from unitloom.llm.html_text import page_texts, visible_text

CASES = {
    "<p>One<p>Two <b>bold</b>\n  text": "One\n\nTwo bold text",
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><h1>Head</h1>x": "Head\n\nx",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>a</li><li value='9'>b</li><li>c</ol>": "3. a\n9. b\n10. c",
    "<table><tr><th>Name<th>N<tr><td>longer<td>1</table>": "Name   | N\nlonger | 1",
    "a<table><td>x<br>yy<td>z<tr><td colspan=2>wide cell here<tr><td><td>q</table>b": "a\n\nx  | z\nyy\nwide cell here\n   | q\n\nb",
    "<table><tr><td rowspan=2>r<td>1<tr><td>2</table>": "r | 1\n  | 2",
    "<div hidden>no</div><p style='display: none'>no<p style=\"color:red\">yes<span style='visibility:hidden;'>no</span></p>": "yes",
    "<div>a</div><div>b</div><!-- <p>no</p> -->c": "a\nb\nc",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<pre>  x\n   y</pre>z": "  x\n   y\n\nz",
    "<blockquote>q<p>r</blockquote>s": "> q\n>\n> r\n\ns",
    "x &lt;b&gt; &amp;am &copy; &nbsp;y &#233;": "x <b> &am ©  y é",
    "a < b and 3<4 <a href='x>y'>link</a>": "a < b and 3<4 link",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<details><summary>S</summary><p>no</details><details open><summary>T</summary><p>yes</details>": "S\nT\n\nyes",
    "text</p>more": "text\n\nmore",
    "a<hr>b": "a\n\n---\n\nb",
    "<table><tr><td>only</td></tr><tr><td>one</td></tr></table>": "only\none",
    "<p>a<span> b </span>c<i>d</i>": "a b cd",
    "<li>x<p>y</p></li>": "- x\n\n  y",
    "<script>never ends": "", "<a href='": "", "": "", "<>": "<>", "</>x": "x", "<br>": "", "a<b": "a", "<title>t</title>b": "b",
    "<select><option>a<option>b</select>": "a\nb",
    "<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>": "a     | b\n\ni | j",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


class Words(HTMLParser):
    """Words of the visible text, by another parser: for pages without odd markup."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.words.append(data)


def test_words_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.join(page_texts(pages), "page_id").select("html", "text").collect()
    assert len(rows) == pages.count()
    for r in rows:
        other = Words()
        other.feed(r.html)
        other.close()
        assert re.sub(r"\s", "", r.text.replace("- ", "")) == re.sub(r"\s", "", "".join(other.words).replace("- ", ""))


def test_odd_rows(spark):
    rows = [(1, None), (None, "<p>x"), (1, ""), (1, "<p>x"), (2, "<div>" * 20_000 + "deep"), (3, "w " * 200_000)]
    df = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, html string, text string")
    got = [tuple(r) for r in page_texts(df).collect()]
    assert got == [(1, None), (None, "x"), (1, ""), (1, "x"), (2, "deep"), (3, ("w " * 200_000).strip())]
    assert page_texts(df.limit(0)).collect() == []


def test_any_markup_ends_in_linear_time():
    rng = random.Random(1)
    bits = ["<p>", "<", "</", "<td>", "<table>", "</table>", "<li>", "<ul>", "\"", "'", "=", "<a href=\"", "<!--", "-->", "x", "&am", "<tr>", " ", "<b", ">", "<blockquote>", "<ol start=x>"]
    for _ in range(300):
        visible_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 60))))
    for bit in ("<", "<a", "<a =\"", "<ul><li>", "<!--", "</", "<p>", "<b>x", "&", "<script>", "<title>", "</p>"):
        start = time.time()
        visible_text(bit * 20_000)
        assert time.time() - start < 10, bit
    for row in ("<td>x" * 100_000, "<td colspan=3>x" * 50_000, "<td rowspan=2>x" * 50_000 + "<tr>" + "<td>y" * 50_000):
        start = time.time()
        visible_text(f"<table><tr>{row}</table>")
        assert time.time() - start < 20, row[:20]
    start = time.time()
    visible_text("<table><tr><td>" + "<pre>\n\n</pre><br>" * 30_000)
    assert time.time() - start < 10


@pytest.mark.parametrize("html, text", [
    ("<p>a <中文 b</p>c", "a <中文 b\n\nc"), ("x <тег> y<b>z</b>", "x <тег> yz"), ("a <é", "a <é"), ("a <b", "a"), ("a </", "a"),
    ("a<svg><title>t</title><g><text x='1'>one <tspan>two</tspan></text><text>three</text></g><path d=M0/></svg>b", "a\none two\nthree\nb"),
    ("a<svg><style>s</style><defs><text>no</text></defs>no<desc>no</desc><defs/><rect/><text>yes</text></svg>b", "a\nyes\nb"),
    ("<div hidden><svg><text>no</text></svg></div><svg style='display:none'><text>no</text></svg>b<svg/>c", "bc"),
    ("<svg><svg><text>in</text></svg><foreignObject><div>html</div></foreignObject></svg><text>out</text>", "in\nhtml\nout"),
    ("<svg><text>a<tspan hidden>no<text>no</text></tspan></text></svg>b", "a\nb"),
])
def test_signs_before_other_letters_and_svg_text(html, text):
    assert visible_text(html) == text
