import html as entities
import random
import re
import time
from html.parser import HTMLParser

import pandas as pd
import pytest

from latticework.llm import html_extract, queries

from .conftest import got

CASES = [
    ("", ""), ("plain", "plain"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<head><title>t</title></head><body>x", "x"), ("<script>var a='<p>no</p>'</script>yes", "yes"), ("<style>p{}</style><!-- no -->a <b>b</b>", "a b"),
    ("<ul><li>a<li>b</ul>c", "- a\n- b\n\nc"), ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<table><tr><th>k<th>value<tr><td>aaa<td>1</table>", "k    value\naaa  1"), ("<pre>a  b\n c</pre>", "a  b\n c"), ("a   b\n\n c", "a b c"),
    ("<div hidden>no</div><p style='display: none'>no</p><span style='visibility:hidden'>no</span>ok", "ok"), ("&lt;b&gt; &amp; &eacute;&#65;", "<b> & éA"),
    ("<h1>T</h1>text<blockquote>q</blockquote>", "T\n\ntext\n\n  q"), ("</p></div></b>x", "x"), ("<p>a<div>b</div>c", "a\n\nb\nc"), ("<a href='x>y'>l</a>", "l"), ("<b>x</i></b>y", "xy"),
    ("<p", "<p"), ("a<!doctype html>b", "ab"), ("a < b <c>d</c> <3", "a < b d <3"),
    # quotes
    ('<p title="it"s">hi</p>', "hi"), ('<p title="it"s">hi</p><a href="x>link</a> after', "hi\n\nlink after"), ("<p title=it's>hi</p>", "hi"), ("<p a=\"1>2\" b='3>4'>hi", "hi"),
    # forms
    ("<select><option>one<option>two</select>yes", "one\ntwo\nyes"), ("<select><optgroup label=g><option>o</select>", "g\no"), ("<textarea>\n a  b</textarea>", " a  b"), ("x<textarea><b>&amp;</textarea>y", "x\n<b>&\ny"),
    ("<button>Go</button> <input type=submit value=Send> <input type=hidden value=no><input value=typed><input type=checkbox value=no>", "Go Send typed"),
    # visibility
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>", "yes"), ("<p style='DISPLAY : NONE ; color:red'>no</p>ok", "ok"),
    ("<p style='display:none!important;display:block'>no</p><p style='display:none;display:block'>ok</p>", "ok"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<svg><title>no</title><path>no</path><text>yes</text></svg>", "yes"), ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>1", "x=1"), ("<svg/>a<svg><circle/><p>b</svg>c", "a\n\nbc"),
    ("<template>no</template><noscript>no</noscript><iframe>no</iframe>ok", "ok"),
    # tables
    ("<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>d</table>", "wide one  c\na  b      d"), ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td rowspan=2>a<td colspan=2>b<tr><td>c<td rowspan=0>d<tr><td>e<td>f</table>", "a  b\n   c  d\ne  f"), ("<table>astray<tr><td>c</table>", "astray\nc"), ("<td>x</td>y", "xy"),
    ("<table><caption>cap<tr><td>a<td>b</table>", "cap\na  b"), ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
    ("<table><tr><td>one<br>two<td>x</table>", "one  x\ntwo"), ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"), ("<table><tr><td>a<table><tr><td>in<td>ner</table>b<td>c</table>", "a        c\n\nin  ner\n\nb"),
    # crossed and implied tags
    ("<b><div>x</b>y</div>", "xy"), ("<p>a</p>b</p>c", "a\n\nb\n\nc"), ("<!-->x<!--->y<!-- a --!>z<!-- b", "xyz"), ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"), ("<h1>a<h2>b</h3>c", "a\n\nb\n\nc"),
    ("a<plaintext>b<p>", "a\n\nb<p>"), ("<ul><li>a<p>b</ul>", "- a\n\n  b"), ("<ul><li><div>a<li>b</ul>", "- a\n- b"), ("<p><table><tr><td>x</table>", "x"), ("<pre>\n\na</pre>", "a"), ("a\r\nb\0c", "a bc"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert html_extract.extract(page) == text


def test_null_and_depth():
    assert html_extract.extract(None) is None
    assert html_extract.extract("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
    assert html_extract.extract("<table><tr><td>" * 3000 + "x").strip() == "x"
    assert html_extract.extract("<ul><li>x" * 200).split() == ["-", "x"] * 200


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>x" * n, lambda n: "<b><p>x" * n, lambda n: '<a "' * n, lambda n: "<a " * n, lambda n: "<ul><li>x" * n, lambda n: "<table><tr><td>x<td>y" * n, lambda n: "<blockquote>x" * n,
        lambda n: "<b>" * n + "<div>" + "</b>x" * n, lambda n: "<!-- x -->--!" * n, lambda n: "<svg>" + "<![CDATA[x" * n, lambda n: "<textarea>x" * n, lambda n: "<div>" * n + "</span></p>x" * n,
        lambda n: "<p style='" + "display:x;" * n + "'>x", lambda n: "<table>" + "<tr><td rowspan=65000 colspan=9>x" * n, lambda n: "<a x='>" * n + '<b y="' * n, lambda n: "< &amp" * n,
        lambda n: "<table>" + "".join(f"<tr><td rowspan={1 + i * 7919 % n}>x" for i in range(n)),
    ],
)
def test_linear(make):
    """Twenty thousand hard pieces take seconds: with a square they'd take minutes."""
    began = time.process_time()
    html_extract.extract(make(20_000))
    assert time.process_time() - began < 20


def test_broken_markup_never_fails():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<", ">", "a", "&amp", "\n", "<pre>", "</pre>", "<div hidden>", "</div>", '"', "<b x=", "<!--", "-->", "</td>", "<ol>", "<br/>"]
    bits += ["<td rowspan=3>", "<th colspan=2>", "<thead>", "</tbody>", "<caption>", "<svg>", "<text>", "</svg>", "<math>", "<select>", "<option>", "</b>", "<b>", "<h1>", "</h2>", "<dd>", "<dl>", "<button>", "</button>", "<textarea>", "</textarea>", "<details>", "<summary>", "'", "</body>", "<html>"]
    for _ in range(3000):
        assert isinstance(html_extract.extract("".join(rng.choice(bits) for _ in range(40))), str)


def test_all_visible_words_stay():
    """Whatever the order of tags, every word that is not hidden is in the result once; on pages without tables, in order."""
    rng = random.Random(9)
    tags = ["p", "div", "b", "li", "h2", "span", "blockquote", "ul", "ol", "a", "dd", "dt", "dl", "button", "math", "em", "center", "label"]
    cells = ["table", "tr", "td", "th", "tbody", "caption"]
    for k in range(400):
        words, page, some = [], "", tags + cells * (k % 2)
        for i in range(40):
            words.append(f"w{i}")
            page += f"<{rng.choice(some)}>w{i} " + (f"</{rng.choice(some)}> " if rng.random() < 0.6 else "")
        found = re.findall(r"w\d+", html_extract.extract(page))
        assert sorted(found) == sorted(words) and (k % 2 or found == words), page


class Reference(HTMLParser):
    """The layout rules once more, over the library's events, for pages of blocks, lists, links and breaks without tables."""

    APART = ("p", "h1", "h2", "ul", "ol")
    LINES = (*APART, "div", "nav", "article", "footer", "body", "html", "section", "li")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.line, self.off, self.open_p, self.item = [], "", 0, False, False

    def cut(self, apart=False):
        if text := re.sub(r"[ \t\n\f]+", " ", self.line).strip(" "):
            self.lines.append("- " * self.item + text)
            self.item = False
        self.line = ""
        if apart and self.lines and self.lines[-1]:
            self.lines.append("")

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "style", "script", "title")
        if tag == "br":
            self.cut()
        if self.open_p and tag in self.LINES:
            self.cut(apart=True)
            self.open_p = False
        if tag in self.LINES:
            self.cut(tag in self.APART)
        self.open_p |= tag == "p"
        self.item |= tag == "li"

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "style", "script", "title")
        if self.open_p and tag in self.LINES:
            self.cut(apart=True)
            self.open_p = False
        if tag in self.LINES:
            self.cut(tag in self.APART)

    def handle_data(self, data):
        if not self.off:
            self.line += data


def test_query(spark, sf):
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    want = []
    for page_id, page in zip(pages.page_id.tolist(), pages.html, strict=True):
        if page is None:
            want.append((page_id, None))
            continue
        r = Reference()
        r.feed(page)
        r.close()
        r.cut()
        want.append((page_id, "\n".join(r.lines).strip("\n")))
    found = got(queries.op8_html_extraction(spark, sf), "page_id", "text")
    assert found == sorted(want)
    assert all(entities.unescape("&copy;") in text for _, text in found if text)


def test_rows(spark):
    made = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None), (2, "", "y")], "page_id long, html string, text string")
    assert got(html_extract.extract_pages(made), "page_id", "text") == [(None, None), (1, "a"), (1, "a"), (2, "")]
    assert html_extract.extract_pages(made.limit(0)).collect() == []
