import hashlib

import pytest

from creaseline.llm import html_text
from creaseline.llm.html_text import visible_text
from creaseline.llm.queries import QUERIES

CASES = {
    "<p>a<p>b<ul><li>x<li>y<ul><li>z</ul><li>w</ul>end": "a\n\nb\n\n- x\n- y\n  - z\n- w\n\nend",
    "<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>x": "a     bbb\ncccc  d\n\nx",
    "<ol start=3><li><p>one</p><p>two</p><li>three</ol>": "3. one\n\n   two\n4. three",
    "a<br>b <b>c</b>d<script>x<y</script> e": "a\nb cd e",
    "<pre>\n a  b\n  c</pre>x": " a  b\n  c\n\nx",
    "<table><tr><th colspan=2>wide head<th>c</tr><tr><td rowspan=2>r<td>1<td>2<tr><td>33<td>44</table>": "wide head  c\nr  1       2\n   33      44",
    "<div hidden>no</div><div style='color:red;Display : none'>no</div><p style=visibility:hidden>no</p>yes": "yes",
    "<details><summary>s</summary>no<p>no</details><details open>yes</details>": "s\nyes",
    "5 < 6 &amp; 7 &lt; 8 <a href='x>y'>z</a> &eacute;&#8364;&nosuch;": "5 < 6 & 7 < 8 z é€&nosuch;",
    "<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body>x<!-- no -->y<![CDATA[no]]></body>": "xy",
    "<p>one</div>two</p></span>three": "onetwo\n\nthree",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\nb\nc\nd",
    "<select><option>1<option>2</select>": "1\n2",
    "<table><caption>cap</caption><thead><tr><th>h<tbody><tr><td>a<table><tr><td>n</table></table>": "cap\nh\na\n\nn",
    "<h1>t</h1>x<hr>y<blockquote>q</blockquote>": "t\n\nx\n\ny\n\nq",
    "  spaced \n out\t text&nbsp;here ": "spaced out text\xa0here",
    "<textarea> a\n <b></textarea>": " a\n <b>",
    "a</p>b": "a\n\nb",
    "<noscript>no</noscript><template>no</template><iframe>no</iframe>yes<script>never closed": "yes",
    "<td>alone</td>": "alone",
    "<": "<",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert visible_text(html) == CASES[html]


SEEN = {
    "<p style='backface-visibility: hidden'>a</p><p style='-webkit-backface-visibility:hidden'>b": "a\n\nb",
    "<p style='--display: none; --my-visibility:hidden'>a</p><p style='background:url(x;display:none)'>b": "a\n\nb",
    "<div style='visibility:hidden'>no<p style='visibility: Visible'>yes</p>no</div>": "yes",
    "<div style='visibility:hidden'>no<b style='color:red'>no<i style='visibility:initial'>yes</i></b></div>": "yes",
    "<div style='display:none'>no<p style='visibility:visible;display:block'>no</p></div>yes": "yes",
    "<p style='display:none;display:block'>a</p><p style='display:none!important;display:block'>no</p>b": "a\n\nb",
    "<p style='/* display:none */color:red'>a</p><p style='display:none;display:bogus'>no</p>": "a",
    "<ol><li>a<li style='visibility:collapse'>no<li>c</ol>": "1. a\n3. c",
}


@pytest.mark.parametrize("html", SEEN)
def test_what_is_seen(html):
    assert visible_text(html) == SEEN[html]


def test_deep_and_long_pages():
    assert visible_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert visible_text("<b>" * 3000 + "x") == "x"
    assert visible_text("<p>word</p>" * 20_000).count("word") == 20_000


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>x"), (3, "u", "<p>x"), (None, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as html_text")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(pages).collect()) == [(0, "y"), (1, ""), (2, ""), (3, "x"), (3, "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_query_keeps_every_visible_word(spark, data):
    """The generator's pages hold text in simple elements: a strict parser must see the same words in the same order."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")
            if tag in ("p", "div", "li", "br", "h1", "footer", "nav"):
                self.words.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")
            if tag in ("p", "div", "li", "h1", "footer", "nav"):
                self.words.append(" ")

        def handle_data(self, data):
            if not self.skip:
                self.words.append(data)

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op5_html_text"](spark, data).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parser = Words()
        parser.feed(pages[r.page_id])
        parser.close()
        assert [w for w in r.text.split() if w != "-"] == [w for w in "".join(parser.words).split() if w != "-"]
        assert (r.n_chars, r.text_sha256) == (len(r.text), hashlib.sha256(r.text.encode()).hexdigest())
