"""Titles, outlinks and text of pages against html.parser."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from voicelake.llm import warc

PAGES = [
    "<title>A &copy; B</title><p>it&#8217;s caf&#xE9; &middot; &copy; &notin; &amp;copy; &hellip;",
    "<TITLE lang=en>T &amp; U</TITLE><A class='x' HREF='/one?a=1&amp;b=2'>1</A><a href=/two>2</a><a\ntitle=\"a > b\" href = \"/three\">3</a>",
    '<a data-href="/no" href="/yes?x=1&#38;y=2&lt;">x</a><!-- <a href="/gone">y</a> --><script>"<a href=\'/gone\'>"</script><a name=z>none</a>',
    "1 < 2 and 3 > 2<br/>AT&T &unknown; &#0; &#128; &#x1F600;<style>p > a {}</style><div>x</div>",
    "<title>one</title><svg><title>two</title></svg><a href>empty</a><a href=''>e</a><abbr href='/no'>q</abbr>",
    "<p>it isn't <b class=don't>bold</b> &nbsp; end</p>", "", "plain",
]


class Plain(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.titles, self.links, self.text, self.within = [], [], "", ""
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.within = tag
        if tag == "title":
            self.titles.append("")
        if tag == "a" and "href" in dict(attrs):
            self.links.append(dict(attrs)["href"] or "")

    def handle_endtag(self, tag):
        self.within = ""

    def handle_data(self, data):
        if self.within == "title":
            self.titles[-1] += data
        if self.within not in ("script", "style"):
            self.text += data


def test_pages_against_html_parser(spark):
    df = spark.createDataFrame([(i, "u", html) for i, html in enumerate(PAGES)], "page_id long, url string, html string")
    blocks = {(r["page_id"], r["kind"]): r["block"] for r in warc.derivatives(warc.responses(df)).collect()}
    solid = lambda text: re.sub(r"\s", "", text)
    for i, html in enumerate(PAGES):
        want, meta = Plain(html), blocks[i, "metadata"].split("\n")
        assert meta[0] == "title: " + (want.titles or [""])[0]
        assert meta[1:-1] == [f"links: {len(want.links)}", *("outlink: " + x for x in want.links)]
        assert solid(blocks[i, "conversion"]) == solid(want.text)
    assert blocks[0, "conversion"] == "A © B\nit’s café · © ∉ &copy; …"


def test_reference_in_a_query_string_stays():
    """Browsers leave &copy= and &copyx in attributes; html.parser of this version does not."""
    assert warc.parsed('<a href="/?x=1&copy=2&copyx&amp;y">z</a>')[1] == ["/?x=1&copy=2&copyx&y"]


OPEN = ["<x=", "<", "<!--", "<!", "</", "</a", "</a ", "if(a<b)", "<script>", "</script ", "<script", "<title>", "</title ", "<a href=\"", "<a href='>'", "<a b=\"'", "<x='>\">", "&", "&amp", "<a =", "<a href=x ", "<a\n", "=\"", "<x=\">\""]


@pytest.mark.parametrize("part", OPEN)
def test_open_pages_end(part):
    """A megabyte of anything left open, alone and with an end far away."""
    began = time.time()
    for text in (part * (1_000_000 // len(part)), "<script>" + part * (1_000_000 // len(part)), part * (500_000 // len(part)) + ">" + part * (500_000 // len(part))):
        warc.parsed(text)
    assert time.time() - began < 15


def test_a_page_that_ends_inside_a_script():
    assert warc.parsed("<p>said</p><script>if (a < b && c > d) { x = '<p>") == ("", [], "said")
    assert warc.parsed("<p>said <b") == ("", [], "said <b")


def plain_tag(html, at):
    """Tags by the pattern in words: a comment, a name with attributes whose quoted values may hold >, or a declaration."""
    pattern = r"<!--.*?-->|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>|<(?:[!?]|/(?!>))[^>]*>|</>"
    m = re.compile(pattern, re.S).search(html, at)
    return m and (m.start(), m.end(), bool(m[1]) and bool(m[2]), (m[2] or "").lower(), m[3] or "")


def test_tags_against_a_pattern():
    rng = random.Random(6)
    for _ in range(30_000):
        html = "".join(rng.choice(["<", "</", ">", "=", " ", '"', "'", "a", "br", "<!--", "-->", "!", "/", "\n", "?"]) for _ in range(rng.randint(1, 14)))
        tags, at = warc.Tags(html), 0
        while True:
            got, want = tags.following(at), plain_tag(html, at)
            assert (got and got[:2]) == (want and want[:2]) and (not got or got[3:] == want[3:]), (html, got, want)
            if not got:
                break
            at = got[1]
