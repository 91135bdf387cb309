import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tabsight.llm import dom, extraction

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("text", T.StringType())])


@pytest.fixture(scope="module")
def trees(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def one(trees, source):
    return extraction.extract([source], trees)[0]


def test_whole_table_equals_its_articles(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extraction.main_text(pages, trees).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_unseen_layouts(spark, trees):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").limit(60).collect()]
    main, other = [], []
    for p in pages:
        a, b = extraction.weak_blocks(dom.parse(p))
        main += a
        other += b
    layout = extraction.Layout(random.Random(2024), main, other)
    right = wrong = missed = 0
    for _ in range(200):
        page, kept = extraction.labelled(layout.page())
        got = extraction.decode(page, trees.log_odds(dom.features(page, trees.vocabulary)))
        own = np.array(page.own)
        right, wrong, missed = right + own[kept & got].sum(), wrong + own[~kept & got].sum(), missed + own[kept & ~got].sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_decoding_is_closed_under_ancestors(trees):
    page = dom.parse("<div><div class=comments><p>long text of a reader that looks like prose, really. It does.</p></div><p>x</p></div>")
    kept = extraction.decode(page, np.random.default_rng(1).normal(size=len(page.tag)))
    assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_parser():
    p = dom.parse("<ul><li>a<li>b &amp; c&nbsp;d</ul><p>x<p>y<b>z</b>w<br>v<script>var a='</p>';</script><style>p{}</style><!-- no --><a href='>'>l</a> 1 < 2")
    everything = np.ones(len(p.tag), dtype=bool)
    assert dom.text_of(p, everything) == "a b & c d x yzw vl 1 < 2"
    assert dom.text_of(dom.parse("<p>cut &am"), np.ones(9, dtype=bool)) == "cut &am"
    for odd in (None, "", "<", "<p", "</", "<!--", "<p class='", "<script>", "</p></p>", "<a/><b/>", "a" * 100_000, "<div>" * 3000 + "deep", "<title>x"):
        page = dom.parse(odd)
        assert len(dom.features(page, {})) == len(page.tag)


def test_edge_rows(spark, trees):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (None, "u", "<article><p>Words of a page, and more of them.</p></article>", "c"), (3, "u", " \n ", "c"), (3, "u", " \n ", "c")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extraction.main_text(spark.createDataFrame(rows, SCHEMA), trees).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "", 0), ("3", "", 0), ("None", "Words of a page, and more of them.", 34)]
    assert extraction.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_parts_that_are_not_the_article(trees):
    body = "".join(f"<p>Paragraph {i} tells a longer part of the story, with several words. It goes on.</p>" for i in range(5))
    page = (f"<body><div class='cookie-banner'><p>We use cookies on this site.</p></div><header><a href='/'>Site</a></header><div class='post-content'><h1>Title</h1>{body}</div>"
            "<div class='comments'><h3>2 comments</h3><div class='comment'><p>I liked this story a lot, thank you. Really.</p></div></div>"
            "<div class='sidebar'><h3>Related</h3><ul><li><a href='/a'>Other story</a></li></ul></div><form><label>Mail</label><input><button>Subscribe</button></form>"
            "<footer><p>&copy; 2024 Site</p></footer></body>")
    want = "Title " + " ".join(f"Paragraph {i} tells a longer part of the story, with several words. It goes on." for i in range(5))
    assert one(trees, page) == want


PROSE = "The council met on Tuesday to talk about the bridge, and most of its members agreed. Work will begin in spring. "
UNKNOWN = [
    (f"<body><table><tr><td><font size=2>{PROSE * 3}</font></td></tr></table></body>", PROSE * 3),
    (f"<body><div class=k><h2>Bridge</h2><p>{PROSE}</p><pre>a  b</pre><table><tr><td>1</td></tr></table></div></body>", PROSE),
    (f"<body><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul><div><div>{PROSE * 2}</div></div><div>© 2020</div></body>", PROSE * 2),
    (f"<center><b>Bridge</b><br>{PROSE * 2}<br>{PROSE}</center>", PROSE * 2),
    (f"<body><blockquote>{PROSE * 2}</blockquote><address>Town hall</address></body>", PROSE * 2),
    (f"<table><tr><td width=100><a href=/>a</a><td><p>{PROSE}<p>{PROSE}</table>", PROSE),
    (f"<section><h1>Bridge</h1>{PROSE * 4}</section>", PROSE * 4),
    (f"<dl><dt>Bridge</dt><dd>{PROSE * 2}</dd></dl>", PROSE * 2),
]


@pytest.mark.parametrize("source,prose", UNKNOWN)
def test_prose_of_unknown_layouts_is_never_lost(trees, source, prose):
    assert " ".join(prose.split()) in one(trees, f"<html><head><title>t</title></head>{source}</html>")


def test_pages_without_prose_stay_empty(trees):
    assert one(trees, "<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><footer>© 2020 by nobody</footer></body></html>") == ""
    assert one(trees, f"<html><body><aside>{PROSE * 3}</aside><form>{PROSE}</form></body></html>") == ""
