import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmill.operators import articles, links
from newsmill.sources import pages

PAD = "word " * 30


def titles(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "page_id int, html string")
    return [r.title for r in articles.page_title(df).orderBy("page_id").collect()]


def contents(spark, docs, **kw):
    df = spark.createDataFrame(list(enumerate(docs)), "page_id int, html string")
    return [r.content for r in articles.page_content(df, **kw).orderBy("page_id").collect()]


def test_title_selectors(spark):
    docs = [
        '<h1>First heading</h1><h1 data-testid="storyTitle">By test id</h1>',
        '<h1>First heading</h1><h1 class="x graf--title">By class</h1>',
        '<h1>First heading</h1><h1 class="p-name">By name</h1>',
        "<title>Page title</title><h1>First heading</h1>",
        "<h1>abc</h1><title>Longer title</title>",
        '<div data-testid="storyTitle">Test id on a div</div>',
        '<h3 class="graf--h3 graf--leading">Leading heading</h3>',
        "<p>nothing</p>", "", None,
        "<h1>abc</h1><h1>Second heading is not tried</h1>",
        "<H1>Some <b>bold</b> text Follow</H1>",
        "<h1>a &amp; b &lt;c&gt; d</h1>",
    ]
    assert titles(spark, docs) == [
        "By test id", "By class", "By name", "First heading", "Longer title", "Test id on a div", "Leading heading",
        None, None, None, None, "Someboldtext", "a & b <c> d",
    ]


def test_content_cascade(spark):
    long, short = "long paragraph " * 10, "tiny paragraph"
    docs = [
        f"<article><section><p>{long}</p></section><p>outside the section</p></article>",
        f"<article><section><p>{short}</p></section><p>{long}</p></article>",
        f'<div data-testid="storyContent"><p>{long}</p></div><p>outside of it all</p>',
        f'<div class="section-content"><h2>{long}</h2><li>abcdef</li><li>abc</li></div>',
        "<p>" + "x" * 20 + "</p><p>" + "y" * 21 + "</p>",
        "<p>short</p>",
        f"<article><header><p>{long} in the header</p></header><p>{long}</p><aside><li>{long}</li></aside></article>",
        f"<nav><article><p>{long}</p></article></nav><p>only this one paragraph</p>",
    ]
    t = long.strip()
    assert contents(spark, docs) == [
        t, f"{short}\n\n{t}", t, f"{t}\n\nabcdef", "y" * 21, None, t, "only this one paragraph",
    ]


def test_nested_blocks(spark):
    doc = [f"<article><blockquote>quote start <p>inner text {PAD}</p></blockquote></article>"]
    inner = "inner text " + PAD.strip()
    assert contents(spark, doc) == [f"quote start{inner}\n\n{inner}"]
    assert contents(spark, doc, nested="innermost") == [inner]


def test_unclosed_paragraphs(spark):
    a, b = "alpha " * 12, "beta " * 12
    doc = [f"<article><p><b>{a}<br><p>{b}</p></article>"]
    assert contents(spark, doc) == [f"{a.strip()}{b.strip()}\n\n{b.strip()}"]


def test_tree_rules():
    nodes, texts = pages.read_tree(
        '<div id="a" class="x y"><p>one<br>two<p>three</div></div><script>var t="</p>";</script><!-- <p> --><img src=x/>tail'
    )
    shape = [(n["tag"], n["node_id"], n["end_id"], n["parent_id"], n["depth"]) for n in nodes]
    assert shape == [
        ("div", 0, 3, -1, 0), ("p", 1, 3, 0, 1), ("br", 2, 2, 1, 2), ("p", 3, 3, 1, 2), ("script", 4, 4, -1, 0), ("img", 5, 5, -1, 0),
    ]
    assert [(t["text"], t["parent_id"], t["boiler"]) for t in texts] == [
        ("one", 1, False), ("two", 1, False), ("three", 3, False), ("tail", -1, False),
    ]
    assert nodes[0]["classes"] == ["x", "y"] and dict(nodes[0]["attrs"])["id"] == "a"


tag = st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<br>", "text ", "<!-- c -->", "<li>", "</li>", "<p/>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(tag, max_size=30).map("".join))
def test_tree_is_well_formed(html):
    nodes, texts = pages.read_tree(html)
    for n in nodes:
        assert n["node_id"] <= n["end_id"] < len(nodes) and n["text_from"] <= n["text_to"] <= len(texts)
        if n["parent_id"] >= 0:
            up = nodes[n["parent_id"]]
            assert up["node_id"] < n["node_id"] and n["end_id"] <= up["end_id"] and n["depth"] == up["depth"] + 1


def test_node_table(spark):
    df = spark.createDataFrame([(1, "<div> a <b> b </b></div>")], "page_id int, html string")
    rows = pages.html_nodes(df).orderBy("node_id").collect()
    assert [(r.tag, r.text, r.text_strip) for r in rows] == [("div", " a  b ", "ab"), ("b", " b ", "b")]


def test_anchor_forms_agree(spark):
    df = spark.createDataFrame([(1, '<a href="/x" class="k">One</a><p><a href="/y">Two</a><a>none</a>')], "page_id int, html string")
    tree, native = links.anchors(df).collect(), links.anchors_native(df).collect()
    assert [tuple(r) for r in tree] == [tuple(r) for r in native] == [(1, 0, "/x", "One"), (1, 1, "/y", "Two")]


def test_page_article_reasons(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{PAD}</p>"), (2, "u", "<h1>A title here</h1>"), (3, "u", f"<h1>A title here</h1><p>{PAD}</p>")],
                               "page_id int, url string, html string")
    assert [r.reject_reason for r in articles.page_article(df).orderBy("page_id").collect()] == ["no_title", "no_content", None]


@pytest.mark.parametrize("copies", [3])
def test_latest_snapshot_wins(spark, copies):
    crawl = spark.createDataFrame([("https://h/a?ref=1", f"v{i}", "c", i) for i in range(copies)], "url string, title string, content string, fetched_at int")
    found = spark.createDataFrame([("https://h/a", "me"), ("https://h/b", "you")], "url string, author string")
    rows = articles.article_join(found, crawl).orderBy("url").collect()
    assert [(r.url, r.author, r.title, r.matched) for r in rows] == [("https://h/a", "me", "v2", True), ("https://h/b", "you", None, False)]


def test_refused_markup_is_an_empty_page(spark):
    df = spark.createDataFrame([(1, "u", "<h1>A title here</h1><![foo bar[ x ]]>")], "page_id int, url string, html string")
    assert articles.page_article(df).first().reject_reason in ("no_title", "no_content")


def test_deep_trees_stay_linear():
    nodes, texts = pages.read_tree("<p>x" * 40000)
    assert len(nodes) == len(texts) == 40000 and nodes[0]["end_id"] == 39999


def parsed(html):
    reader = pages._TreeReader()
    reader.feed(html)
    reader.finish()
    for node in reader.nodes:
        node["attrs"] = list(node["attrs"].items())
    return reader.nodes, [{"text": t, "parent_id": p, "boiler": b} for t, p, b in reader.texts]


PIECES = ["<p>", "</p>", '<div class="a b">', "</div>", "<br>", "<title>", "</title>", "x &amp; y", "&#x27;", "&lt", "& ", "\n", '<a href="u" id="1">', "</a>",
          "<A>", "<br/>", " < ", "<!-- c -->", "<script>", "</script>", "<template>", "</template>", "<textarea>", "</textarea>", "<a href='x'>", '<a href="&amp;">', "<p", ">"]


@pytest.mark.parametrize("kinds", [14, len(PIECES)])
def test_plain_markup_reads_as_the_parser_reads_it(kinds):
    rnd, plain = random.Random(kinds), 0
    for _ in range(3000):
        html = "".join(rnd.choices(PIECES[:kinds], k=rnd.randint(0, 8)))
        plain += pages.read_plain(html) is not None
        assert pages.read_tree(html) == parsed(html), html
    assert plain > 300
