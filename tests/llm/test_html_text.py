import html
import re

from newsmill.llm import html_text as H

SCHEMA = "page_id long, url string, html string"
TREE = H.grow(*H.examples())


def text(page):
    blocks = H.text_blocks(page)
    return "\n".join(b[0] for b, k in zip(blocks, H.decide(TREE, H.features(blocks))) if k) if blocks else ""


def test_tree_fits_its_examples():
    x, y = H.examples()
    assert (H.decide(TREE, x) == y).all()


def test_parts_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site name</p></header>
    <nav><ul><li><a href=1>Home</a></li><li><a href=2>More</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site to make it better for all of you.</p></div>
    <article><header><h1>A &amp; B</h1></header><p>First   paragraph
    with <b>bold</b> and <a href=x>link</a>.</p><p>Ti.</p><div class="ad">Buy now</div><script>var a = "<p>no</p>";</script><!-- <p>no</p> -->
    <p>Caf&eacute;&nbsp;&#233; &lt;tag&gt;<br>line<form><input><label>Name</label></form></article>
    <section id="comments"><p>I really liked this article a lot, thank you for writing it.</p></section>
    <aside><p>Related words in a sidebar that are long enough to look like a text.</p></aside><footer>&copy; me</footer></body></html>"""
    assert text(page) == "A & B\nFirst paragraph with bold and link.\nTi.\nCafé é <tag> line"


def test_page_without_landmarks():
    long = "word " * 60
    page = f"<body><div><a href=1>Home</a></div><div><a href=2>About us</a></div><h2>Title here</h2><div>{long}</div><div>{long}</div><div><a href=3>Next</a></div></body>"
    assert text(page).splitlines() == ["Title here", long.strip(), long.strip()]


PARAGRAPHS = ["This is the first of two long paragraphs " + "of an article " * 12, "And the second one goes on for as long " + "as the first did " * 10]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
WANT = "\n".join(p.strip() for p in PARAGRAPHS)


def test_self_closed_svg_holds_nothing():
    assert text(f"<body><div><svg class='a>b'/>{BODY}</div></body>") == WANT
    assert text(f"<body><div><svg viewBox=1><text>no</text></svg>{BODY}</div></body>") == WANT


def test_hint_on_a_wrapper_of_the_page():
    for named in ('class="page has-sidebar side"', 'id="search-results"', "role=search", 'class="side-by-side"'):
        assert text(f"<body><div {named}><ul class=menu><li><a href=1>Home</a></li></ul><div>{BODY}</div></div></body>") == WANT


def test_hint_beside_an_article_or_on_comments():
    assert text(f"<body><article><p>A short one.</p></article><div class=sidebar>{BODY}</div></body>") == "A short one."
    assert text(f"<body><div><p>{'word ' * 30}</p></div><div id=comments>{BODY * 3}</div></body>") == ("word " * 30).strip()
    assert H.hinted("div", 'class="sidebar comments"') == 2 and H.hinted("div", "class=outside") == 0
    assert text(f"<body><div>{BODY}</div><div class=promo><p>{'Buy this now or never. ' * 4}</p></div></body>") == WANT


def test_given_pages(spark):
    """Brute force for pages of this make: what stands in the article element."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in H.main_text(df).collect()}
    for r in df.collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html or "", re.S)
        body = re.sub(r"<(?!/?b>|br>)/?[a-z0-9]+[^>]*>", "\n\0\n", m[1]) if m else ""
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in body.split("\n\0\n")]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_edges(table):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", "<article><p>" + "x " * 200000), (3, "w", "plain text without any markup at all, but long enough to be kept as a text"), (4, "z", "<article><p>cut &am"), (5, "z", "<article><p>cut <div cla")]
    got = {r.page_id: r.text for r in H.main_text(table(rows, schema=SCHEMA)).collect()}
    assert got[1] == got[None] == "" and len(got[2]) == 399999 and got[4] == "cut &am" and got[5] == "cut"
    assert H.main_text(table([], schema=SCHEMA)).count() == 0
