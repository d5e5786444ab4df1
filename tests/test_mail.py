import base64
import quopri
from html.entities import html5

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.operators import links
from newsmill.sources import pages
from newsmill.sources.mime import html_part

BODY = "<html><body>café = <a href='x'>y</a></body></html>"


def message(body, encoding, kind="text/html", multipart=True):
    part = f"Content-Type: {kind}; charset=UTF-8\r\nContent-Transfer-Encoding: {encoding}\r\n\r\n{body}\r\n"
    if not multipart:
        return "Subject: s\r\nMIME-Version: 1.0\r\n" + part
    return (
        "Subject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b1\r\n\r\n"
        f"--b1\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b1\r\n{part}--b1--\r\n"
    )


def qp(s):
    return quopri.encodestring(s.encode()).decode()


def b64(s):
    return base64.encodebytes(s.encode()).decode()


def test_encodings():
    for multipart in (True, False):
        assert html_part(message(qp(BODY), "quoted-printable", multipart=multipart))[2].strip() == BODY
        assert html_part(message(b64(BODY), "Base64", multipart=multipart))[2] == BODY
        assert html_part(message(BODY, "8bit", multipart=multipart))[2].strip() == BODY


def test_search_and_empty():
    assert html_part("just text <html><p class=3D\"x\">a</p></html>")[2] == '<html><p class="x">a</p></html>'
    assert html_part("just text <html><p>a</p></html>") == ("search", "", "<html><p>a</p></html>")
    assert html_part("https://medium.com/a/b")[2] == ""
    assert html_part("<HTML><p>a</p></HTML>")[2] == ""
    assert html_part(message("plain only", "7bit", kind="text/plain"))[2] == ""
    assert html_part(None) == (None, None, None)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\r\n"), min_size=1, max_size=60))
def test_round_trip(text):
    body = f"<p>{text}</p>"
    assert html_part(message(b64(body), "base64"))[2] == body
    assert html_part(message(qp(body), "quoted-printable"))[2].rstrip("\n") == body.rstrip("\n")


def mail(*sections):
    return "<html><body>" + "".join(sections) + "</body></html>"


def section(heading, *rows):
    return f'<div class="s"><div><h2>{heading}</h2></div><table>{"".join(rows)}</table></div>'


def row(url, title, tail="", profile=""):
    return f'<tr><td>{profile}<a href="{url}">{title}</a>{tail}</td></tr>'


U = "https://medium.com/@w/story-"


def found(spark, html, fn=links.section_union_fallback, **kw):
    df = spark.createDataFrame([(1, html)], "email_id int, html string")
    return [(r.section, r.url, r.title, r.author) for r in fn(df, **kw).orderBy("section_rank", "pos").collect()]


def test_sections(spark):
    html = mail(
        section(
            "Today&#x27;s Highlights",
            row(U + "1?source=mail", "The first long story title", "<p>by Jane Roe in Some Pub, 5 min</p>"),
            row(U + "2", "Read more", "<h3>A heading as the title</h3>@handle.x"),
            row("https://medium.com/plans/x", "Some membership offer text"),
            row(U + "3", "Short", "<p>x</p>"),
        ),
        section("From your  following",
                row(U + "4", "Another quite long title", profile='<a href="https://medium.com/@ann">Ann Profile</a>'),
                row(U + "1", "The first long story title again")),
    )
    assert found(spark, html) == [
        ("highlights", U + "1", "The first long story title", "Jane Roe"),
        ("highlights", U + "2", "A heading as the title", "handle.x"),
        ("following", U + "4", "Another quite long title", "Ann Profile"),
    ]


def test_outermost_attribution(spark):
    rows = row(U + "1", "The first long story title", "<p>by Jane Roe, x</p>") + row(U + "2", "The second long story title", "<p>by John Doe</p>")
    html = mail(section("today's highlights", f"<tr><td><table>{rows}</table></td></tr>"))
    inner = [a for *_, a in found(spark, html, links.section_links)]
    outer = [a for *_, a in found(spark, html, links.section_links, attribution="outermost")]
    assert inner == ["Jane Roe", "John Doe"] and len(set(outer)) == 1


def test_heading_at_top_level_searches_whole_mail(spark):
    html = f"<div>Today's highlights</div><div><a href='{U}1'>The first long story title</a></div>"
    assert [u for _, u, *_ in found(spark, html, links.section_links)] == [U + "1"]


def test_general_fallback(spark):
    html = mail(f"<p>by Jane Roe in Pub, now <a href='{U}1'>The first long story title</a></p>",
                f"<p><a href='{U}2'>Too short</a></p><p><a href='{U}2?ref=b'>A later and longer title</a></p>",
                "<a href='https://example.org/a/b'>An unrelated long title</a>")
    assert found(spark, html) == [
        ("general", U + "1", "The first long story title", "Jane Roe in Pub"),
        ("general", U + "2", "A later and longer title", "Unknown Author"),
    ]


def test_no_links(spark):
    assert found(spark, mail("<p>No articles today!</p>")) == []
    assert found(spark, None) == []


def test_mails_hold_whole_texts(spark):
    from newsmill.plans import bindings

    texts = [". ".join(f"Sentence {i} of {n}" for i in range(n)) + " and no full stop" for n in (1, 40, 200)] + ["?!", ""]
    docs = spark.createDataFrame([(6 * k, t, "src", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_chars int")
    mails = {r.email_id: r for r in bindings.mails(docs).collect()}
    for k, n in enumerate((1, 40, 200)):
        found = mails[6 * k]
        assert found.n_articles >= n and f"Sentence {n - 1} of {n} and no full stop" in found.html
        assert all(f"Sentence {i} of {n}" in found.html for i in range(n))
    assert "A document without a full sentence." in mails[24].html


def test_mails_of_a_file_with_one_split_are_spread(spark):
    from newsmill.plans import bindings

    docs = spark.createDataFrame([(i % 3, f"One sentence of {i}. Another one.", "s") for i in range(500)], "doc_id long, text string, source string").coalesce(1)
    n = spark.sparkContext.defaultParallelism
    tasks = bindings.mails(docs).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= n and max(t["count"] for t in tasks) <= 2 * 500 / n


def test_a_batch_is_decoded_in_blocks():
    from newsmill.sources import mime

    n = 3 * mime.BLOCK + 5
    batch = pa.RecordBatch.from_pydict({"email_id": list(range(n)), "_raw": [f"Content-Type: text/html\r\n\r\n<p>{i}</p>" for i in range(n)]})
    out = list(mime.decoder(("email_id",))(iter([batch])))
    assert [b.num_rows for b in out] == [mime.BLOCK] * 3 + [5]
    assert [r for b in out for r in zip(b["email_id"].to_pylist(), b["html"].to_pylist())] == [(i, f"<p>{i}</p>") for i in range(n)]


def test_mails_without_sections_are_not_parsed(spark, tmp_path):
    """Only mails that may have a section reach the parser; no link is lost by it."""
    link = f"<div><a href='{U}1'>The first long story title</a></div>"
    heads = ["Today's highlights", "FROM your\nFollowing", "Today's high&#108;ights", "Today's high</>lights", "Today&#x27;s highlight", "Nothing of that kind", "from your followin"]
    df = spark.createDataFrame([(i, f"<div>{h}</div>{link}") for i, h in enumerate(heads)] + [(90, None), (91, "")], "email_id int, html string")
    parsed = pages.html_tree(df, "html", ("email_id",), dims.SECTION_WORDS).select("email_id").collect()
    assert sorted(r[0] for r in parsed) == [0, 1, 2, 3, 4]
    assert sorted(r.email_id for r in links.section_links(df).collect()) == [0, 1, 2, 3, 4]
    words = {name: [w for w in dims.SECTION_WORDS if w in pattern] for name, _, pattern in dims.SECTIONS}
    assert all(words.values())


def test_no_named_reference_spells_a_section_word():
    assert [k for k, v in html5.items() if any(c.isascii() and c.isalpha() for c in v)] == ["fjlig;"]
    assert not any("fj" in w for w in dims.SECTION_WORDS) and all(html5.values())
