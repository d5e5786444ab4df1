from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions import text, urls


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_clean_text(spark):
    given_ = ["A  first\n\n\nand second\n   and third", "Worth a look Follow", "InterestSign up", None, "   ",
              "InterestFollow", "x Sign in", "Follow me", "a  b", "x Follow Sign up Sign in"]
    assert apply(spark, text.clean_text, given_) == [
        "A first and second and third", "Worth a look", "Interest", "", "", "Interest", "x", "Follow me", "a b",
        "x Follow Sign up",
    ]


def test_strip_and_ellipsis(spark):
    assert apply(spark, text.strip, ["  a b\x1c\n", "", "\n", "a" + " " * 50000 + "b "]) == ["a b", "", "", "a" + " " * 50000 + "b"]
    assert apply(spark, lambda c: text.ellipsis(c, 100, 97), ["x" * 100, "x" * 101]) == ["x" * 100, "x" * 97 + "..."]


CANONICAL = {
    "https://h/p?source=x&a=1#f": "https://h/p?a=1",
    "https://h/p?a=1&a=2&b=": "https://h/p?a=1&2",
    "https://h/p?q=a%20b&REF=z": "https://h/p?q=a b",
    "/rel/path": ":///rel/path",
    "HTTPS://Host/Path;x=1?utm_source=q": "https://Host/Path",
    "https://h/a;b/c?x=1+2&y": "https://h/a;b/c?x=1 2",
    "https://h/p?b=1&a=2&b=3": "https://h/p?b=1&3&a=2",
    "https://h/p?a=%zz%20": "https://h/p?a=%zz ",
    "": "",
    "http://[bad/x": "http://[bad/x",
    "https://h": "https://h",
    "https://h/p?x=a=b": "https://h/p?x=a=b",
}


def test_canonical_cases(spark):
    assert apply(spark, urls.canonical_url, list(CANONICAL)) == list(CANONICAL.values())
    assert apply(spark, urls.canonical_url, [None]) == [""]


def test_canonical_strict(spark):
    strict = lambda c: urls.canonical_url(c, strict=True)
    assert apply(spark, strict, ["https://h/p?a=1&a=2&q=a%20b&ref=z#f"]) == ["https://h/p?a=1&a=2&q=a%20b"]


piece = st.text(st.sampled_from("abZ09-._~%+;:@/ é"), max_size=6)
pair = st.tuples(st.sampled_from(["a", "b", "ref", "UTM_Source", "x y", "%61"]), piece).map("=".join)
made_url = st.tuples(
    st.sampled_from(["http://", "https://", "HTTP://", "//", "/", ""]), st.sampled_from(["h.org", "Me.com:80", ""]),
    piece.map(lambda p: "/" + p), st.lists(pair, max_size=4).map("&".join), st.sampled_from(["", "#x", "#?y"]),
).map(lambda t: t[0] + t[1] + t[2] + ("?" + t[3] if t[3] else "") + t[4])


# no shrinking: every example is a Spark job over a batch of URLs
@settings(max_examples=3, deadline=None, database=None, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(made_url, min_size=150, max_size=150))
def test_canonical_properties(spark, values):
    values = [v for v in values if v]
    for given_, got in zip(values, apply(spark, urls.canonical_url, values)):
        keys = {part.partition("=")[0].lower() for part in got.partition("?")[2].split("&")}
        assert not keys & set(dims.TRACKING_PARAMS)
        if given_.startswith(("http://h.org/", "https://h.org/")):
            assert got.startswith(given_.partition("h.org")[0] + "h.org/")


LINKS = {
    "https://medium.com/@a/some-title-abc123": True,
    "https://pub.medium.com/some-title": True,
    "http://medium.com/pub/story": True,
    "https://fake-medium.com/x/y": True,
    "https://help.medium.com/a/b": False,
    "https://miro.medium.com/a/b.png": False,
    "https://medium.com/me/settings": False,
    "https://medium.com/plans/x": False,
    "https://medium.com/": False,
    "https://medium.com/about": False,
    "https://MEDIUM.com/Pub/Story": True,
    "https://medium.com/pub/app.JS": False,
    "": False,
    None: False,
}


def test_link_rules(spark):
    assert apply(spark, urls.is_article_link, list(LINKS)) == list(LINKS.values())


def test_pair_map(spark):
    assert apply(spark, text.pair_map, ["sid=abc; uid = 1 ;x", "a=1;a=2; b=c=d", "", None]) == [
        {"sid": "abc", "uid": "1"}, {"a": "2", "b": "c=d"}, {}, {}]
