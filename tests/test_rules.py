import re
import time

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.operators import links
from newsmill.operators.rules import RuleSet, fold, link_filter_by_table, link_rules, required_piece

SCHEMA = "kind string, rule string, pattern string"


def test_required_piece():
    cases = {
        r"a\.b": ("a.b", True), "cheap-pills": ("cheap-pills", True), r"/[a-z]{2}/\d+": ("/", False), "abc?d": ("ab", False),
        "ab*": ("a", False), "abc+de": ("abc", False), "a{0,3}bc": ("bc", False), r"x|y": ("", False), "(?i)a": ("", False),
        r"[\]a]bc": ("", False), r"[]a]bc": ("bc", False), r"[^]a]bc": ("bc", False), r"\x41bc": ("", False), r"\(ab": ("(ab", True), r"ABC$": ("abc", False),
    }
    assert {p: required_piece(p) for p in cases} == cases


@given(st.from_regex(r"(a|b|\.|\\\.|\[ab\]|\[\^a\]|\\d|\\w)([*+?]|\{0,2\})?", fullmatch=True), st.lists(st.sampled_from(["a", r"\.", "b+", "[ab]", "A?", r"\d*"]), max_size=4), st.text("abAB.1", max_size=12))
def test_every_match_holds_the_piece(head, tail, text):
    pattern = head + "".join(tail)
    found = re.search(pattern, text, re.ASCII | re.IGNORECASE)
    piece, plain = required_piece(pattern)
    assert not found or piece in fold(text)
    assert not plain or (found is not None) == (piece in fold(text))


def test_the_fixed_rules_as_a_table(spark):
    urls = ["https://medium.com/@a.b/some-title-abc123", "https://MEDIUM.com/pub/x-1f", "https://help.medium.com/a/b", "https://medium.com/", "https://x.medium.com/a.png",
            "https://cdn-images-1.medium.com/a/b", "https://fake-medium.com/x/y", "", None, "https://medium.com/plans", "https://medium.com/pub/x-1f"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    table = [("skip", f"s{i}", p) for i, p in enumerate(dims.LINK_SKIP_PATTERNS)] + [("accept", f"a{i}", p) for i, p in enumerate(dims.LINK_ACCEPT_PATTERNS)]
    rules = spark.createDataFrame(table, SCHEMA)
    want = sorted(r.page_id for r in links.link_filter(df).collect())
    assert sorted(r.page_id for r in link_filter_by_table(df, rules).collect()) == want and want


def test_least_rule_over_several_lists(spark):
    """A table beyond the limit is dealt into lists; no rule is left out."""
    rules = spark.range(500).select(F.lit("skip").alias("kind"), F.format_string("r%03d", "id").alias("rule"), F.format_string("/%d/", "id").alias("pattern"))
    df = spark.range(600).select("id", F.format_string("https://h/%d/%d/", "id", F.lit(499) - F.col("id")).alias("url"))
    one, many = (sorted(map(tuple, link_rules(df, rules, keep=("id",), limit=n).collect())) for n in (1000, 60))
    assert one == many
    assert [r[2] for r in one] == [f"r{min(i, 499 - i):03d}" if i < 500 else None for i in range(600)]


def test_ten_thousand_rules_cost_about_what_twenty_do():
    urls = [f"https://host{i}.example.com/en/{i}?page=2" for i in range(20000)]

    def cost(n):
        rules = RuleSet([(f"r{i}", rf"//site{i}\.example\.net/[a-z]+") for i in range(n)])
        times = []
        for _ in range(3):
            start = time.process_time()
            assert not any(rules.first(u) for u in urls)
            times.append(time.process_time() - start)
        return min(times)

    assert cost(10000) < 4 * cost(20)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "page_id int, url string")
    assert [r.skip_rule for r in link_rules(df, empty).collect()] == [None] * 3
    odd = spark.createDataFrame([("skip", None, "a"), ("skip", "x", None), ("skip", "y", ""), (None, "z", "a"), ("skip", "ok", "A"), ("skip", "ok", "A")], SCHEMA)
    assert sorted((r.page_id, r.skip_rule) for r in link_rules(df, odd).collect() if r.skip_rule) == [(1, "ok")]
    assert link_rules(df.limit(0), odd).count() == 0
