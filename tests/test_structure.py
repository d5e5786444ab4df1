import pytest
from pyspark.sql import functions as F

from newsmill.operators.structure import descendants
from newsmill.sources.pages import html_nodes

PAGES = [
    (1, "<div><ul><li><a href=x>1</a><ul><li><a>2</a></ul></li></ul><p>t</div><a>3</a>"),
    (2, "<ul></ul><a></a>"),
    (None, "<ul><a></a></ul>"),
    (3, None),
    (4, "<ul>" * 3 + "<a></a>" * 2),
]
ANCESTORS, TAGS = ["ul", "div", "li"], ["a", "li"]


def by_range(nodes):
    a = nodes.select(F.col("page_id").alias("k"), F.col("node_id").alias("ancestor_id"), F.col("end_id").alias("e"), F.col("tag").alias("ancestor_tag"))
    d = nodes.select("page_id", "node_id", "tag").where(F.col("tag").isin(TAGS))
    hit = F.col("k").eqNullSafe(F.col("page_id")) & (F.col("node_id") > F.col("ancestor_id")) & (F.col("node_id") <= F.col("e"))
    return a.where(F.col("ancestor_tag").isin(ANCESTORS)).join(d, hit).select("page_id", "ancestor_id", "ancestor_tag", "node_id", "tag")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("presorted", [True, False])
def test_equals_the_range_join(spark, presorted):
    nodes = html_nodes(spark.createDataFrame(PAGES, "page_id long, html string"))
    given = nodes if presorted else nodes.orderBy(F.rand(1))
    got = descendants(given, ANCESTORS, TAGS, presorted=presorted)
    assert rows(got) == rows(by_range(nodes)) and got.count() > 10


def test_repeated_pages_stay_apart(spark):
    one = spark.createDataFrame([PAGES[0]], "page_id long, html string").coalesce(1)
    twice = one.select("page_id", F.explode(F.array("html", "html")).alias("html"))
    pairs = lambda df: descendants(html_nodes(df), ANCESTORS, TAGS, presorted=True).count()
    assert pairs(twice) == 2 * pairs(one)


def test_a_page_longer_than_a_batch(spark):
    """Stack and page go on from one Arrow batch to the next."""
    page = spark.createDataFrame([(1, "<ul>" + "<li><a></a></li>" * 30000 + "</ul><a></a>")], "page_id long, html string")
    got = descendants(html_nodes(page), ["ul"], ["a"], presorted=True)
    assert got.count() == got.select("node_id").distinct().count() == 30000


def test_no_range_join_and_text_is_not_read(spark):
    nodes = html_nodes(spark.createDataFrame(PAGES, "page_id long, html string"))
    plan = descendants(nodes, ANCESTORS, TAGS, presorted=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "regexp_replace" not in plan


def test_edges(spark):
    schema = "page_id string, node_id int, end_id int, tag string"
    assert descendants(spark.createDataFrame([], schema), ["ul"], ["a"]).count() == 0
    some = spark.createDataFrame([("p", 0, 2, "ul"), ("p", None, 2, "a"), ("p", 1, None, "a"), ("p", 2, 2, "a"), ("p", 3, 3, "a")], schema)
    assert [tuple(r) for r in descendants(some, ["ul"], ["a"]).collect()] == [("p", 0, "ul", 2, "a")]
