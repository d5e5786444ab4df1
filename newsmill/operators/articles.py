"""Page trees -> titles, contents, articles; links resolved against a crawl."""

from functools import reduce

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.text import clean_text, col, let
from newsmill.functions.urls import canonical_url
from newsmill.sources.pages import html_tree, inside, stripped_text


def _has_class(n, *names):
    return reduce(lambda a, b: a & b, [F.array_contains(n["classes"], name) for name in names])


def _testid(n, value):
    return F.coalesce(n["attrs"]["data-testid"] == value, F.lit(False))


# selector cascades, first match of every selector only
TITLE_SELECTORS = [
    lambda n: (n["tag"] == "h1") & _testid(n, "storyTitle"),
    lambda n: (n["tag"] == "h1") & _has_class(n, "graf--title"),
    lambda n: (n["tag"] == "h1") & _has_class(n, "p-name"),
    lambda n: n["tag"] == "h1",
    lambda n: n["tag"] == "title",
    lambda n: _testid(n, "storyTitle"),
    lambda n: _has_class(n, "graf--h3", "graf--leading"),
]
CONTENT_SELECTORS = [
    "article section",
    lambda n: _testid(n, "storyContent"),
    lambda n: _has_class(n, "postArticle-content"),
    lambda n: _has_class(n, "e-content"),
    lambda n: n["tag"] == "article",
    lambda n: _has_class(n, "section-content"),
    lambda n: _has_class(n, "story-content"),
]


def first_node(nodes, test):
    return F.try_element_at(F.filter(nodes, test), F.lit(1))


def _first_accepted(candidates, render):
    """First candidate for which ``render`` gives a value. Later ones are not
    evaluated, and the expression is built once for all of them."""
    return F.aggregate(
        F.array(*candidates), F.lit(None).cast("string"),
        lambda found, n: F.when(found.isNotNull() | n.isNull(), found).otherwise(render(n)),
    )


def title_of(nodes, texts):
    """First selector whose text is longer than 5, cleaned; null when none."""
    accept = lambda t: F.when(F.length(t) > 5, clean_text(t))
    found = [first_node(nodes, test) for test in TITLE_SELECTORS]
    return _first_accepted(found, lambda n: let(stripped_text(texts, n), accept))


def _outside_boilerplate(test):
    return lambda n: test(n) & ~n["boiler"]


def _section_in_article(nodes):
    """First ``section`` with an ``article`` around it."""
    articles = F.filter(nodes, lambda n: (n["tag"] == "article") & ~n["boiler"])
    return let(
        articles,
        lambda arts: first_node(
            nodes, lambda n: (n["tag"] == "section") & ~n["boiler"] & F.exists(arts, lambda a: inside(n, a))
        ),
    )


def _innermost(blocks):
    """Blocks that hold no other block: the next one starts after they end."""
    return F.filter(
        blocks,
        lambda b, i: F.coalesce(F.get(blocks, i + 1)["node_id"] > b["end_id"], F.lit(True)),
    )


def _block_text(texts, blocks, nested, longer_than):
    def render(bs):
        bs = bs if nested == "all" else _innermost(bs)
        parts = F.filter(F.transform(bs, lambda b: stripped_text(texts, b, body_only=True)), lambda t: F.length(t) > longer_than)
        return F.array_join(F.transform(parts, clean_text), "\n\n")

    return let(blocks, render)


def content_of(nodes, texts, nested="all"):
    """Text of the first container that yields more than 100 characters, else of
    all paragraphs longer than 20; null when nothing is left.

    ``nested="all"`` returns every block, so text of a block inside a block
    appears for both; ``"innermost"`` takes each text once.
    """

    containers = [
        _section_in_article(nodes) if s == "article section" else first_node(nodes, _outside_boilerplate(s))
        for s in CONTENT_SELECTORS
    ]
    blocks_in = lambda c: F.filter(
        nodes, lambda n: inside(n, c) & n["tag"].isin(dims.CONTENT_BLOCK_TAGS) & ~n["boiler"]
    )
    accept = lambda t: F.when(F.length(t) > 100, t)
    found = _first_accepted(containers, lambda c: let(_block_text(texts, blocks_in(c), nested, 5), accept))
    paragraphs = F.filter(nodes, lambda n: (n["tag"] == "p") & ~n["boiler"])
    fallback = F.nullif(_block_text(texts, paragraphs, nested, 20), F.lit(""))
    return F.coalesce(found, fallback)


def page_title(df, html="html", keep=("page_id",)):
    return html_tree(df, html, keep).select(*keep, title_of(F.col("nodes"), F.col("texts")).alias("title"))


def page_content(df, html="html", keep=("page_id",), nested="all"):
    return html_tree(df, html, keep).select(*keep, content_of(F.col("nodes"), F.col("texts"), nested).alias("content"))


def page_article(df, html="html", keep=("page_id", "url"), nested="all"):
    """url, title, content, lengths, or the reason there is no article.

    Each page is parsed once; both texts come from the same tree.
    """
    nodes, texts = F.col("nodes"), F.col("texts")
    out = html_tree(df, html, keep).select(
        *keep, title_of(nodes, texts).alias("title"), content_of(nodes, texts, nested).alias("content")
    )
    reason = F.when(F.col("title").isNull(), "no_title").when(F.col("content").isNull(), "no_content")
    return out.select(
        *keep, "title", "content",
        F.length("title").alias("title_len"), F.length("content").alias("content_len"), reason.alias("reject_reason"),
    )


def strip_boilerplate(c):
    """HTML text without boilerplate elements; one native replace per tag."""
    out = col(c)
    for tag in dims.BOILERPLATE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", "")
    return out


# --- resolving ---------------------------------------------------------------

def response_class(df, status="status"):
    """HTTP status -> kind, retryable, category, status code of the stage."""
    s = col(status)
    # no status: a timeout or a refused connection, which may pass
    kind = (
        F.when(s.isNull(), "network").when(s == 429, "rate_limit").when(s.isin(401, 403), "authentication")
        .when(s >= 500, "server").when(s != 200, "http_error").otherwise("ok")
    )
    category = (
        F.when(s == 429, "rate_limit").when(s.isin(401, 403), "authentication").when(s.isNull() | (s != 200), "external_service")
    )
    return (
        df.withColumn("kind", kind)
        .withColumn("retryable", s.isNull() | ((s != 200) & ~s.isin(401, 403)))
        .withColumn("category", category)
        .withColumn("stage_status", F.when(s == 200, 200).when(s.isin(401, 403), 401).otherwise(500))
    )


def latest_snapshot(articles, url="url", order=("fetched_at",)):
    """Newest row per URL. ``max_by`` combines before the shuffle, so a URL that
    was crawled very often costs one row per task, not a long group."""
    rest = [c for c in articles.columns if c != url]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("s")
    return articles.groupBy(url).agg(newest).select(url, "s.*")


def article_join(links, articles, order=("fetched_at",), carry=("title", "content"), canonical_links=True):
    """Links left-joined to crawled articles on the canonical URL.

    URL, author and section come from the link, the ``carry`` columns from the
    page. Join the extracted article texts, never raw HTML. A link target that
    takes a large share of all links is split by the adaptive skew join: the key
    of the snapshots is written anew after their aggregate, so that a shuffle
    stands directly under both sides, without which no partition is split.
    """
    newest = latest_snapshot(articles.select(canonical_url("url").alias("_page"), *carry, *order), "_page", order)
    newest = newest.withColumn("_page", F.concat("_page", F.lit("")))
    # the canonical form decodes values, so it must be taken once only
    keyed = links.withColumn("url", canonical_url("url")) if canonical_links else links
    kept = [c for c in keyed.columns if c not in carry]
    joined = keyed.select(*kept).join(newest, F.col("url") == F.col("_page"), "left")
    return joined.select(*kept, *carry, F.col("_page").isNotNull().alias("matched"))


def fetch_partition(df, title="title", error="error"):
    """Adds item ``status`` ok / failed (a title means success) and its error."""
    ok = col(title).isNotNull()
    return df.withColumn("item_status", F.when(ok, "ok").otherwise("failed")).withColumn(
        "error", F.when(~ok, F.coalesce(col(error), F.lit("unknown error")))
    )
