"""The flow from links and crawled pages to messages and run accounting."""

from pyspark.sql import functions as F

from newsmill.functions.frames import explode_rows
from newsmill.functions.text import col, let
from newsmill.functions.urls import canonical_url, host_of
from newsmill.operators.articles import article_join, content_of, fetch_partition, title_of
from newsmill.operators.links import first_seen_dedup
from newsmill.operators.messages import article_message
from newsmill.operators.runs import run_outcome
from newsmill.operators.summaries import fallback_summary, lead_sentences
from newsmill.sources.pages import html_tree


def crawled_articles(pages, order="fetched_at"):
    """url, title, summary of every page that has both a title and content.

    The page is parsed where it is read and its text is reduced to the summary
    there, so no page text is shuffled; tree questions are asked once per page.
    """
    nodes, texts = F.col("nodes"), F.col("texts")
    found = let(
        F.struct(title_of(nodes, texts).alias("title"), content_of(nodes, texts).alias("content")),
        lambda a: F.when(
            a["title"].isNotNull() & a["content"].isNotNull(),
            F.struct(a["title"].alias("title"), lead_sentences(a["content"]).alias("summary")),
        ),
    )
    rows = explode_rows(html_tree(pages, keep=("url", order)), ["url", order], F.array(found))
    return rows.select("url", "r.title", "r.summary", order)


def article_messages(links, pages, run_id="run_id", order=("pos",)):
    """links(run_id, url, author, pos) and pages(url, html, fetched_at) ->
    one row per distinct link of a run with its message and item status.

    Shuffles: one to de-duplicate links, one per side for the URL join.
    """
    distinct = first_seen_dedup(links.withColumn("url", canonical_url("url")), [run_id, "url"], order)
    joined = article_join(distinct, crawled_articles(pages), carry=("title", "summary"), canonical_links=False)
    items = fetch_partition(joined.withColumn("error", F.lit("page not found")))
    named = fallback_summary(items.withColumn("failed", F.lit(False)))
    return article_message(named.drop("failed"))


def run_report(messages, run_id="run_id"):
    """Outcome of every run in a message table, in one aggregate over it."""
    items = messages.select(
        run_id, (F.col("item_status") == "ok").alias("fetched"), F.col("summary").isNotNull().alias("summarised"),
        F.col("message").isNotNull().alias("delivered"),
    )
    return run_outcome(items, run_id=run_id)


def links_from_pages(pages):
    """Link table for a crawl: each page's URL and a tracked copy, per host."""
    tracked = F.concat(
        F.substring_index("url", "#", 1), F.when(F.contains(F.substring_index("url", "#", 1), F.lit("?")), "&").otherwise("?"),
        F.lit("utm_source=mail&utm_medium=digest"),
    )
    return pages.select(
        host_of("url").alias("run_id"), F.explode(F.array(F.struct(F.lit(1).alias("k"), tracked.alias("url")), F.struct(F.lit(0).alias("k"), col("url").alias("url")))).alias("l"),
        F.concat(F.lit("author-"), F.col("page_id") % 7).alias("author"), "page_id",
    ).select("run_id", "l.url", "author", (F.col("page_id") * 2 + F.col("l.k")).alias("pos"))
