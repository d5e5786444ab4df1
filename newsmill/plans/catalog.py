"""One query per operator, each over whole tables of ``sf_dir``."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import spread
from newsmill.functions.text import clean_text, ratio, title_words
from newsmill.functions.urls import canonical_url, host_of
from newsmill.operators import articles, lifecycle, links, logs, messages, perf, retries, rules, runs, structure, summaries, toplists
from newsmill.plans import bindings as b
from newsmill.plans import flow
from newsmill.session import run_dir, ship_package
from newsmill.sources import events as ev
from newsmill.sources import concurrency, history, mime, pages as pg, payloads, versions as kept_versions
from newsmill.streaming import jobs, monitor, notified

QUERIES = {}


def prepare(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)


def query(*tables):
    """Register a query; its function receives the named tables."""

    def add(fn):
        def run(spark, sf_dir):
            prepare(spark)
            return fn(*[b.table(spark, sf_dir, t) for t in tables])

        QUERIES[fn.__name__] = run
        return fn

    return add


def stream_query(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def r(c, digits=6):
    return F.round(c, digits)


def epoch(c):
    return F.unix_timestamp(c)


# --- sources ------------------------------------------------------------------

@query("documents")
def event_records(documents):
    return ev.event_records(b.notifications(documents))


@query("documents")
def event_rejects(documents):
    return ev.event_rejects(b.notifications(documents))


@query("documents")
def trigger_response(documents):
    out = ev.trigger_response(b.notifications(documents))
    listed = F.array_join(F.transform("results", lambda x: F.concat(x["bucket"], F.lit("/"), x["key"])), "|")
    return out.select("event_id", "status_code", "message", "processed_records", "execution_time", listed.alias("results"))


@query("documents")
def raw_object_decode(documents):
    out = ev.raw_object_decode(b.raw_objects(documents))
    return out.select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"), "reject_reason")


@query("events")
def object_errors(events):
    coded = events.select("event_id", b.cycle(["NoSuchKey", "NoSuchBucket", "AccessDenied", "SlowDown"], F.floor("value")).alias("error_code"))
    return ev.object_errors(coded)


@query("documents")
def execution_input(documents):
    at = documents.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 61))
    out = ev.execution_input(at, "text", "source", F.col("doc_id").cast("string"), "ts").drop("source")
    out = out.select("doc_id", F.md5("payload").alias("digest"), "timestamp", F.get_json_object("input_json", "$.source").alias("origin"),
                     F.col("s3.bucket").alias("bucket"), F.get_json_object("input_json", "$.s3.key").alias("key"))
    return out


@stream_query
def stream_ingest(spark, sf_dir):
    source = jobs.table_stream(spark, sf_dir, "documents.parquet")
    objects = source.select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = jobs.stream_ingest(spark, objects)
    return out.select("doc_id", "path", F.md5("text").alias("digest"), "reject_reason")


@query("documents")
def stream_objects(documents):
    """Objects stored and notified in two rounds, the second one naming those of the
    first again; the stream runs after each."""
    spark = documents.sparkSession
    records = ev.event_records(b.notifications(documents)).withColumnRenamed("event_id", "doc_id")
    objects = records.join(b.raw_objects(documents), "doc_id")
    root, log, out = (run_dir(spark, name) for name in ("store", "log", "taken"))
    first = notified.store_objects(objects.where(b.every(2, "doc_id")), root)
    notified.announce(first, log)
    notified.ingest_notified(spark, log, root, out)
    second = notified.store_objects(objects.where(~b.every(2, "doc_id")), root)
    notified.announce(second.unionByName(spark.read.parquet(f"{log}/{0:012d}")), log)
    taken = notified.ingest_notified(spark, log, root, out)
    return taken.select("bucket", "key", F.length("text").alias("n"), F.md5("text").alias("digest"), "reject_reason")


@stream_query
def stream_dedup(spark, sf_dir):
    source = jobs.table_stream(spark, sf_dir, "events.parquet")
    twice = source.withColumn("read", F.explode(F.array(F.lit(1), F.lit(2))))
    out = jobs.stream_dedup(spark, twice, ["event_id"], "ts")
    return out.select("event_id", "user_id", "event_type")


@query("conversations")
def payload_normalize(conversations):
    out = payloads.payload_normalize(b.payloads(conversations))
    return out.select("conv_id", "turn", F.md5("content").alias("digest"), "reject_reason")


@query("documents")
def newsletter_emails(documents):
    out = b.mails(documents)
    return out.select("email_id", "variant", "encoding", "n_articles", F.length("html").alias("n"), F.md5("html").alias("digest"),
                      F.md5("text").alias("text_digest"))


@query("documents")
def mime_html_part(documents):
    out = mime.mime_html_part(b.mails(documents), keep=("email_id", "variant"))
    return out.select("email_id", "variant", "content_type", "encoding", F.length("html").alias("n"), F.md5("html").alias("digest"))


# --- pages ----------------------------------------------------------------------

NODE_ANCESTORS = ["html", "head", "body", "nav", "ul", "li", "article", "div", "footer", "p"]


@query("pages")
def html_nodes(pages):
    nodes = pg.html_nodes(pages, tags=["p", "a", "li", "h1"])
    count = lambda t: F.count_if(F.col("tag") == t).alias(f"n_{t}")
    heading = F.max(F.when(F.col("tag") == "h1", F.col("text_strip"))).alias("heading")
    return nodes.groupBy("page_id").agg(*[count(t) for t in ("p", "a", "li", "h1")], heading)


@query("pages")
def node_pairs(pages):
    nodes = pg.html_nodes(pages.select("page_id", "html"))
    return structure.descendants(nodes, NODE_ANCESTORS, ["p", "a", "li", "h1", "b"], presorted=True)


@query("pages")
def strip_boilerplate(pages):
    out = articles.strip_boilerplate("html")
    return pages.select("page_id", F.length(out).alias("n"), F.md5(out).alias("digest"))


@query("pages")
def page_title(pages):
    return articles.page_title(pages)


@query("pages")
def page_content(pages):
    return articles.page_content(pages).select("page_id", F.length("content").alias("n"), F.md5("content").alias("digest"))


@query("pages")
def page_content_once(pages):
    out = articles.page_content(pages, nested="innermost")
    return out.select("page_id", F.length("content").alias("n"), F.md5("content").alias("digest"))


@query("documents")
def clean_text_query(documents):
    tail = b.cycle(["", " Follow", "Sign up ", " Sign in"], F.col("doc_id"))
    out = clean_text(F.concat("text", tail))
    return documents.select("doc_id", F.length(out).alias("n"), F.md5(out).alias("digest"))


QUERIES["clean_text"] = QUERIES.pop("clean_text_query")


@query("pages")
def page_article(pages):
    out = articles.page_article(pages)
    return out.select("page_id", "url", "title", "title_len", "content_len", F.md5("content").alias("digest"), "reject_reason")


# --- links ------------------------------------------------------------------------

@query("pages")
def anchors(pages):
    return links.anchors(pages)


PAGE_SKIP = ["cheap-pills", "spam-farm", r"\.html$"]
PAGE_ACCEPT = [r"/[a-z]{2}/\d+"]


@query("pages")
def link_filter(pages):
    return links.link_filter(pages, skip=PAGE_SKIP, accept=PAGE_ACCEPT).select("page_id", "url")


@query("pages")
def link_rules(pages):
    """A rule table as large as the pages have hosts: names of sites, and one pattern each."""
    return rules.link_rules(pages, b.host_rules(pages))


@query("pages")
def link_filter_by_table(pages):
    return rules.link_filter_by_table(pages, b.host_rules(pages))


@query("pages")
def url_canonicalize(pages):
    bare = F.substring_index("url", "#", 1)
    extra = b.cycle(["", "utm_medium=mail&id=5&b=", "q=a%20b&REF=z&c=1+2", "a=1&a=2&a=&d=4"], F.col("page_id"))
    url = F.when(extra == "", F.col("url")).otherwise(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), extra, F.lit("#end")))
    return pages.select("page_id", canonical_url(url).alias("url"))


@query("pages")
def url_allowlist(pages):
    out = links.url_allowlist(pages, hosts=["blog.example.com", "m.example.net"], suffix=".example.org")
    return out.select("page_id", "url", "valid", "reason")


@query("documents")
def section_links(documents):
    return links.section_links(b.mails(documents)).drop("block_id", "pos")


@query("documents")
def link_title(documents):
    own = F.when(b.every(2, "doc_id"), "Read more").otherwise(F.col("text"))
    up = F.concat(own, F.lit("\n by someone else entirely\n"), "text")
    heads = [F.when(b.every(3, "doc_id"), "A heading above"), F.when(b.every(2, "doc_id"), "Another heading")]
    rows = documents.select("doc_id", own.alias("own"), F.when(b.every(5, "doc_id"), up).otherwise("short").alias("up"),
                            heads[0].alias("h1"), heads[1].alias("h2"))
    return rows.select("doc_id", links.digest_title("own", "up", F.array("h1", "h2")).alias("title"),
                       links.own_title("own").alias("general_title"))


@query("documents")
def link_author(documents):
    lead = b.cycle(["by Jane Roe in Some Pub, 5 min ", "By  Ana|", "@handle_1.x ", ""], F.col("doc_id"))
    rows = documents.select("doc_id", F.concat(lead, F.col("text")).alias("block"), F.when(b.every(10, "doc_id"), "Profile Name").alias("profile"))
    return rows.select("doc_id", links.digest_author("profile", "block").alias("author"), links.general_author("block").alias("general_author"))


@query("pages")
def first_seen_dedup(pages):
    rows = b.host_anchors(pages).select("host", "href", "page_id", "pos", "text")
    return links.first_seen_dedup(rows, ["host", "href"], ["page_id", "pos"])


@query("documents")
def section_union_fallback(documents):
    return links.section_union_fallback(b.mails(documents)).drop("block_id", "pos")


@query("documents")
def article_defaults(documents):
    i = F.col("doc_id")
    part = lambda on, text: F.when(on, text)
    fields = F.concat_ws(
        ",",
        F.concat(F.lit('"url":"u'), i, F.lit('"')),
        part(~b.every(3, "doc_id"), F.concat(F.lit('"title":"'), F.col("source"), F.lit("-"), i, F.lit('"'))),
        part(b.every(5, "doc_id"), F.lit('"content":null')),
        part(~b.every(4, "doc_id"), F.concat(F.lit('"author":"'), F.col("lang"), F.lit('"'))),
    )
    rows = documents.select(i, F.concat(F.lit("{"), fields, F.lit("}")).alias("record_json"))
    return summaries.article_defaults(rows).drop("record_json")


# --- resolving ------------------------------------------------------------------------

STATUSES = [200, 200, 429, 401, 403, 500, 503, 404, 301, None]  # null: no answer


def answered(pages):
    return pages.select("page_id", b.cycle(STATUSES, F.length("html") % 17).alias("status"))


@query("pages")
def response_class(pages):
    return articles.response_class(answered(pages))


@query("pages")
def article_join(pages):
    made = flow.links_from_pages(pages)
    dead = made.withColumn("url", F.when(b.every(10, "pos"), F.concat("url", F.lit("-gone"))).otherwise(F.col("url")))
    crawl = pages.select("url", F.explode(F.array(F.lit(1), F.lit(2))).alias("fetched_at"), "page_id", "html")
    crawl = crawl.select("url", "fetched_at", "page_id", F.concat(F.lit("v"), "fetched_at", F.lit("-"), "page_id").alias("title"), F.length("html").cast("string").alias("content"))
    return articles.article_join(dead, crawl, order=("fetched_at", "page_id"))


@query("pages")
def fetch_partition(pages):
    rows = pages.select("page_id", "url", F.when(~b.every(6, "page_id"), F.concat(F.lit("t"), "page_id")).alias("title"),
                        F.when(b.every(12, "page_id"), "HTTP 500").alias("error"))
    return articles.fetch_partition(rows)


# --- summaries ------------------------------------------------------------------------

def titled(documents):
    title = F.when(~b.every(9, "doc_id"), F.concat("source", F.lit(" "), "doc_id")).otherwise("")
    return documents.select("doc_id", title.alias("title"), F.when(~b.every(8, "doc_id"), F.col("text")).otherwise("").alias("content"), "lang", "source")


@query("documents")
def required_fields(documents):
    return summaries.required_fields(titled(documents)).select("doc_id", "reject_reason")


@query("documents")
def prompt_build(documents):
    out = summaries.prompt_build(titled(documents))
    return out.select("doc_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query("documents")
def summarize(documents):
    out = summaries.summarize(documents, "text")
    return out.select("doc_id", F.length("summary").alias("n"), F.md5("summary").alias("digest"))


@query("conversations")
def response_text(conversations):
    text = F.struct(F.concat(F.lit("  "), "text", F.lit("\n ")).alias("text"))
    full = F.to_json(F.struct(F.struct(F.struct(F.array(text).alias("content")).alias("message")).alias("output")))
    doc = (
        F.when(b.every(5, "turn"), full).when(b.every(5, "turn", 1), '{"output":{"message":{"content":[]}}}')
        .when(b.every(5, "turn", 2), '{"output":{}}').when(b.every(5, "turn", 3), '{"output":{"message":{"content":[{"text":5}]}}}')
        .when(b.every(2, "conv_id"), "{broken")
    )
    return summaries.response_text(conversations.select("conv_id", "turn", doc.alias("response_json"))).select("conv_id", "turn", F.md5("summary").alias("digest"))


@query("documents")
def fallback_summary(documents):
    rows = titled(documents).select("doc_id", "title", F.when(b.every(3, "doc_id"), "  \n").when(b.every(5, "doc_id"), F.lit(None)).otherwise(F.col("content")).alias("summary"),
                                    b.every(7, "doc_id").alias("failed"))
    return summaries.fallback_summary(rows).select("doc_id", "summary", "summary_source")


@query("events")
def service_error_class(events):
    codes = [*dims.SERVICE_ERRORS, "SomethingElse"]
    return summaries.service_error_class(events.select("event_id", b.cycle(codes, F.floor("value")).alias("error_code")))


@query("documents")
def slim_projection(documents):
    rows = documents.select(F.concat(F.lit("u"), "doc_id").alias("url"), F.concat("source", F.lit(" "), "doc_id").alias("title"),
                            F.col("lang").alias("author"), F.col("text").alias("summary"), F.upper("text").alias("content"))
    return summaries.slim_projection(rows)


# --- messages ----------------------------------------------------------------------------

def message_inputs(documents):
    return spread(documents.select("doc_id", "source", "text")).select(
        "doc_id", F.when(b.every(9, "doc_id"), "  ").otherwise(F.concat(F.lit("  "), "source", F.lit(" *"), "doc_id", F.lit("*\n"))).alias("title"),
        F.when(b.every(6, "doc_id"), F.lit(None)).otherwise(F.concat(F.lit("\t"), "text")).alias("summary"),
        F.when(b.every(5, "doc_id"), "").otherwise(F.concat(F.lit("https://example.org/"), F.col("doc_id") % 50)).alias("url"),
    )


@query("documents")
def article_message(documents):
    return messages.article_message(message_inputs(documents)).select("doc_id", "message", "reject_reason")


@query("documents")
def message_payload(documents):
    plain = documents.select("doc_id", F.concat(F.lit("note "), "doc_id", F.lit(" "), "source", F.lit(" 🔗：")).alias("message"))
    return messages.message_payload(plain).select("doc_id", "payload", F.col("payload_bytes").cast("long").alias("payload_bytes"))


@query("pages")
def delivery_class(pages):
    return messages.delivery_records(messages.delivery_class(answered(pages)))


@query("pages")
def webhook_rule(pages):
    """Addresses that a message may be sent to."""
    url = F.when(~b.every(7, "page_id"), F.col("url"))
    return pages.select("page_id", messages.webhook_allowed(url, "https://").alias("allowed"))


@query("documents")
def article_input(documents):
    """Articles as events, bare or wrapped, some without a member."""
    i = F.col("doc_id")
    members = F.struct(F.concat(F.lit("https://example.org/"), i).alias("url"), F.when(~b.every(3, "doc_id"), F.col("source")).alias("title"), F.col("text").alias("summary"))
    doc = F.when(b.every(5, "doc_id"), F.to_json(F.struct(members.alias("article")))).when(b.every(7, "doc_id"), "[1]").otherwise(F.to_json(members))
    out = messages.article_input(documents.select("doc_id", doc.alias("event_json")))
    return out.select("doc_id", "url", "title", F.md5("summary").alias("digest"))


@query("documents")
def message_sink(documents):
    good = messages.article_message(message_inputs(documents)).where("message IS NOT NULL").select("url", "message")
    folder = f"{run_dir(good.sparkSession, 'messages')}/delivered"
    messages.message_sink(good, folder)
    return messages.message_sink(good, folder).select("message_key", "url", F.md5("message").alias("digest"))


@stream_query
def stream_messages(spark, sf_dir):
    """The same messages as a stream, delivered twice over by two runs."""
    source = jobs.table_stream(spark, sf_dir, "documents.parquet")
    good = messages.article_message(message_inputs(source)).where("message IS NOT NULL").select("url", "message")
    folder = run_dir(spark, "messages")
    for run in range(2):
        jobs.stream_messages(good, f"{folder}/delivered", f"{folder}/state-{run}")
    sent = messages.on_record(spark, f"{folder}/delivered", "message_key string, url string, message string")
    return sent.select("message_key", "url", F.md5("message").alias("digest"))


# --- runs ------------------------------------------------------------------------------------

def run_items(documents):
    i = "doc_id"
    return documents.select(
        F.col("source").alias("run_id"), (~b.every(3, i) & (F.col("source") != "src3")).alias("fetched"),
        (~b.every(4, i)).alias("summarised"), (~b.every(5, i)).alias("delivered"),
    )


@query("documents")
def run_outcome(documents):
    names = documents.select(F.explode(F.array("source", F.concat(F.lit("none-"), "source"))).alias("run_id")).distinct()
    all_runs = names.select("run_id", F.col("run_id").isin("src4", "none-src5").alias("parse_failed"),
                            (F.col("run_id") == "src6").alias("fetch_critical"), (F.col("run_id") == "src7").alias("summarize_critical"))
    return runs.run_outcome(run_items(documents), all_runs)


def failing_items(documents):
    status = b.cycle(["ok", "ok", "failed", "failed_summary", "summary_success_slack_failed", None], F.col("doc_id"))
    return documents.select(F.col("source").alias("run_id"), status.alias("item_status"),
                            F.when(~status.eqNullSafe("ok"), F.concat(F.lit("error "), F.col("doc_id") % 4)).alias("error"))


@query("documents")
def partial_failures(documents):
    return runs.partial_failures(failing_items(documents))


@query("documents")
def partial_failure_errors(documents):
    return runs.partial_failure_errors(failing_items(documents))


@query("documents")
def result_response(documents):
    n = documents.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("articles_processed"), F.sum("n_chars").alias("c"), F.min("doc_id").alias("m"))
    rows = n.select("source", (F.col("m") % 2 == 0).alias("success"), "articles_processed",
                    F.when(F.col("m") % 2 == 1, F.array(F.lit("late"), F.lit("lost"))).otherwise(F.array().cast("array<string>")).alias("errors"),
                    (F.col("c") / 1024).alias("execution_time"))
    out = runs.result_response(rows)
    field = lambda k: F.get_json_object("body", f"$.{k}")
    return out.select("source", "status_code", field("message").alias("message"), field("articlesProcessed").cast("long").alias("articles"),
                      field("errors").alias("errors"), r(field("executionTime").cast("double")).alias("seconds"))


@query("events")
def error_response(events):
    rows = events.select("event_id", b.cycle([*dims.STAGE_ERRORS, "other"], F.col("event_id")).alias("kind"), F.col("event_type").alias("context"),
                         F.concat(F.lit("user "), "user_id").alias("message"))
    return runs.error_response(rows).drop("context", "message")


@query("events")
def retry_schedule(events):
    named = events.select("event_id", b.cycle([p[0] for p in dims.RETRY_POLICIES], F.floor("value")).alias("policy"))
    out = retries.retry_schedule(retries.with_policy(named))
    waits = F.array_join(F.transform("delays", lambda d: d.cast("int").cast("string")), ",")
    return out.select("event_id", "policy", waits.alias("delays"), "total_wait")


@query("events")
def retry_outcome(events):
    kind = {"error": "NetworkError", "view": "ValueError", "purchase": "RateLimitError", "signup": "ValidationError"}
    error = F.lit(None).cast("string")
    for name, value in kind.items():
        error = F.when(F.col("event_type") == name, value).otherwise(error)
    log = events.select(F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"),
                        "ts", F.col("event_id").alias("seq"), error.alias("error_type"))
    return retries.retry_outcome(log)


# --- logs ------------------------------------------------------------------------------------

@query("events")
def log_parse(events):
    i = F.col("event_id")
    body = F.concat(F.lit('{"level":"'), "event_type", F.lit('","message":"m'), i, F.lit('","context":'), "props", F.lit(',"execution_time":'), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("}"))
    line = F.when(b.every(7, "event_id"), F.concat(F.lit("plain text "), i)).when(b.every(11, "event_id"), F.concat(F.lit('{"level":'), i)).otherwise(body)
    out = logs.log_parse(events.select("event_id", line.alias("line")))
    return out.select("event_id", "line", "is_structured", "level", "message", F.col("context")["k"].alias("k"), "execution_time")


@query("events")
def log_build(events):
    rows = b.errors(events)
    made = logs.log_build(rows.withColumn("context", F.create_map(F.lit("user"), F.col("user_id").cast("string"))), seconds="value",
                          metrics=F.when(b.every(2, "event_id"), F.create_map(F.lit("n"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    return made.select("event_id", "record_json")


@query("events")
def error_category(events):
    return logs.error_category(b.errors(events)).select("event_id", "error_category")


@query("events")
def alert_feed(events):
    return logs.alert_feed(b.errors(events)).select("event_id", "alert_severity", "emoji", "color")


@query("events")
def alert_format(events):
    return logs.alert_format(b.errors(events)).select("event_id", F.length("alert_text").alias("n"), F.md5("alert_text").alias("digest"))


@query("events")
def alert_payload(events):
    """The chat message of every alert, with its text."""
    alerts = logs.alert_format(logs.alert_feed(b.errors(events)))
    return logs.alert_payload(alerts, "newsmill").select("event_id", "alert_severity", "payload")


@query("events")
def alert_suggestions(events):
    return logs.alert_suggestions(b.errors(events)).select("event_id", "suggestion")


@query("events")
def checkpoint_offsets(events):
    return logs.checkpoint_offsets(*b.user_days(events))


@query("events")
def stage_durations(events):
    marks, days = b.user_days(events)
    named = marks.withColumn("name", F.concat(b.cycle(["fetch", "parse", "send"], F.col("event_id")), b.cycle(["_start", "_complete"], F.floor(F.col("event_id") / 3))))
    return logs.stage_durations(named, days)


@query("events")
def metrics_last(events):
    marks, _ = b.user_days(events)
    return logs.metrics_last(marks.select("run_id", "name", "value", "ts", "seq"))


@query("events")
def metrics_merge(events):
    """Each event's metrics over those of a run, the event's own winning."""
    base = F.create_map(F.lit("type"), "event_type", F.lit("user"), F.col("user_id").cast("string"))
    own = F.when(b.every(3, "event_id"), F.create_map(F.lit("user"), F.lit("own"), F.lit("extra"), F.col("event_id").cast("string")))
    maps = events.select("event_id", base.alias("base"), F.coalesce(own, F.create_map().cast("map<string,string>")).alias("own"))
    entries = F.array_sort(F.map_entries(logs.merge_metrics("base", "own")))
    return maps.select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


@query("events")
def error_rates(events):
    rows = logs.error_category(b.errors(events))
    out = logs.error_rates(rows, "ts", "error_category")
    return out.select(epoch("period_start").alias("period_start"), "error_category", "n_errors", r("share").alias("share"))


@query("events")
def top_errors(events):
    """The five most frequent messages of every day and category."""
    rows = logs.error_category(b.errors(events)).where("error_category IS NOT NULL")
    named = rows.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "error_category", F.col("event_type").alias("function"),
                        F.concat(F.lit("user "), F.col("user_id") % 50, F.lit(": "), "error_message").alias("message"))
    return toplists.top_items(named, ["day", "error_category"], ["function", "message"], 5)


# --- analytics ---------------------------------------------------------------------------------

def rounded(df, *names):
    return df.withColumns({n: r(n) for n in names})


@query("events")
def timing_summary(events):
    return rounded(perf.timing_summary(b.timed(events), "level", "value"), "mean", "median", "min", "max", "stdev")


def level_throughput(events):
    return perf.throughput_success(b.timed(events))


@query("events")
def throughput_success(events):
    return rounded(level_throughput(events), "wall_seconds", "mean_success_seconds", "max_success_seconds", "success_rate", "throughput")


@query("events")
def scaling_factors(events):
    summary = b.timed(events).groupBy("level").agg(F.avg("value").alias("mean"))
    return rounded(perf.scaling_factors(summary), "mean", "factor", "efficiency")


def by_day(events):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    per = b.timed(events).groupBy(day, "level").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return per.select("day", "level", F.round(F.col("n") / F.greatest("s", F.lit(1.0)), 3).alias("throughput"))


@query("events")
def optimal_level(events):
    return perf.optimal_level(by_day(events), by=["day"])


@query("events")
def degradation_trend(events):
    return rounded(perf.degradation_trend(by_day(events), by=["day"]), "trend")


@query("events")
def execution_monitor(events):
    out = perf.execution_monitor(b.executions(events), "2024-01-10 00:00:00", ["test"])
    return rounded(out, *[c for c in out.columns if c.endswith("_seconds") or c == "success_rate"])


@stream_query
def stream_execution_monitor(spark, sf_dir):
    """Each state of an execution in three polls that overlap."""
    polls = b.executions(jobs.table_stream(spark, sf_dir, "events.parquet")).withColumn("poll", F.explode(F.array(*map(F.lit, range(3))))).drop("poll")
    out = monitor.stream_execution_monitor(polls, "2024-01-10 00:00:00", ["test"])
    return rounded(out, "mean_seconds", "min_seconds", "max_seconds", "stdev_seconds", "median_seconds", "success_rate")


@query("events")
def execution_monitor_overall(events):
    out = perf.execution_monitor(b.executions(events), "2024-01-10 00:00:00", [])
    return rounded(out, *[c for c in out.columns if c.endswith("_seconds") or c == "success_rate"])


@query("events")
def max_concurrent(events):
    return perf.max_concurrent(b.timed(events), ["event_type"])


@query("events")
def max_concurrent_overall(events):
    return perf.max_concurrent(b.timed(events))


@query("events")
def concurrency_history(events):
    """Peaks by day, from three batches that all touch the same days."""
    rows = b.timed(events).select("event_id", "event_type", "start_ts", "stop_ts")
    folder = run_dir(events.sparkSession, "concurrency")
    for k in range(3):
        concurrency.add(rows.where(b.every(3, "event_id", k)), folder, k, ["event_type"])
    return concurrency.by_day(events.sparkSession, folder)


@query("events")
def concurrency_stats(events):
    return rounded(perf.concurrency_stats(b.executions(events), ["test"]), "efficiency", "mean_seconds", "duration_stddev")


@query("events")
def concurrency_stats_overall(events):
    return rounded(perf.concurrency_stats(b.executions(events), []), "efficiency", "mean_seconds", "duration_stddev")


@query("events")
def stability_band(events):
    return rounded(perf.stability_band(b.timed(events), "user_id", by=["level"]), "mean_rate", "min_rate")


@query("events")
def load_summary(events):
    rows = b.timed(events).select(F.col("level").alias("test"), "start_ts", "stop_ts", F.col("success").alias("uploaded"), (~b.every(9, "event_id")).alias("succeeded"))
    out = perf.load_summary(rows)
    return rounded(out, "elapsed_seconds", "mean_upload_seconds", "max_upload_seconds", "success_rate", "actual_rate", "error_rate")


@query("events")
def rate_windows(events):
    out = perf.rate_windows(b.timed(events), target_per_second=0.004)
    return out.select(epoch("period_start").alias("period_start"), "n", r("per_second").alias("per_second"), "met_target")


@query("events")
def rate_profiles(events):
    """Every load profile: windows of its length against its rate."""
    out = None
    for k, (seconds, rate) in enumerate(dims.RATE_PROFILES):
        rows = perf.rate_windows(b.timed(events), period=f"{seconds} seconds", target_per_second=rate).withColumn("profile", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out.select("profile", epoch("period_start").alias("period_start"), "n", r("per_second").alias("per_second"), "met_target")


@stream_query
def stream_rate_windows(spark, sf_dir):
    source = jobs.table_stream(spark, sf_dir, "events.parquet")
    out = jobs.stream_rate_windows(spark, source.select("event_id", "ts"))
    return out.select(epoch("period_start").alias("period_start"), "n")


@query("events")
def error_overhead(events):
    return rounded(perf.error_overhead(b.timed(events), ["level"], "value"), "ok_mean", "error_mean", "overhead_percent")


@query("documents")
def resource_ratio(documents):
    rows = documents.select("doc_id", (F.col("n_chars") * 1000).alias("bytes"), F.lit(1.5).alias("before"), (F.length("text") / 256.0).cast("double").alias("after"))
    return rounded(perf.resource_ratio(rows, "bytes", "before", "after"), "size_mb", "increase_mb", "efficiency").select("doc_id", "size_mb", "increase_mb", "efficiency")


@query("pages")
def size_profile(pages):
    rows = pages.select(F.substring_index("url", ":", 1).alias("scenario"), F.col("html").alias("text"), (F.col("page_id") % 5 + 1).cast("double").alias("seconds"))
    return rounded(perf.size_profile(rows, seconds="seconds"), "mean_length", "items_per_second")


@query("events", "documents")
def perf_flags(events, documents):
    wall = perf.seconds_between(F.min("start_ts"), F.max("stop_ts"))
    summary = b.timed(events).groupBy("level").agg(F.avg("value").alias("mean"), ratio(F.count(F.lit(1)), wall).alias("throughput"))
    single = F.when(F.col("level") == 1, F.col("mean"))
    levels = {"worst_scaling": "factor", "best_throughput": "throughput", "single_item_mean": single}
    memory = {"memory_increase": F.col("n_chars") / 1024.0}
    return rounded(perf.perf_flags((perf.scaling_factors(summary), levels), (documents, memory)), "value")


@query("orders")
def suite_report(orders):
    speed = F.when(F.col("o_orderpriority") < "2", "fast").when(F.col("o_orderpriority") < "4", "medium").otherwise("slow")
    rows = orders.select(F.col("o_orderkey").cast("string").alias("suite"), speed.alias("category"), (F.col("o_orderstatus") != "F").alias("success"),
                         (F.col("o_totalprice") / 1000).alias("seconds"), (F.col("o_custkey") % 50).alias("tests_run"),
                         F.floor(F.col("o_custkey") % 50 / 2).cast("long").alias("tests_passed"))
    return rounded(perf.suite_report(rows), "mean_seconds", "total_seconds", "suite_pass_rate", "test_pass_rate")


@query("lineitem")
def test_log_counts(lineitem):
    n = lambda c: F.col(c).cast("int").cast("string")
    full = F.concat(n("l_quantity"), F.lit(" passed, "), n("l_linenumber"), F.lit(" failed, "), F.col("l_suppkey") % 7, F.lit(" skipped in 1.5s"))
    line = F.when(b.every(3, "l_partkey"), full).when(b.every(3, "l_partkey", 1), F.concat(n("l_quantity"), F.lit(" passed"), b.cycle(["", "\r", "\t "], F.col("l_suppkey")))).otherwise("no summary")
    rows = lineitem.select(perf.summary_line(F.concat(F.lit("collected\n"), line, F.lit("\ndone"))).alias("line"))
    kinds = ["tests_passed", "tests_failed", "tests_skipped", "tests_run"]
    named = lambda df, mode: df.withColumnsRenamed({k: f"{mode}_{k}" for k in [*kinds, "tests_error"]})
    both = named(perf.test_log_counts(named(perf.test_log_counts(rows, line="line"), "tolerant"), line="line", strict=True), "strict")
    modes = ["tolerant", "strict"]
    sums = both.agg(*[F.sum(f"{m}_{k}").alias(f"{m}_{k}") for m in modes for k in kinds])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{m}_{k}").alias(k) for k in kinds]) for m in modes])))


@query("events")
def report_rows(events):
    timed = b.timed(events).withColumn("test", F.col("user_id"))
    per = timed.groupBy("test", "level").agg(F.avg(F.col("success").cast("double")).alias("success_rate"), ratio(F.count(F.lit(1)), perf.seconds_between(F.min("start_ts"), F.max("stop_ts"))).alias("throughput"), F.avg("value").alias("mean_seconds"))
    return rounded(perf.report_rows(per), "success_rate", "throughput", "mean_seconds")


@query("events")
def latency_percentiles(events):
    return rounded(perf.latency_percentiles(events, ["event_type"], "value"), "p50", "p90", "p95", "p99")


@query("events")
def latency_percentiles_overall(events):
    return rounded(perf.latency_percentiles(events, [], "value"), "p50", "p90", "p95", "p99")


@query("events")
def latency_history(events):
    """Percentiles of all days and of a week, from three batches of stored values."""
    rows = events.select("event_id", "event_type", "ts", "value")
    folder, points, out = run_dir(events.sparkSession, "latency"), {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, None
    for k in range(3):
        history.add(rows.where(b.every(3, "event_id", k)), folder, k, ["event_type"], "value")
    for span, edges in {"all": (), "week": ("2024-01-08", "2024-01-15")}.items():
        part = history.stored_quantiles(events.sparkSession, folder, points, *edges).withColumn("span", F.lit(span))
        out = part if out is None else out.unionByName(part)
    return rounded(out, *points)


@query("lineitem")
def price_percentiles(lineitem):
    return rounded(perf.latency_percentiles(lineitem, ["l_returnflag"], "l_extendedprice"), "p50", "p90", "p95", "p99")


# --- lifecycle ------------------------------------------------------------------------------------

def versions(orders):
    return orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").cast("timestamp").alias("modified_ts"))


@query("orders")
def retention_plan(orders):
    out = lifecycle.retention_plan(versions(orders), "2001-06-01 00:00:00")
    return out.select("key", "version", "is_current", epoch("next_ts").alias("next_ts"), "action")


@query("orders")
def latest_version(orders):
    return lifecycle.latest_version(versions(orders)).select("key", "version", epoch("modified_ts").alias("modified_ts"))


@query("orders")
def version_history(orders):
    """The retention plan after three batches of versions."""
    folder = run_dir(orders.sparkSession, "versions")
    for k in range(3):
        kept_versions.add(versions(orders.where(b.every(3, "o_orderkey", k))), folder, k)
    out = kept_versions.plan(orders.sparkSession, folder, "2001-06-01 00:00:00")
    return out.select("key", "version", "is_current", epoch("next_ts").alias("next_ts"), "action")


@query("part")
def type_rollup(part):
    return lifecycle.type_rollup(part, "p_type", ("p_name", "p_partkey"))


@query("events")
def scalar_helpers(events):
    """Title case, ellipsis and host on columns of their own."""
    return events.select("event_id", title_words(F.concat("event_type", F.lit("_by_user"))).alias("title"),
                         host_of(F.concat(F.lit("https://"), "event_type", F.lit(".example.org/x?y"))).alias("host"))


# --- flow --------------------------------------------------------------------------------------------

def flow_messages(pages):
    return flow.article_messages(flow.links_from_pages(pages), pages.withColumn("fetched_at", F.col("page_id")))


@query("pages")
def article_flow(pages):
    out = flow_messages(pages)
    return out.select("run_id", "url", "author", "pos", "title", F.md5("summary").alias("summary_digest"), F.md5("message").alias("digest"), "item_status")


@query("pages")
def article_flow_runs(pages):
    return flow.run_report(flow_messages(pages))
