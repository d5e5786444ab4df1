import json
from datetime import datetime

from pyspark.sql import functions as F

from newsmill.operators import logs, messages, retries, runs, summaries


def test_messages(spark):
    df = spark.createDataFrame(
        [(0, "Rivers in spring", "A summary.", "https://example.org/t"), (1, "  Lake  ", "  About a lake  ", "  https://example.org/t  "),
         (2, "", "s", "u"), (3, "   ", "s", "u"), (4, "t", "", "u"), (5, "t", None, "u"), (6, "t", "s", " "), (7, None, None, None)],
        "i int, title string, summary string, url string")
    rows = messages.article_message(df).orderBy("i").collect()
    assert rows[0].message == "📌 *Rivers in spring*\n\n📝 A summary.\n\n🔗 link：https://example.org/t"
    assert rows[1].message == "📌 *Lake*\n\n📝 About a lake\n\n🔗 link：https://example.org/t"
    assert [r.reject_reason for r in rows] == [None, None, "title", "title", "summary", "summary", "url", "title"]


def test_message_sink_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "delivered")
    df = spark.createDataFrame([("u1", "m1"), ("u1", "m1"), ("u2", "m2")], "url string, message string")
    assert messages.message_sink(df, path).count() == 2
    more = df.union(spark.createDataFrame([("u3", "m3")], df.schema))
    assert messages.message_sink(more, path).count() == 3
    assert messages.message_sink(more, path).count() == 3


def test_sink_with_sender_and_batches(spark, tmp_path):
    def send(batches):
        for pdf in batches:
            yield pdf.assign(delivery=["ok" if u == "u1" else "retryable" for u in pdf.url])

    path = str(tmp_path / "sent")
    df = spark.createDataFrame([("u1", "m1"), ("u2", "m2")], "url string, message string")
    messages.message_sink(df, path, 0, send)
    messages.message_sink(df, path, 0, send)  # replay of the same batch
    out = messages.message_sink(df, path, 1, send)
    assert sorted((r.url, r.delivery) for r in messages.delivery_records(out).collect()) == [("u1", "ok"), ("u2", "retryable")]


def test_failed_delivery_is_sent_again(spark, tmp_path):
    def send(outcome):
        def run(batches):
            for pdf in batches:
                yield pdf.assign(delivery=[outcome] * len(pdf))

        return run

    path, df = str(tmp_path / "again"), spark.createDataFrame([("u1", "m1")], "url string, message string")
    assert [r.delivery for r in messages.message_sink(df, path, 0, send("retryable")).collect()] == ["retryable"]
    assert [r.delivery for r in messages.message_sink(df, path, 1, send("ok")).collect()] == ["ok"]
    assert [r.delivery for r in messages.message_sink(df, path, 2, send("fatal")).collect()] == ["ok"]


def test_missing_status_and_level(spark):
    from newsmill.operators import articles

    df = spark.createDataFrame([(None,), (200,)], "status int")
    assert [tuple(r) for r in articles.response_class(df).collect()] == [(None, "network", True, "external_service", 500), (200, "ok", False, None, 200)]
    assert [r.delivery for r in messages.delivery_class(df).collect()] == ["retryable", "ok"]
    items = spark.createDataFrame([("r", None, "e"), ("r", "ok", None)], "run_id string, item_status string, error string")
    assert runs.partial_failures(items).first().n_failed == 1 and runs.partial_failure_errors(items).count() == 1
    feed = spark.createDataFrame([(None, None, None, True)], "level string, severity string, suppressed boolean, notify boolean")
    assert logs.alert_feed(feed).count() == 1


def test_responses(spark):
    docs = ['{"output":{"message":{"content":[{"text":"  hi \\n"}]}}}', '{"output":{"message":{"content":[]}}}', '{"output":{}}', "{}",
            '{"output":{"message":{"content":"x"}}}', '{"output":{"message":{"content":[{"text":5}]}}}', "broken", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, response_json string")
    assert [r.summary for r in summaries.response_text(df).orderBy("i").collect()] == ["hi"] + [""] * 7


def test_prompt_and_fallback(spark):
    df = spark.createDataFrame([(0, "T", "A" * 4000), (1, "T", ""), (2, "T", "A" * 3000)], "i int, title string, content string")
    prompts = [r.prompt for r in summaries.prompt_build(df).orderBy("i").collect()]
    assert "Article Content:\n" + "A" * 3000 + "...\n" in prompts[0] and "Article Content:\n\n" in prompts[1] and "..." not in prompts[2]
    blank = df.select("i", F.lit("").alias("title"), F.lit(" ").alias("summary"), F.lit(False).alias("failed"))
    assert summaries.fallback_summary(blank).first().summary.startswith("Summary unavailable for ''. The article")


def test_summarizer_plugin(spark):
    def shout(batches):
        for pdf in batches:
            yield pdf.assign(summary=pdf.content.str.upper())

    df = spark.createDataFrame([("abc. d! e? f.",)], "content string")
    assert summaries.summarize(df).first().summary == "abc. d! e?"
    assert summaries.summarize(df, summarizer=shout, schema="content string, summary string").first().summary == "ABC. D! E? F."


def test_long_text_without_sentence_end(spark):
    df = spark.range(1).select(F.repeat(F.lit("word "), F.lit(60000)).alias("content"))
    assert summaries.summarize(df).first().summary == ""


def test_article_defaults(spark):
    df = spark.createDataFrame([('{"url":"u","title":null}',), ("{}",), ("broken",)], "record_json string")
    rows = summaries.article_defaults(df).drop("record_json").collect()
    assert [tuple(r) for r in rows] == [("u", None, "", "", ""), ("",) * 5, ("",) * 5]


def plan(spark, n, base, factor, cap):
    df = spark.createDataFrame([(n, base, factor, cap)], "retries int, base double, factor double, cap double")
    r = retries.retry_schedule(df).first()
    return r.delays, r.total_wait


def test_retry_schedule(spark):
    assert plan(spark, 3, 1.0, 2.0, 60.0) == ([1, 2, 4], 7)
    assert plan(spark, 5, 1.0, 2.0, 3.0) == ([1, 2, 3, 3, 3], 12)
    assert plan(spark, 0, 1.0, 2.0, None) == ([], 0)
    assert plan(spark, 5, 10.0, 2.0, None)[0] == [10, 20, 40, 80, 160]


def test_retry_outcome(spark):
    cases = {
        "ok_after_two": (["NetworkError", "RateLimitError", None], ("success", 3, 3.0)),
        "fatal": (["ValidationError", None], ("failed", 1, 0.0)),
        "unclassified_twice": (["ValueError", "ValueError", None], ("failed", 2, 1.0)),
        "unclassified_once": (["ValueError", None], ("success", 2, 1.0)),
        "late_unclassified": (["NetworkError", "ValueError", None], ("failed", 2, 1.0)),
        "exhausted": (["NetworkError"] * 6, ("failed", 4, 7.0)),
        "running": (["NetworkError"], ("pending", 1, 0.0)),
        "extra_rows": ([None, None], ("success", 1, 0.0)),
    }
    rows = [(k, i, i, e) for k, (errors, _) in cases.items() for i, e in enumerate(errors)]
    df = spark.createDataFrame(rows, "request_id string, ts int, seq int, error_type string")
    got = {r.request_id: (r.status, r.attempts, r.waited) for r in retries.retry_outcome(df).collect()}
    assert got == {k: want for k, (_, want) in cases.items()}


def test_run_outcome_cases(spark):
    names = ["empty", "none", "good", "parse", "fetch", "sum"]
    all_runs = spark.createDataFrame([(n, n == "parse", n == "fetch", n == "sum") for n in names],
                                     "run_id string, parse_failed boolean, fetch_critical boolean, summarize_critical boolean")
    items = spark.createDataFrame([("none", False, False, False), ("good", True, False, False), ("good", True, True, True), ("good", False, True, True),
                                   ("parse", True, True, True), ("fetch", True, True, True), ("sum", True, True, True)],
                                  "run_id string, fetched boolean, summarised boolean, delivered boolean")
    got = {r.run_id: (r.status_code, r.total_links, r.articles_processed, r.error) for r in runs.run_outcome(items, all_runs).collect()}
    assert got == {"empty": (200, 0, 0, None), "none": (206, 1, 0, "All article fetch attempts failed"), "good": (200, 3, 2, None),
                   "parse": (400, 1, 0, None), "fetch": (500, 1, 0, None), "sum": (500, 1, 0, None)}


def test_error_categories(spark):
    cases = [("ValidationError", "", "Invalid input", "input_validation"), ("AuthenticationError", "", "Auth failed", "authentication"),
             ("NetworkError", "", "Connection failed", "external_service"), ("RateLimitError", "", "Rate limited", "external_service"),
             ("Exception", "", "Unknown error", "unknown"), ("Exception", "", "Connection lost", "network"),
             ("ClientError", "AuthFailure", "", "authentication"), ("ClientError", "LimitExceeded", "", "rate_limit"), ("ClientError", "X", "network", "external_service")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, error_type string, error_code string, error_message string, want string")
    df = df.withColumn("category", F.lit(None).cast("string"))
    assert all(r.error_category == r.want for r in logs.error_category(df).collect())


def alert(spark, **given):
    base = dict(severity="ERROR", message="m", error_type=None, error_message=None, category=None, context=[], ts=datetime(2024, 1, 2, 3, 4, 5))
    row = {**base, **given}
    row["context"] = [(i, k, v) for i, (k, v) in enumerate(row["context"])]
    df = spark.createDataFrame([tuple(row[k] for k in base)], "severity string, message string, error_type string, error_message string, category string, "
                               "context array<struct<pos int, key string, value string>>, ts timestamp")
    return logs.alert_format(df).first().alert_text.split("\n")


def test_alert_text(spark):
    assert alert(spark, message="Validation failed", error_type="ValidationError", error_message="Invalid input data", category="input_validation") == [
        "*Severity:* ERROR", "*Message:* Validation failed", "*Error Type:* ValidationError", "*Error Details:* Invalid input data",
        "*Category:* Input Validation", "*Timestamp:* 2024-01-02T03:04:05Z", "*Suggested Actions:* Check input data format and required fields"]
    lines = alert(spark, severity="CRITICAL", category="network", error_type="NetworkError", error_message="x",
                  context=[("function_name", "read_pages"), ("request_id", "r-77"), ("hint", "see the log"), ("url", "https://h/t"), ("level", "no")])
    assert "*Key Details:* Function Name: read_pages, Request Id: r-77, Url: https://h/t" in lines
    assert "*Additional Context:* Hint: see the log" in lines
    assert alert(spark, context=[("content", "x" * 150)])[-1] == "*Additional Context:* Content: " + "x" * 97 + "..."
    assert alert(spark) == ["*Severity:* ERROR", "*Message:* m", "*Timestamp:* 2024-01-02T03:04:05Z"]


def test_suggestion_suffixes(spark):
    df = spark.createDataFrame([("network", "TimeoutError"), ("x", "AccessDenied"), ("x", "NotFoundError"), (None, None)], "category string, error_type string")
    got = [r.suggestion for r in logs.alert_suggestions(df).collect()]
    assert [g.partition(", ")[2] for g in got] == ["increase timeout values", "check IAM roles and policies", "verify resource exists and paths are correct", ""]


def test_log_parse_keeps_broken_lines(spark):
    df = spark.createDataFrame([('{"level":"INFO","message":"m","context":{"a":1}}',), ("plain",), ('{"level":',), ("5",)], "line string")
    rows = logs.log_parse(df).collect()
    assert [(r.line, r.is_structured, r.level) for r in rows] == [
        ('{"level":"INFO","message":"m","context":{"a":1}}', True, "INFO"), ("plain", False, None), ('{"level":', False, None), ("5", True, None)]


def test_trackers(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    marks = spark.createDataFrame([("r", "fetch_start", at(1), 1), ("r", "fetch_start", at(2), 2), ("r", "fetch_complete", at(5), 3), ("r", "send_complete", at(9), 4)],
                                  "run_id string, name string, ts timestamp, seq int")
    days = spark.createDataFrame([("r", at(0), at(10))], "run_id string, start_ts timestamp, end_ts timestamp")
    got = {(r.name, r.offset_seconds, r.total_execution_time) for r in logs.checkpoint_offsets(marks, days).collect()}
    assert got == {("fetch_start", 2.0, 10.0), ("fetch_complete", 5.0, 10.0), ("send_complete", 9.0, 10.0)}
    assert {(r.stage, r.seconds, r.from_run_start) for r in logs.stage_durations(marks, days).collect()} == {("fetch", 3.0, False), ("send", 9.0, True)}


def test_merge_metrics(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) x, map('b', 3) y")
    assert df.select(logs.merge_metrics("x", "y").alias("m")).first().m == {"a": 1, "b": 3}


def test_article_input(spark):
    docs = ['{"article":{"url":"u","title":"t","summary":"s"}}', '{"url":"u","title":"t"}', "broken"]
    rows = messages.article_input(spark.createDataFrame([(d,) for d in docs], "event_json string")).collect()
    assert [(r.url, r.title, r.summary) for r in rows] == [("u", "t", "s"), ("u", "t", ""), ("", "", "")]


def test_alert_payload(spark):
    df = spark.sql("SELECT 'ERROR' level, 'CRITICAL' severity, false suppressed, true notify, timestamp'2024-01-01 00:00:00' ts, 'body' alert_text")
    got = json.loads(logs.alert_payload(logs.alert_feed(df), "App").first().payload)
    assert got["text"] == "🚨 CRITICAL Alert - App"
    assert got["attachments"] == [{"color": "danger", "fields": [{"title": "Error Details", "value": "body", "short": False}],
                                   "footer": "App Admin Notifications", "ts": 1704067200}]
