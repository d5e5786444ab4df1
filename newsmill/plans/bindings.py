"""Given tables -> operator inputs. Nothing here is part of an operator."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import spread
from newsmill.functions.text import SPACE, let
from newsmill.operators.links import anchors_native
from newsmill.sources.newsletters import VARIANTS, newsletter_emails

TYPES = ["ValidationError", "AuthenticationError", "NetworkError", "ClientError", "TimeoutError", "FileNotFoundError", "PermissionError"]
CODES = ["AuthFailure", "ThrottlingException", "InternalError", "RequestLimitExceeded", "ExpiredCredential"]
TEXTS = ["Invalid input", "Connection reset", "network unreachable", "boom"]
CATEGORIES = ["input_validation", "network", "rate_limit", "processing", "storage", "configuration"]


def table(spark, sf_dir, name):
    """A given table, with the splits its files have."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycle(values, n):
    """One of a few values by a number column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def every(n, c, rest=0):
    return F.col(c) % n == rest


def notifications(documents):
    """Events with 1 to 3 records; some break a rule."""
    i = F.col("doc_id")

    def record(k):
        return F.concat(
            F.lit('{"eventSource":"'), F.when(every(11, "doc_id") & (k == i % 3), "other").otherwise("aws:s3"),
            F.lit('","s3":{"bucket":{"name":"'), F.when(every(23, "doc_id"), "").otherwise(F.col("source")),
            F.lit('"},"object":{"key":"folder%2F'), i, F.lit("+"), F.col("lang"), F.lit("%20"), k, F.lit('.html"}}}'),
        )

    records = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), i % 3), record), ",")
    doc = (
        F.when(every(13, "doc_id"), '{"payload":1}').when(every(17, "doc_id"), '{"Records":[]}')
        .when(every(19, "doc_id"), '{"Records":5}').otherwise(F.concat(F.lit('{"Records":['), records, F.lit("]}")))
    )
    return documents.select(i.alias("event_id"), doc.alias("event_json"), (F.col("n_chars") / 1024).alias("seconds"))


def raw_objects(documents):
    """Texts as bytes: some blank, some in Latin-1 where the text allows it."""
    latin = every(4, "doc_id", 1) & F.col("text").rlike(r"\A[\x00-\xFF]*\z")
    text = F.when(every(29, "doc_id"), "  \n").otherwise(F.col("text"))
    content = F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return documents.select("doc_id", content.alias("content"))


def payloads(conversations):
    wrapped = lambda key: F.concat(F.lit('{"payload":'), F.to_json(F.struct(F.lit("").alias("body"), F.col("text").alias(key))), F.lit("}"))
    body = F.concat(F.lit('{"payload":'), F.to_json(F.struct(F.col("text").alias("body"), F.lit("x").alias("html"))), F.lit("}"))
    kind = F.col("turn") % 5
    doc = (
        F.when(every(7, "conv_id"), '{"data":1}').when(every(11, "conv_id"), '{"payload":{}}')
        .when(every(13, "conv_id"), '{"payload":"  "}').when(every(17, "conv_id"), "{broken")
        .when(every(19, "conv_id"), F.concat(F.lit('{"payload":{"zeta":'), F.col("turn"), F.lit(',"alpha":[{"y":1,"x":2}]}}')))
        .when(kind == 0, body).when(kind == 1, wrapped("content")).when(kind == 2, wrapped("html")).when(kind == 3, wrapped("message"))
        .otherwise(F.to_json(F.struct(F.col("text").alias("payload"))))
    )
    return conversations.select("conv_id", "turn", doc.alias("event_json"))


def mails(documents):
    """A mail per document with all its sentences, the last one finished or not, as
    articles; up to six more begin again with the first. A mail is far longer and dearer
    than its document, so the documents are spread first."""
    documents, i = spread(documents.select("doc_id", "text", "source")), F.col("doc_id")
    title = lambda s: F.trim(F.regexp_replace(s, rf"{SPACE}+", " "))
    seed = lambda s, k: F.struct(
        s.alias("title"), F.concat(F.lit("https://medium.com/@"), F.col("source"), F.lit("/doc"), i, F.lit("-"), k).alias("url"),
        s.alias("content"), F.concat(F.lit("Writer "), F.col("source")).alias("author"),
    )
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), 0), title), lambda s: s != "")
    spare = F.array(F.lit("A document without a full sentence."))
    sentences = let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(spare))
    shaped = documents.select(
        i.alias("email_id"), let(sentences, lambda f: F.transform(f, seed)).alias("seeds"), cycle(VARIANTS, i).alias("variant"),
        cycle(["quoted-printable", "base64", "7bit"], F.floor(i / 6)).alias("encoding"),
    )
    return newsletter_emails(shaped.withColumn("n_articles", (F.size("seeds") + F.col("email_id") % 7).cast("int")))


def host_anchors(pages):
    return anchors_native(pages.withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)), keep=("page_id", "host"))


def host_rules(pages):
    """Rules from the pages' own addresses: hosts with "www." or "-" are skipped by name,
    and every host has a pattern that accepts its numbered pages with a query."""
    host = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host")).where("host != ''").distinct()
    skip = host.where(F.col("host").startswith("www.") | F.col("host").contains("-")).select(F.lit("skip").alias("kind"), F.concat(F.lit("//"), F.upper("host"), F.lit("/")).alias("name"))
    accept = host.select(F.lit("accept").alias("kind"), F.concat("host", F.lit(r"/[a-z]{2}/\d+\?")).alias("name"))
    return skip.unionByName(accept).select("kind", F.col("name").alias("rule"), F.regexp_replace("name", r"(?<!\\)\.", r"\\.").alias("pattern"))


def timed(events):
    """Events with real timestamps, a level 1..5 and a stop time."""
    ts = F.col("ts").cast("timestamp")
    took = F.round(F.col("value") * 1000000).cast("long")
    return events.withColumns(
        {
            "ts": ts, "level": F.get_json_object("props", "$.k").cast("int") % 5 + 1,
            "start_ts": ts, "stop_ts": F.timestamp_micros(F.unix_micros(ts) + took),
            "success": F.col("event_type") != "error",
        }
    )


def executions(events):
    """Each event as an execution: first seen running, later in its final state."""
    status = cycle(["SUCCEEDED", "SUCCEEDED", "SUCCEEDED", "FAILED", "TIMED_OUT", "ABORTED", "RUNNING"], F.col("user_id"))
    base = timed(events).select(F.col("event_id").alias("execution_id"), F.col("event_type").alias("test"), "start_ts", "stop_ts", status.alias("final"))
    states = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("RUNNING").alias("status"), F.lit(None).cast("timestamp").alias("stop_ts")),
        F.struct(F.lit(2).alias("seq"), F.col("final").alias("status"), F.when(F.col("final") != "RUNNING", F.col("stop_ts")).alias("stop_ts")),
    )
    return base.select("execution_id", "test", "start_ts", F.explode(states).alias("s")).select("execution_id", "test", "start_ts", "s.*")


def errors(events):
    """Events with error types, codes, texts, context and severities."""
    i = F.col("event_id")
    context = F.array(
        F.struct(F.lit(2).alias("pos"), F.lit("note").alias("key"), F.repeat(F.lit("ab"), (i % 80).cast("int")).alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("request_id").alias("key"), F.concat(F.lit("req-"), F.col("user_id")).alias("value")),
        F.struct(F.lit(0).alias("pos"), F.lit("function_name").alias("key"), F.col("event_type").alias("value")),
        F.struct(F.lit(3).alias("pos"), F.lit("level").alias("key"), F.lit("hidden").alias("value")),
    )
    return events.select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value",
        F.when(~every(5, "event_id"), cycle(TYPES, i)).alias("error_type"), cycle(CODES, i).alias("error_code"),
        cycle(TEXTS, F.floor(i / 7)).alias("error_message"), F.when(every(3, "event_id"), cycle(CATEGORIES, i)).alias("category"),
        cycle(["INFO", "CRITICAL", "ERROR", "WARNING", "DEBUG"], F.col("user_id")).alias("level"),
        cycle(["ERROR", "WARNING", "NOTICE"], i).alias("severity"),
        every(4, "event_id").alias("suppressed"), every(6, "event_id").alias("notify"),
        F.concat(F.lit("event "), F.col("event_type")).alias("message"), context.alias("context"),
    )


def user_days(events):
    """Marks per user and day, and each day's run with its start and end."""
    marks = events.select(
        F.concat("user_id", F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("run_id"), F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value", "event_id",
    )
    runs = marks.groupBy("run_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return marks, runs
