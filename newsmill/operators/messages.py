"""Article -> chat message, payload, delivery outcome, idempotent sink."""

import os

from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsmill.functions.text import col, is_blank, strip
from newsmill.sources import ledger

# --- fixed values: message layout -------------------------------------------
PIN, NOTE, LINK = "\U0001F4CC *", "*\n\n\U0001F4DD ", "\n\n\U0001F517 link："


def article_message(df, title="title", summary="summary", url="url"):
    """Adds ``message`` and ``reject_reason`` (first blank of title, summary, url)."""
    reason = F.when(is_blank(title), "title").when(is_blank(summary), "summary").when(is_blank(url), "url")
    text = F.concat(F.lit(PIN), strip(title), F.lit(NOTE), strip(summary), F.lit(LINK), strip(url))
    return df.withColumn("reject_reason", reason).withColumn("message", F.when(F.col("reject_reason").isNull(), text))


def article_input(df, event="event_json"):
    """Adds url, title, summary of an event that is the article or wraps it in
    ``article``; '' for missing members."""
    doc = F.try_parse_json(col(event))
    wrapped = F.schema_of_variant(F.try_variant_get(doc, "$.article", "variant")).startswith("OBJECT")
    member = lambda k: F.when(F.coalesce(wrapped, F.lit(False)), F.try_variant_get(doc, f"$.article.{k}", "string")).otherwise(
        F.try_variant_get(doc, f"$.{k}", "string")
    )
    return df.withColumns({k: F.coalesce(member(k), F.lit("")) for k in ("url", "title", "summary")})


def message_payload(df, message="message"):
    """Adds ``payload`` ({"summary": message}) and its size in UTF-8 bytes."""
    return df.withColumn("payload", F.to_json(F.struct(col(message).alias("summary")))).withColumn(
        "payload_bytes", F.octet_length("payload")
    )


def delivery_class(df, status="status"):
    """Adds ``delivery``: ok, retryable (429, 5xx, no answer) or fatal."""
    s = col(status)
    return df.withColumn("delivery", F.when(s == 200, "ok").when(s.isNull() | (s == 429) | (s >= 500), "retryable").otherwise("fatal"))


def webhook_allowed(url, prefix):
    return F.coalesce(col(url).startswith(prefix), F.lit(False))


def delivery_records(df, delivery="delivery"):
    """Adds ``item_status``: a failed delivery is recorded, not fatal."""
    return df.withColumn("item_status", F.when(col(delivery) == "ok", "ok").otherwise("summary_success_slack_failed"))


def with_message_key(df, url="url", message="message"):
    return df.withColumn("message_key", F.sha2(F.concat(F.coalesce(col(url), F.lit("")), col(message)), 256))


def undelivered(df, delivered=None):
    """Messages whose key has no final delivery (ok, fatal) in the ``delivered`` table,
    once per key; where that table has no deliveries, a recorded key is final."""
    keyed = with_message_key(df)
    rest = [c for c in keyed.columns if c != "message_key"]
    once = keyed.groupBy("message_key").agg(F.min(F.struct(*rest)).alias("m")).select("message_key", "m.*")
    return once if delivered is None else once.join(final(delivered), "message_key", "left_anti")


def final(delivered):
    """Keys that need no more sending."""
    if "delivery" in delivered.columns:
        delivered = delivered.where("delivery IN ('ok', 'fatal')")
    return delivered.select("message_key")


def outcomes(sent):
    """One row per message of the attempts on record: the final one, else any."""
    if "delivery" not in sent.columns:
        return sent
    rest = [c for c in sent.columns if c != "message_key"]
    rank = F.struct((F.col("delivery") != "ok").alias("a"), (F.col("delivery") != "fatal").alias("b"), *rest)
    return sent.groupBy("message_key").agg(F.min_by(F.struct(*rest), rank).alias("m")).select("message_key", "m.*")


def message_sink(df, path, batch_id=None, sender=None):
    """Append messages without a final delivery; once all have one, running it again
    writes nothing. Returns one row per message on record. A retryable failure is sent
    again, so delivery is at least once.

    The record is a ledger (``sources.ledger``) by message key: a call reads of it what
    its own keys may meet, and adds its rows in one commit. ``sender`` is an optional
    mapInPandas function that sends and returns the rows with a ``delivery`` column; the
    schema is the input plus that column. A batch with a ``batch_id`` replaces what it
    wrote before, so a restarted stream leaves each message once.
    """
    spark = df.sparkSession
    path = absolute(path)
    once = undelivered(df).persist(StorageLevel.DISK_ONLY)  # the look-up and the write both read it
    try:
        fields = [*once.schema.fields, T.StructField("delivery", T.StringType())] if sender is not None else once.schema.fields
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        new = once.join(final(ledger.look_up(once, path, "message_key", schema, batch_id)), "message_key", "left_anti")
        if sender is not None:
            new = new.mapInPandas(sender, schema)
        ledger.append(new, path, "message_key", batch_id)
    finally:
        once.unpersist()
    return on_record(spark, path, schema)


def on_record(spark, path, schema):
    """One row per message that a sink has on record."""
    return outcomes(ledger.rows(spark, absolute(path), schema))


def absolute(path):
    return path if "://" in path or path.startswith(("/", "file:")) else os.path.abspath(path)
