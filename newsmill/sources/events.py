"""Object-created notifications and what a stored object turns into."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import explode_rows
from newsmill.functions.text import col, is_blank, let, lookup
from newsmill.functions.urls import decode_component


def _typed(v, path, kind):
    """Is the value at ``path`` a JSON value of this kind?"""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind), F.lit(False))


def _text(v, path):
    return F.when(_typed(v, path, "STRING"), F.try_variant_get(v, path, "string"))


def _record(v):
    bucket, key = _text(v, "$.s3.bucket.name"), _text(v, "$.s3.object.key")
    reason = (
        F.when(~F.schema_of_variant(v).startswith("OBJECT"), "record")
        .when(F.coalesce(_text(v, "$.eventSource"), F.lit("")) != "aws:s3", "event_source")
        .when(~_typed(v, "$.s3", "OBJECT"), "s3")
        .when(F.coalesce(bucket, F.lit("")) == "", "bucket")
        .when(F.coalesce(key, F.lit("")) == "", "key")
    )
    return F.struct(bucket.alias("bucket"), decode_component(key).alias("key"), reason.alias("reason"))


def _parsed(event_json):
    """struct(records, reject_reason) of one event as a single expression, so that
    a filter on it repeats one parse at most."""

    def outcome(doc):
        is_list = _typed(doc, "$.Records", "ARRAY")
        return let(
            F.when(is_list, F.transform(F.try_variant_get(doc, "$.Records", "array<variant>"), _record)),
            lambda records: F.struct(records.alias("records"), reason(doc, records).alias("reject_reason")),
        )

    def reason(doc, records):
        bad = F.filter(records, lambda r: r["reason"].isNotNull())
        return (
            F.when(~F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False)), "not_json")
            .when(F.schema_of_variant(F.try_variant_get(doc, "$.Records", "variant")).isNull(), "records_missing")
            .when(records.isNull(), "records_not_a_list")
            .when(F.size(records) == 0, "records_empty")
            .otherwise(F.try_element_at(bad, F.lit(1))["reason"])
        )

    return let(F.try_parse_json(col(event_json)), outcome)


def parse_events(df, event_id="event_id", event_json="event_json"):
    """Adds each event's ``records`` array and ``reject_reason``.

    An event is one row and its records are checked inside that row, so a
    rejected record rejects the event without any shuffle.
    """
    return df.withColumn("_e", _parsed(event_json)).select(*df.columns, "_e.records", "_e.reject_reason")


def event_records(df, event_id="event_id", event_json="event_json"):
    """Valid events flattened to (event_id, pos, bucket, key)."""
    good = let(_parsed(event_json), lambda e: F.when(e["reject_reason"].isNull(), e["records"]))
    return explode_rows(df, [event_id], good, pos=True).select(
        event_id, "pos", F.col("r.bucket").alias("bucket"), F.col("r.key").alias("key")
    )


def event_rejects(df, event_id="event_id", event_json="event_json"):
    return parse_events(df, event_id, event_json).where("reject_reason IS NOT NULL").select(event_id, "reject_reason")


def trigger_response(df, event_id="event_id", event_json="event_json", seconds="seconds"):
    """Per event: status code, record count, rounded time, ordered results.

    ``results`` is built from the event's own array; nothing is collected
    across rows.
    """
    parsed = parse_events(df, event_id, event_json)
    ok = F.col("reject_reason").isNull()
    return parsed.select(
        event_id,
        F.when(ok, 200).otherwise(400).alias("status_code"),
        F.when(ok, "S3 event processing completed successfully").otherwise("S3 event processing failed").alias("message"),
        "reject_reason",
        F.when(ok, F.size("records")).otherwise(0).alias("processed_records"),
        F.round(seconds, 2).alias("execution_time"),
        F.when(ok, F.transform("records", lambda r: F.struct(r["bucket"].alias("bucket"), r["key"].alias("key")))).alias("results"),
    )


def read_objects(spark, path, glob=None):
    """Stored objects as rows: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def raw_object_decode(df, content="content"):
    """Adds ``text`` and ``reject_reason``: UTF-8 where valid, else Latin-1
    (which accepts every byte); blank text is rejected."""
    content = col(content)
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return df.withColumn("text", text).withColumn("reject_reason", F.when(is_blank("text"), "blank"))


def object_errors(df, code="error_code"):
    """Storage error code -> reason and category."""
    return df.withColumn("reason", lookup(code, dims.OBJECT_ERRORS, 0, dims.OBJECT_ERROR_DEFAULT[0])).withColumn(
        "category", lookup(code, dims.OBJECT_ERRORS, 1, dims.OBJECT_ERROR_DEFAULT[1])
    )


def execution_input(df, content, bucket, key, ts):
    """Columns payload, timestamp (epoch seconds), source and s3(bucket, key),
    plus their JSON form."""
    out = F.struct(
        col(content).alias("payload"),
        F.unix_timestamp(col(ts)).alias("timestamp"),
        F.lit("s3_event").alias("source"),
        F.struct(col(bucket).alias("bucket"), col(key).alias("key")).alias("s3"),
    )
    return df.select("*", out.alias("_in")).select(*df.columns, "_in.*", F.to_json("_in").alias("input_json"))
