"""Structured logs, error categories, alerts, checkpoints and metrics."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import join_on
from newsmill.functions.text import col, ellipsis, lookup, title_words

LOG_SCHEMA = (
    "timestamp string, level string, message string, context map<string,string>, execution_time double, "
    "error struct<type string, message string, category string>, metrics map<string,string>"
)


def log_parse(df, line="line"):
    """Adds ``is_structured`` and the record columns; the raw line is kept."""
    # a line counts as structured when it is any valid JSON
    return df.withColumn("is_structured", F.try_parse_json(col(line)).isNotNull()).withColumn(
        "record", F.when(F.col("is_structured"), F.from_json(col(line), LOG_SCHEMA))
    ).select(*df.columns, "is_structured", "record.*")


def iso_utc(ts):
    """Python style ISO text with Z: no fraction when there are no microseconds."""
    ts = col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def log_build(df, ts="ts", level="level", message="message", context="context", seconds="seconds",
              error_type="error_type", error_message="error_message", category="category", metrics=None):
    """Adds ``record_json``; error only when there is one, metrics only when not empty."""
    error = F.when(
        col(error_type).isNotNull(),
        F.struct(col(error_type).alias("type"), col(error_message).alias("message"), col(category).alias("category")),
    )
    fields = [
        iso_utc(ts).alias("timestamp"), col(level).alias("level"), col(message).alias("message"),
        col(context).alias("context"), F.round(col(seconds), 3).alias("execution_time"), error.alias("error"),
    ]
    if metrics is not None:
        fields.append(F.when(F.size(col(metrics)) > 0, col(metrics)).alias("metrics"))
    return df.withColumn("record_json", F.to_json(F.struct(*fields)))


def category_of(error_type, code=None, message=None, explicit=None):
    """Error category: explicit, else by type family, client code, then message."""
    code = F.coalesce(col(code), F.lit("")) if code is not None else F.lit("")
    text = F.lower(F.coalesce(col(message), F.lit(""))) if message is not None else F.lit("")
    root = lookup(error_type, dims.ERROR_ROOTS)
    found = (
        F.when(col(error_type).isNull(), F.lit(None))
        .when(root == "validation", "input_validation").when(root == "authentication", "authentication")
        .when(root == "retryable", "external_service")
        .when((root == "client") & (code.contains("Auth") | code.contains("Credential")), "authentication")
        .when((root == "client") & (code.contains("Throttling") | code.contains("Limit")), "rate_limit")
        .when(root == "client", "external_service")
        .when(text.contains("network") | text.contains("connection"), "network")
        .otherwise("unknown")
    )
    return F.coalesce(col(explicit), found) if explicit is not None else found


def error_category(df, error_type="error_type", code="error_code", message="error_message", explicit="category"):
    return df.withColumn("error_category", category_of(error_type, code, message, explicit))


def alert_feed(df, level="level", severity="severity", suppressed="suppressed", notify="notify"):
    """Records that must alert, with severity, emoji and colour.

    CRITICAL records alert unless suppressed; others only when flagged.
    """
    critical = F.coalesce(col(level), F.lit("")) == "CRITICAL"
    wanted = (critical & ~F.coalesce(col(suppressed), F.lit(False))) | (~critical & F.coalesce(col(notify), F.lit(False)))
    name = F.when(critical, "CRITICAL").otherwise(F.coalesce(col(severity), F.lit("ERROR")))
    return (
        df.where(wanted).withColumn("alert_severity", name)
        .withColumn("emoji", lookup("alert_severity", dims.SEVERITY, 0, dims.SEVERITY_DEFAULT[0]))
        .withColumn("color", lookup("alert_severity", dims.SEVERITY, 1, dims.SEVERITY_DEFAULT[1]))
    )


def suggestion_text(category, error_type):
    """Advice by category plus the first matching suffix of the error type."""
    t = F.coalesce(col(error_type), F.lit(""))
    suffix = None
    for words, text in dims.SUGGESTION_SUFFIXES:
        hit = t.rlike("|".join(words))
        suffix = F.when(hit, text) if suffix is None else suffix.when(hit, text)
    base = lookup(category, dims.SUGGESTIONS, None, dims.SUGGESTION_DEFAULT)
    return F.concat(base, suffix.otherwise(""))


def alert_suggestions(df, category="category", error_type="error_type"):
    return df.withColumn("suggestion", suggestion_text(category, error_type))


def _context_line(label, entries, render):
    items = F.array_join(F.transform(entries, render), ", ")
    return F.when(F.size(entries) > 0, F.concat(F.lit(f"*{label}:* "), items))


def alert_format(df, severity="severity", message="message", error_type="error_type", error_message="error_message",
                 category="category", ts="ts", context="context"):
    """Adds ``alert_text``. ``context`` is array<struct<pos,key,value>> so that the
    order of its keys survives; absent parts leave no line."""
    entries = F.filter(F.array_sort(F.coalesce(col(context), F.array().cast("array<struct<pos:int,key:string,value:string>>"))),
                       lambda e: ~e["key"].isin(dims.HIDDEN_KEYS))
    important = F.filter(entries, lambda e: e["key"].isin(dims.IMPORTANT_KEYS))
    general = F.filter(entries, lambda e: ~e["key"].isin(dims.IMPORTANT_KEYS))
    plain = lambda e: F.concat(title_words(e["key"]), F.lit(": "), e["value"])
    short = lambda e: F.concat(title_words(e["key"]), F.lit(": "), ellipsis(e["value"], 100, 97))
    has_error = col(error_type).isNotNull()
    line = lambda label, value, when=None: (
        F.concat(F.lit(f"*{label}:* "), value) if when is None else F.when(when, F.concat(F.lit(f"*{label}:* "), value))
    )
    text = F.concat_ws(
        "\n",
        line("Severity", col(severity)), line("Message", col(message)),
        line("Error Type", col(error_type), has_error), line("Error Details", col(error_message), has_error),
        line("Category", title_words(category), col(category).isNotNull()),
        line("Timestamp", iso_utc(ts)),
        _context_line("Key Details", important, plain), _context_line("Additional Context", general, short),
        line("Suggested Actions", suggestion_text(category, error_type), col(category).isNotNull()),
    )
    return df.withColumn("alert_text", text)


def alert_payload(df, app, ts="ts", text="alert_text"):
    """Adds ``payload``, the chat message of an alert of ``alert_feed`` with its text."""
    field = F.struct(F.lit("Error Details").alias("title"), col(text).alias("value"), F.lit(False).alias("short"))
    body = F.struct(
        col("color").alias("color"), F.array(field).alias("fields"),
        F.lit(f"{app} Admin Notifications").alias("footer"), F.unix_timestamp(col(ts)).alias("ts"),
    )
    title = F.concat(col("emoji"), F.lit(" "), col("alert_severity"), F.lit(f" Alert - {app}"))
    return df.withColumn("payload", F.to_json(F.struct(title.alias("text"), F.array(body).alias("attachments"))))


# --- trackers -------------------------------------------------------------------

def _seconds(later, earlier):
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def checkpoint_offsets(marks, runs, run_id="run_id", name="name", ts="ts", seq="seq"):
    """(run, checkpoint, seconds since run start); the last write of a name wins.

    ``runs`` holds run_id, start_ts and end_ts; ``total`` is end - start.
    """
    last = marks.groupBy(run_id, name).agg(F.max_by(ts, F.struct(seq)).alias("at"))
    return join_on(last, runs, [run_id]).select(
        run_id, name, F.round(_seconds(F.col("at"), F.col("start_ts")), 3).alias("offset_seconds"),
        F.round(_seconds(F.col("end_ts"), F.col("start_ts")), 3).alias("total_execution_time"),
    )


def stage_durations(marks, runs, run_id="run_id", name="name", ts="ts", seq="seq"):
    """Seconds between ``<stage>_start`` and ``<stage>_complete``; from the run's
    start when the start mark is missing."""
    stage = F.regexp_extract(name, r"^(.*)_(start|complete)$", 1)
    kind = F.regexp_extract(name, r"^(.*)_(start|complete)$", 2)
    paired = marks.withColumn("stage", stage).withColumn("kind", kind).where(F.col("stage") != "")
    at = lambda k: F.max_by(F.when(F.col("kind") == k, F.col(ts)), F.when(F.col("kind") == k, F.struct(seq)))
    pairs = paired.groupBy(run_id, "stage").agg(at("start").alias("s"), at("complete").alias("c"))
    return join_on(pairs.where("c IS NOT NULL"), runs, [run_id]).select(
        run_id, "stage", F.round(_seconds(F.col("c"), F.coalesce("s", "start_ts")), 3).alias("seconds"),
        F.col("s").isNull().alias("from_run_start"),
    )


def metrics_last(metrics, run_id="run_id", name="name", value="value", order=("ts", "seq")):
    """Last value of every metric of a run, long form."""
    return metrics.groupBy(run_id, name).agg(F.max_by(value, F.struct(*order)).alias("value"))


def merge_metrics(base, override):
    """Map columns merged, the second one winning on equal keys."""
    kept = F.map_filter(col(base), lambda k, v: ~F.map_contains_key(col(override), k))
    return F.map_concat(kept, col(override))


def error_rates(df, ts="ts", category="category", period="1 day", extra=()):
    """Per period and category: errors, and their share of the period's errors.

    Rows are counted before anything is joined or ranked; the window runs over
    one row per category of a period.
    """
    errors = df.where(col(category).isNotNull())
    counts = errors.groupBy(F.window(col(ts), period).alias("w"), category, *extra).agg(F.count(F.lit(1)).alias("n_errors"))
    share = F.col("n_errors") / F.sum("n_errors").over(W.partitionBy("w"))
    return counts.select(F.col("w.start").alias("period_start"), category, *extra, "n_errors", share.alias("share"))
