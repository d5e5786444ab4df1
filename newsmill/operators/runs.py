"""Run accounting and responses."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import join_on
from newsmill.functions.text import col, lookup


def _message(key):
    return F.lit(dims.RUN_MESSAGES[key][1])


def run_outcome(items, runs=None, run_id="run_id"):
    """Per run: totals, status code, message, articles processed, error.

    ``items``: run_id, fetched, summarised, delivered (booleans per link).
    ``runs``: run_id, parse_failed, fetch_critical, summarize_critical; a left
    join keeps runs without any link. Items are counted before the join; without
    ``runs`` every run that has items is reported as free of critical failures.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = items.groupBy(run_id).agg(
        F.count(F.lit(1)).alias("total_links"),
        F.count_if("fetched").alias("fetched"),
        F.count_if(F.col("fetched") & F.col("summarised")).alias("summarised"),
        F.count_if(F.col("fetched") & F.col("summarised") & F.col("delivered")).alias("delivered"),
    )
    names = ["total_links", "fetched", "summarised", "delivered"]
    if runs is None:
        off = {k: F.lit(False) for k in ("parse_failed", "fetch_critical", "summarize_critical")}
        rows = counts.withColumns(off)
    else:
        rows = join_on(runs, counts, [run_id], "left").fillna(0, names)
    outcome = (
        F.when(flag("parse_failed"), "parse_error").when(F.col("total_links") == 0, "no_links")
        .when(flag("fetch_critical"), "fetch_error").when(F.col("fetched") == 0, "none_fetched")
        .when(flag("summarize_critical"), "summarize_error").otherwise("complete")
    )
    rows = rows.withColumn("outcome", outcome)
    return rows.select(
        run_id, *names, "outcome",
        lookup("outcome", dims.RUN_MESSAGES, 0).alias("status_code"),
        lookup("outcome", dims.RUN_MESSAGES, 1).alias("message"),
        # every summarise result counts, failed ones included
        F.when(F.col("outcome") == "complete", F.col("fetched")).otherwise(F.lit(0)).cast("long").alias("articles_processed"),
        F.when(F.col("outcome") == "none_fetched", dims.ALL_FETCHES_FAILED).alias("error"),
    )


def partial_failures(items, run_id="run_id", status="item_status"):
    """Per run: number of items in every status and number of failures; an item without
    a status has failed."""
    s = col(status)
    return items.groupBy(run_id).agg(
        *[F.count_if(s == name).alias(name) for name in dims.ITEM_STATUSES],
        F.count_if(~s.eqNullSafe(F.lit("ok"))).alias("n_failed"),
        F.count(F.lit(1)).alias("n_items"),
    )


def partial_failure_errors(items, run_id="run_id", status="item_status", error="error"):
    """The error list of each run in long form: (run, status, error, n, first position).

    Rows, not a collected array, so a run with very many failures stays spread.
    """
    failed = items.where(~col(status).eqNullSafe(F.lit("ok")))
    return failed.groupBy(run_id, status, error).agg(F.count(F.lit(1)).alias("n"))


def result_response(df, success="success", articles="articles_processed", errors="errors", seconds="execution_time"):
    """Adds ``status_code`` and the JSON ``body`` of a run result."""
    ok = col(success)
    body = F.struct(
        F.when(ok, "Processing completed").otherwise("Processing failed").alias("message"),
        col(articles).alias("articlesProcessed"), col(errors).alias("errors"), col(seconds).alias("executionTime"),
    )
    return df.withColumn("status_code", F.when(ok, 200).otherwise(500)).withColumn("body", F.to_json(body))


def error_response(df, kind="kind", context="context", message="message"):
    """Adds status_code, error_name, error_message by kind of error.

    ``fatal`` names its context; unknown kinds count as fatal; authentication
    failures hide the detail.
    """
    kind = F.when(col(kind).isin(list(dims.STAGE_ERRORS)), col(kind)).otherwise("fatal")
    text = (
        F.when(kind == "fatal", F.concat(F.lit("Fatal error in "), col(context), F.lit(": "), col(message)))
        .when(kind == "authentication", dims.AUTHENTICATION_MESSAGE)
        .otherwise(col(message))
    )
    return df.withColumns(
        {
            "status_code": lookup(kind, dims.STAGE_ERRORS, 0),
            "error_name": lookup(kind, dims.STAGE_ERRORS, 1),
            "error_message": text,
            "error_context": F.when(kind == "fatal", col(context)),
        }
    )
