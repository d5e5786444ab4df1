"""Prompts, model responses, default extractive summary and fallbacks."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.text import col, is_blank, lookup, strip


def required_fields(df, title="title", content="content"):
    """Adds ``reject_reason``: the first empty one of title, content (untrimmed)."""
    empty = lambda c: F.coalesce(col(c), F.lit("")) == ""
    return df.withColumn("reject_reason", F.when(empty(title), "title").when(empty(content), "content"))


def prompt_text(title, content):
    content = F.coalesce(col(content), F.lit(""))
    cut = F.when(
        F.length(content) > dims.PROMPT_LIMIT, F.concat(F.left(content, F.lit(dims.PROMPT_LIMIT)), F.lit("..."))
    ).otherwise(content)
    return F.concat(
        F.lit(dims.PROMPT_HEAD), F.coalesce(col(title), F.lit("")), F.lit(dims.PROMPT_MIDDLE), cut, F.lit(dims.PROMPT_TAIL)
    )


def prompt_build(df, title="title", content="content"):
    return df.withColumn("prompt", prompt_text(title, content))


def lead_sentences(content, n=3):
    """First n sentences of the whole text, trimmed and joined by a space."""
    found = F.slice(F.regexp_extract_all(col(content), F.lit(dims.SENTENCE), 0), 1, n)
    return F.array_join(F.transform(found, strip), " ")


def summarize(df, content="content", summarizer=None, schema=None):
    """Adds ``summary``. ``summarizer`` is an optional mapInPandas function of the
    user (with its output ``schema``); the default takes the lead sentences."""
    if summarizer is not None:
        return df.mapInPandas(summarizer, schema)
    return df.withColumn("summary", lead_sentences(content))


def response_text(df, response="response_json"):
    """Adds ``summary``: output.message.content[0].text trimmed, '' when any level
    is missing or the JSON is broken."""
    value = F.try_variant_get(F.try_parse_json(col(response)), "$.output.message.content[0].text", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return df.withColumn("summary", strip(F.coalesce(text, F.lit(""))))


def fallback_summary(df, title="title", summary="summary", failed="failed"):
    """Adds ``summary`` and ``summary_source`` (model, fallback, failed)."""
    named = F.concat(F.lit(dims.FALLBACK_HEAD), F.coalesce(col(title), F.lit("")), F.lit(dims.FALLBACK_TAIL))
    failed, blank = F.coalesce(col(failed), F.lit(False)), is_blank(summary)
    return df.withColumns(
        {
            "summary": F.when(failed, F.lit(dims.FAILED_SUMMARY)).when(blank, named).otherwise(col(summary)),
            "summary_source": F.when(failed, "failed").when(blank, "fallback").otherwise("model"),
        }
    )


def service_error_class(df, code="error_code"):
    """Adds ``error_class`` retryable / fatal; unknown codes are retryable."""
    return df.withColumn(
        "error_class", F.coalesce(lookup(code, dims.SERVICE_ERRORS), F.lit(dims.SERVICE_ERROR_DEFAULT))
    )


def slim_projection(df):
    """url, title, author, summary; the content column is never read on."""
    return df.select("url", "title", "author", "summary")


def article_defaults(df, record="record_json"):
    """Lenient record -> the five article columns: '' for a missing key, an
    explicit null stays null."""
    fields = F.from_json(col(record), "map<string,string>")
    rows = df.withColumn("_m", fields)
    return rows.select(
        *df.columns,
        *[
            F.when(F.coalesce(F.map_contains_key("_m", F.lit(k)), F.lit(False)), F.col("_m")[k]).otherwise("").alias(k)
            for k in dims.ARTICLE_FIELDS
        ],
    )
