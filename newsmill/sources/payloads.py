"""Event payload -> mail text."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.text import col, is_blank


def _truthy_text(v, source):
    """Text of a JSON value that counts as present: no '', 0, false, null, [], {}.
    Arrays and objects keep the order they have in ``source``, the text of the value."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "STRING", F.nullif(text, F.lit("")))
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "True"))
        .when(kind.startswith("ARRAY"), F.nullif(source, F.lit("[]")))
        .when(kind.startswith("OBJECT"), F.nullif(source, F.lit("{}")))
        .when(F.try_variant_get(v, "$", "double") != 0, text)
    )


def payload_normalize(df, event_json="event_json"):
    """Adds ``content`` and ``reject_reason`` (invalid, missing, empty).

    A string stays as it is; of an object the first usable member of
    body, content, html, message; any other object becomes its compact JSON
    text with its members in the given order; other scalars become their text.
    """
    doc, p = F.col("_doc"), F.col("_p")
    kind = F.schema_of_variant(p)
    source = lambda path: F.get_json_object(col(event_json), path)
    member = lambda k: _truthy_text(F.try_variant_get(p, f"$.{k}", "variant"), source(f"$.payload.{k}"))
    members = F.coalesce(*map(member, dims.PAYLOAD_KEYS))
    content = (
        F.when(kind == "STRING", F.try_variant_get(p, "$", "string"))
        .when(kind == "OBJECT<>", F.lit(None))
        .when(kind.startswith("OBJECT"), F.coalesce(members, source("$.payload")))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(p, "$", "string")))
        .when(kind == "VOID", "None")
        .when(kind.startswith("ARRAY"), source("$.payload"))
        .otherwise(F.try_variant_get(p, "$", "string"))
    )
    reason = (
        F.when(doc.isNull(), "invalid").when(kind.isNull(), "missing").when(is_blank("content"), "empty")
    )
    return (
        df.withColumn("_doc", F.try_parse_json(col(event_json)))
        .withColumn("_p", F.try_variant_get("_doc", "$.payload", "variant"))
        .withColumn("content", content)
        .withColumn("reject_reason", reason)
        .withColumn("content", F.when(F.col("reject_reason").isNull(), F.col("content")))
        .drop("_doc", "_p")
    )
