"""URL splitting, canonical form and predicates as native column expressions."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.text import col, let


def split_url(c):
    """struct(scheme, netloc, path, query), following RFC 3986 with ``;params``
    of the last path segment and the fragment dropped."""
    raw = F.regexp_replace(F.translate(col(c), "\t\r\n", ""), r"^[\x00-\x20]+", "")
    bare = F.substring_index(raw, "#", 1)

    def parts(u):
        base = F.substring_index(u, "?", 1)
        scheme = F.lower(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
        rest = F.regexp_replace(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:", "")
        path = F.regexp_replace(rest, r"^//[^/]*", "")
        return F.struct(
            scheme.alias("scheme"),
            F.regexp_extract(rest, r"^//([^/]*)", 1).alias("netloc"),
            F.when(scheme.isin(dims.PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*\z", "")).otherwise(path).alias("path"),
            F.when(F.length(u) > F.length(base), F.substr(u, F.length(base) + 2)).otherwise("").alias("query"),
        )

    return let(bare, parts)


def decode_component(c):
    """Percent- and plus-decoding that leaves malformed escapes in place."""
    return F.try_url_decode(F.regexp_replace(col(c), r"%(?![0-9A-Fa-f]{2})", "%25"))


def _kept_pairs(query, decode=True):
    """Query pairs without blanks and tracking keys, as array of struct(k, v)."""
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    text = decode_component if decode else (lambda x: x)
    pairs = F.transform(
        pairs,
        lambda p: F.struct(
            text(F.substring_index(p, "=", 1)).alias("k"),
            text(F.substr(p, F.instr(p, "=") + 1)).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(dims.TRACKING_PARAMS))


def _grouped_query(query):
    """k=v pairs by first appearance of the key; values of one key joined by &."""

    def render(pairs):
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.array_join(
            F.transform(
                keys,
                lambda k: F.concat(
                    k, F.lit("="),
                    F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "&"),
                ),
            ),
            "&",
        )

    return let(_kept_pairs(query), render)


def _plain_query(query):
    return F.array_join(
        F.transform(_kept_pairs(query, decode=False), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&"
    )


def canonical_url(c, strict=False):
    """Link without tracking parameters, fragment and path parameters.

    The default keeps the contract's quirks: decoded values, ``a=1&2`` for a
    repeated key, ``:///x`` for input without a scheme. ``strict`` keeps values
    encoded and repeats keys.
    """
    query_of = _plain_query if strict else _grouped_query

    def build(u):
        head = F.concat(u["scheme"], F.lit("://"), u["netloc"], u["path"])
        query = F.when(u["query"] == "", F.lit("")).otherwise(query_of(u["query"]))
        return F.concat(head, let(query, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q))))

    c = F.coalesce(col(c), F.lit(""))
    broken_host = c.rlike(r"^[^/?#]*//[^/?#\[]*\][^/?#]*|^[^/?#]*//[^/?#\]]*\[[^/?#\]]*([/?#]|\z)")
    return F.when(c == "", c).when(broken_host, c).otherwise(let(split_url(c), build))


def matches_any(c, patterns, ignore_case=True):
    flag = "(?i)" if ignore_case else ""
    return col(c).rlike(flag + "|".join(f"(?:{p})" for p in patterns))


def is_article_link(c, skip=None, accept=None):
    """Skip rules first, then at least one accept rule; null is no link."""
    c = F.coalesce(col(c), F.lit(""))
    return ~matches_any(c, skip or dims.LINK_SKIP_PATTERNS) & matches_any(c, accept or dims.LINK_ACCEPT_PATTERNS)


def host_of(c):
    return F.regexp_extract(col(c), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
