"""Anchors, link rules, titles, authors, sections, first-seen de-duplication."""

from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import explode_rows
from newsmill.functions.text import col, let, strip
from newsmill.functions.urls import canonical_url, is_article_link, split_url
from newsmill.sources.pages import html_tree, inside, raw_text, stripped_text


def anchors(df, html="html", keep=("page_id",)):
    """(keep..., pos, href, text) for every ``a[href]`` in document order."""
    tree = html_tree(df, html, keep)
    links = F.filter("nodes", lambda n: (n["tag"] == "a") & n["attrs"]["href"].isNotNull())
    rows = explode_rows(tree, [*keep, "texts"], links, pos=True)
    return rows.select(
        *keep, "pos", F.col("r.attrs")["href"].alias("href"), stripped_text(F.col("texts"), F.col("r")).alias("text")
    )


def anchors_native(df, html="html", keep=("page_id",)):
    """Same columns by pattern alone, for anchors without inner markup."""
    pattern = F.lit(r'<a href="([^"]*)"[^>]*>([^<]*)</a>')
    found = F.arrays_zip(
        F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("text")
    )
    return explode_rows(df, keep, found, pos=True).select(*keep, "pos", "r.href", "r.text")


def link_filter(df, url="url", skip=None, accept=None):
    """Rows whose URL passes; rules are one alternation each, kept native so the
    filter can move below a scan or before a Python step."""
    return df.where(is_article_link(url, skip, accept))


def url_allowlist(df, url="url", hosts=None, suffix=None):
    """Adds ``valid`` and ``reason`` (scheme, domain, path)."""
    hosts, suffix = hosts or dims.ALLOWED_HOSTS, suffix or dims.ALLOWED_HOST_SUFFIX

    def judge(u):
        return (
            F.when(u["scheme"] != "https", "scheme")
            .when(~(u["netloc"].isin(hosts) | u["netloc"].endswith(suffix)), "domain")
            .when(F.length(u["path"]) <= 1, "path")
        )

    reason = let(split_url(F.coalesce(col(url), F.lit(""))), judge)
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def own_title(text):
    """Link text as title: longer than 15 and not a call to read on, else ''."""
    text = col(text)
    return F.when((F.length(text) > 15) & ~text.rlike(dims.NOT_A_TITLE), text).otherwise("")


def digest_title(text, parent_text, headings):
    """Own text, else first usable line of the parent, else the first heading
    longer than 10 of an array (first h1, h2, h3 of the block)."""
    text, parent_text = col(text), col(parent_text)
    lines = F.filter(
        F.transform(F.split(parent_text, "\n"), strip),
        lambda line: (F.length(line) > 15) & (line != text) & ~line.rlike(dims.NOT_A_TITLE_LINE),
    )
    heads = F.filter(headings, lambda h: F.length(h) > 10)
    first = lambda found: F.try_element_at(found, F.lit(1))
    return F.coalesce(F.nullif(own_title(text), F.lit("")), first(lines), first(heads), F.lit(""))


def by_line(text, cut_publication):
    """Name after "by", when 2 < length < 50; null otherwise."""
    name = strip(F.regexp_extract(col(text), dims.BY_LINE, 1))
    if cut_publication:
        name = F.regexp_replace(name, r"(?i)\s+in\s+.*$", "")
    return let(name, lambda n: F.when((F.length(n) > 2) & (F.length(n) < 50), n))


def digest_author(profile_text, block_text):
    """Profile link text, else by-line, else @name, else ''."""
    at_name = F.nullif(F.regexp_extract(col(block_text), dims.AT_NAME, 1), F.lit(""))
    return F.coalesce(F.nullif(col(profile_text), F.lit("")), by_line(block_text, True), at_name, F.lit(""))


def general_author(parent_text):
    return F.coalesce(by_line(parent_text, False), F.lit(""))


def first_seen_dedup(df, keys, order):
    """First row per key by explicit order columns.

    An ordered ``min_by`` instead of a window: it combines on the map side, so a
    key holding a large share of the rows never has to be sorted in one task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("s")
    return df.groupBy(*keys).agg(first).select(*keys, "s.*").select(*df.columns)


# --- sections of a mail --------------------------------------------------------

_ROOT = "named_struct('node_id', -1, 'end_id', 2147483647)"


def _span(n):
    return F.struct(n["node_id"].alias("node_id"), n["end_id"].alias("end_id"))


def _last(array):
    return F.try_element_at(array, F.lit(-1))


def _container(nodes, texts, pattern):
    """Parent of the nearest block element around the section's heading text."""
    heading = F.try_element_at(F.filter(texts, lambda t: t["text"].rlike(pattern)), F.lit(1))

    def around(h):
        return _last(
            F.filter(
                nodes,
                lambda n: n["tag"].isin(dims.SECTION_ANCESTORS)
                & (n["node_id"] <= h["parent_id"]) & (n["end_id"] >= h["parent_id"]),
            )
        )

    def parent(block):
        up = F.get(nodes, block["parent_id"])
        return F.when(block["parent_id"] < 0, F.expr(_ROOT)).when(up.isNotNull(), _span(up))

    return let(let(heading, around), parent)


def _below(nodes, block):
    """Elements inside a block; they follow it without a gap."""
    return F.slice(nodes, block["node_id"] + 2, block["end_id"] - block["node_id"])


def _heading(below, texts, tag):
    node = F.try_element_at(F.filter(below, lambda n: n["tag"] == tag), F.lit(1))
    return let(node, lambda n: F.when(n.isNotNull(), stripped_text(texts, n)))


def _profile(below, texts):
    """Text of the first profile link in a block."""
    found = F.filter(
        below, lambda n: (n["tag"] == "a") & n["attrs"]["href"].contains("@") & ~is_article_link(n["attrs"]["href"])
    )
    return F.try_element_at(F.filter(F.transform(found, lambda n: stripped_text(texts, n)), lambda t: t != ""), F.lit(1))


def _parent_text(nodes, texts, a, render):
    return let(
        F.get(nodes, a["parent_id"]),
        lambda p: F.when(p.isNotNull(), render(texts, p)).otherwise(""),
    )


def _link(section, rank, block_id, a, title, author):
    author = F.coalesce(F.nullif(author, F.lit("")), F.lit(dims.UNKNOWN_AUTHOR))
    return F.struct(
        section.alias("section"), rank.alias("section_rank"), block_id.alias("block_id"),
        a["node_id"].alias("pos"), canonical_url(a["attrs"]["href"]).alias("url"),
        title.alias("title"), author.alias("author"),
    )


def _accepted(links):
    """Links with a title longer than 10; no array counts as none."""
    kept = F.filter(links, lambda r: (F.length(r["title"]) > 10) & (r["url"] != ""))
    return F.coalesce(kept, F.from_json(F.lit("[]"), LINK_TYPE))


LINK_TYPE = (
    "array<struct<section string, section_rank int, block_id int, pos int, url string, title string, author string>>"
)


def _block_facts(nodes, texts, block):
    """What every link of a block shares: its headings and its author."""
    def facts(below):
        heads = F.transform(F.array(*map(F.lit, ("h1", "h2", "h3"))), lambda tag: _heading(below, texts, tag))
        author = let(
            F.struct(_profile(below, texts).alias("profile"), raw_text(texts, block).alias("block")),
            lambda t: digest_author(t["profile"], t["block"]),
        )
        return F.struct(
            block["node_id"].alias("node_id"), block["end_id"].alias("end_id"), heads.alias("heads"), author.alias("author")
        )

    return let(_below(nodes, block), facts)


def _all_blocks(nodes, texts, attribution):
    """Facts of all blocks of one mail in document order. Where only the innermost
    block of a link counts, blocks without links of their own stay null."""
    blocks = F.filter(nodes, lambda n: n["tag"].isin(dims.SECTION_BLOCKS))
    if attribution == "innermost":
        return F.transform(blocks, lambda b: F.when(b["own_links"] > 0, _block_facts(nodes, texts, b)))
    return F.transform(blocks, lambda b: _block_facts(nodes, texts, b))


def _links_in(nodes, texts, section, blocks, attribution):
    """Accepted links of a container struct(name, rank, c)."""
    name, rank, c = section["name"], section["rank"], section["c"]
    found = F.filter(nodes, lambda n: inside(n, c) & (n["tag"] == "a") & is_article_link(n["attrs"]["href"]))

    def pick(a):
        if attribution == "innermost":
            block = F.when(a["block_no"] >= 0, F.get(blocks, a["block_no"]))
        else:
            block = F.try_element_at(F.filter(blocks, lambda b: inside(b, c) & inside(a, b)), F.lit(1))
        return let(block, lambda b: F.when(inside(b, c), row(a, b)))

    def row(a, b):
        # the parent's text is read only for links without a title of their own
        up = lambda own: F.when(own_title(own) == "", _parent_text(nodes, texts, a, stripped_text)).otherwise("")
        title = let(
            stripped_text(texts, a),
            lambda own: let(up(own), lambda parent: digest_title(own, parent, b["heads"])),
        )
        return _link(name, rank, b["node_id"], a, title, b["author"])

    return _accepted(F.filter(F.transform(found, pick), lambda r: r.isNotNull()))


def section_array(attribution="innermost"):
    """Links of both sections of one mail, as an array over ``nodes``/``texts``."""
    nodes, texts = F.col("nodes"), F.col("texts")
    containers = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(rank).alias("rank"), _container(nodes, texts, pattern).alias("c"))
            for name, rank, pattern in dims.SECTIONS
        ]
    )

    def links(present):  # blocks are looked at only where there is a section
        found = lambda blocks: F.flatten(F.transform(present, lambda s: _links_in(nodes, texts, s, blocks, attribution)))
        return F.when(F.size(present) > 0, let(_all_blocks(nodes, texts, attribution), found)).otherwise(F.from_json(F.lit("[]"), LINK_TYPE))

    return let(F.filter(containers, lambda s: s["c"].isNotNull()), links)


def general_array():
    """All article links of one mail, by link text alone."""
    nodes, texts = F.col("nodes"), F.col("texts")
    found = F.filter(nodes, lambda n: (n["tag"] == "a") & is_article_link(n["attrs"]["href"]))

    def row(a):
        author = let(_parent_text(nodes, texts, a, raw_text), general_author)
        title = let(stripped_text(texts, a), own_title)
        return _link(F.lit("general"), F.lit(2), F.lit(-1), a, title, author)

    return _accepted(F.transform(found, row))


def _first_per_url(links):
    """Keep the first link of every URL of one mail, found among sorted neighbours."""
    ordered = F.sort_array(F.transform(links, lambda r, i: F.struct(r["url"].alias("url"), i.alias("i"))))
    firsts = let(ordered, lambda o: F.filter(o, lambda s, j: (j == 0) | (F.get(o, j - 1)["url"] != s["url"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda s: s["i"])), lambda i: F.get(links, i))


def section_links(df, html="html", keep=("email_id",), attribution="innermost"):
    """Article links of the named sections of a mail, in document order.

    Each link belongs to its innermost block (``outermost`` gives every link of
    a container the container's first author). One narrow pass per mail, in which
    headings and author are found once per block, so time grows with the mail's size.
    A mail without the words of a section's heading is not parsed.
    """
    tree = html_tree(df, html, keep, dims.SECTION_WORDS)
    return explode_rows(tree, keep, section_array(attribution)).select(*keep, "r.*")


def section_union_fallback(df, html="html", keep=("email_id",), attribution="innermost"):
    """All links of a mail: both sections, or the general search when both are
    empty, then first seen per URL.

    A mail is one row, so choice and de-duplication are array expressions: one
    parse, no anti-join, no shuffle.
    """
    tree = html_tree(df, html, keep).withColumn("_sections", section_array(attribution))
    links = F.when(F.size("_sections") > 0, F.col("_sections")).otherwise(general_array())
    return explode_rows(tree, keep, let(links, _first_per_url)).select(*keep, "r.*")
