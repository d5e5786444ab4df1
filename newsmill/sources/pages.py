"""HTML text -> element tree as arrays, and the node table made from it."""

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from newsmill import dims
from newsmill.functions.frames import explode_rows
from newsmill.functions.text import strip

# --- fixed values: elements that never hold children, or whose text is no text
VOID_TAGS = set(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
TEXTLESS_TAGS = {"script", "style", "template", "rt", "rp"}
# elements in which the parser reads markup as text
RAW_TAGS = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}

# a plain tag and the text behind it
PLAIN_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"&<>]*")*)>([^<]*)')
PLAIN_ATTRIBUTE = re.compile(r' ([^=]*)="([^"]*)"')

NODE = (
    "struct<node_id int, end_id int, parent_id int, depth int, tag string, classes array<string>, "
    "attrs map<string,string>, text_from int, text_to int, boiler boolean, block_no int, own_links int>"
)
TEXT = "struct<text string, parent_id int, boiler boolean>"
TREE_SCHEMA = f"nodes array<{NODE}>, texts array<{TEXT}>"

_NODE_ARROW = pa.list_(
    pa.struct(
        [("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()),
         ("tag", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
         ("text_from", pa.int32()), ("text_to", pa.int32()), ("boiler", pa.bool_()), ("block_no", pa.int32()), ("own_links", pa.int32())]
    )
)
_TEXT_ARROW = pa.list_(pa.struct([("text", pa.string()), ("parent_id", pa.int32()), ("boiler", pa.bool_())]))


class _TreeReader(HTMLParser):
    """Pre-order numbering of elements with the interval each one covers.

    ``block_no`` is the place of the innermost block around an element among all
    blocks (-1: none), ``own_links`` how many anchors have a block as innermost one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.texts, self.open, self.data = [], [], [], []
        self.blocks, self.open_blocks = [], []
        self.depth_of = Counter()  # open elements by tag; keeps deep trees linear
        self.textless = 0  # open elements without text

    def updatepos(self, i, j):
        return j  # lines are not counted

    def flush(self):
        if not self.data:
            return
        text = "".join(self.data)
        self.data = []
        parent = self.open[-1] if self.open else None
        if self.textless:
            return
        if not text.strip(" \n\t\f\r"):
            text = "\n" if "\n" in text else " "
        self.texts.append((text, parent["node_id"] if parent else -1, bool(parent and parent["boiler"])))

    def handle_starttag(self, tag, attrs):
        self.flush()
        parent = self.open[-1] if self.open else None
        values = {k: v or "" for k, v in attrs}
        node = {
            "node_id": len(self.nodes), "end_id": len(self.nodes),
            "parent_id": parent["node_id"] if parent else -1, "depth": len(self.open), "tag": tag,
            "classes": values.get("class", "").split(), "attrs": values,
            "text_from": len(self.texts), "text_to": len(self.texts),
            "boiler": bool(parent and parent["boiler"]) or tag in dims.BOILERPLATE_TAGS,
            "block_no": self.open_blocks[-1] if self.open_blocks else -1, "own_links": 0,
        }
        if tag == "a" and self.open_blocks:
            self.blocks[self.open_blocks[-1]]["own_links"] += 1
        if tag in dims.SECTION_BLOCKS:
            self.open_blocks.append(len(self.blocks))
            self.blocks.append(node)
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)
            self.depth_of[tag] += 1
            self.textless += tag in TEXTLESS_TAGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.close_top()

    def close_top(self):
        node = self.open.pop()
        node["end_id"], node["text_to"] = len(self.nodes) - 1, len(self.texts)
        self.depth_of[node["tag"]] -= 1
        self.textless -= node["tag"] in TEXTLESS_TAGS
        if node["tag"] in dims.SECTION_BLOCKS:
            self.open_blocks.pop()
        return node["tag"]

    def handle_endtag(self, tag):
        self.flush()
        if self.depth_of[tag]:
            while self.close_top() != tag:
                pass

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def finish(self):
        self.close()
        self.flush()
        while self.open:
            self.close_top()


def read_plain(html):
    """A reader that has read a document of plain tags and texts alone, which is what the
    parser would make of it in a fraction of the time; None for any other document."""
    if "<!" in html:
        return None
    reader, at, title = _TreeReader(), html.find("<"), False
    at = len(html) if at < 0 else at
    if at:
        reader.handle_data(unescape(html[:at]))
    for m in PLAIN_TAG.finditer(html, at):
        end, tag, attrs, text = m.groups()
        if m.start() != at or tag in RAW_TAGS or (end and attrs) or (title and not (end and tag == "title")):
            return None
        at, title = m.end(), tag == "title" and not end
        if end:
            reader.handle_endtag(tag)
        else:
            reader.handle_starttag(tag, PLAIN_ATTRIBUTE.findall(attrs) if attrs else ())
        if text:
            reader.handle_data(unescape(text) if "&" in text else text)
    return reader if at == len(html) and not title else None


def read_tree(html):
    """(nodes, texts) of one document; markup the parser refuses gives an empty tree."""
    html = html or ""
    reader = read_plain(html)
    try:
        if reader is None:
            reader = _TreeReader()
            reader.feed(html)
        reader.finish()
    except AssertionError:
        return [], []
    for node in reader.nodes:
        node["attrs"] = list(node["attrs"].items())
    return reader.nodes, [{"text": t, "parent_id": p, "boiler": b} for t, p, b in reader.texts]


def may_hold(html, words):
    """Whether a text of the document can hold one of the lower-case words, in any case:
    no tree is needed to rule that out. A word of plain letters stands in the markup as
    it is, unless a letter is a numeric reference or the parser drops a ``</>`` in it."""
    low = (html or "").lower()
    return any(w in low for w in (*words, "&#", "</>"))


def html_tree(df, html="html", keep=("page_id",), words=()):
    """One row per page: ``nodes`` and ``texts`` arrays in document order. With ``words``,
    pages of which no text can hold one of them are left out before they are parsed.

    A node covers nodes ``node_id+1 .. end_id`` and texts ``text_from .. text_to-1``,
    so every later question about a page is an array expression inside its own
    row: no join, no shuffle, and a page's size is the only bound on memory.
    """
    narrow = df.select(*keep, F.col(html).alias("_html"))

    def parse(batches):
        for batch in batches:
            docs = batch.column(len(keep))
            if words:
                wanted = [may_hold(h, words) for h in docs.to_pylist()]
                batch = batch.filter(pa.array(wanted, pa.bool_()))
                docs = batch.column(len(keep))
            for start in range(0, batch.num_rows, 64):
                trees = [read_tree(h) for h in docs.slice(start, 64).to_pylist()]
                kept = [c.slice(start, 64) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([t[0] for t in trees], _NODE_ARROW), pa.array([t[1] for t in trees], _TEXT_ARROW)],
                    names=[*keep, "nodes", "texts"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(parse, f"{kept}, {TREE_SCHEMA}")


def texts_of(texts, node, body_only=False):
    """Raw texts below a node, in order."""
    part = F.slice(texts, node["text_from"] + 1, node["text_to"] - node["text_from"])
    if body_only:
        part = F.filter(part, lambda t: ~t["boiler"])
    return F.transform(part, lambda t: t["text"])


def raw_text(texts, node):
    return F.array_join(texts_of(texts, node), "")


def stripped_text(texts, node, body_only=False):
    """Every text stripped, then joined without a separator."""
    return F.array_join(F.transform(texts_of(texts, node, body_only), strip), "")


def inside(node, outer):
    return (node["node_id"] > outer["node_id"]) & (node["node_id"] <= outer["end_id"])


def html_nodes(df, html="html", keep=("page_id",), tags=None):
    """The node table: one row per element with raw and stripped text."""
    tree = html_tree(df, html, keep)
    wanted = F.col("nodes") if tags is None else F.filter("nodes", lambda n: n["tag"].isin(list(tags)))
    rows = explode_rows(tree, [*keep, "texts"], wanted)
    n, texts = F.col("r"), F.col("texts")
    return rows.select(
        *keep, "r.node_id", "r.end_id", "r.parent_id", "r.depth", "r.tag", "r.classes", "r.attrs", "r.boiler",
        raw_text(texts, n).alias("text"), stripped_text(texts, n).alias("text_strip"),
    )

