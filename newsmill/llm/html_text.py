"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into text blocks at block-level tags. A block is told by its word count
and link density, those of its two neighbours, whether it stands in an article or in a
part of a page that is no article by its tag, role or class, and whether it is a
heading. A class, id or role tells nothing of a container that holds most of a page's
words outside links while no article stands beside it: that is a wrapper of the page. A decision tree, grown here from the labelled blocks below, says which blocks
are kept. One pass over each page, no shuffle.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import arrays as A

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:svg|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>|<(script|style|noscript|template|svg|iframe|object|select|textarea|button|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[!?/][^>]*>|[a-zA-Z/!?][^<>]*\Z)", re.S | re.I)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav footer aside form menu dialog head".split())
ARTICLE = set("article main".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
# parts of class, id and role names that tell what a container is for
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|subscribe|newsletter|signup|login|nav\w*|menu\w*|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|footer|foot|header|masthead|comments?|replies|respond|disqus|pagination|pager|toolbar|navigation|complementary|contentinfo|search)(?=$|[\s_-])", re.I)

# of these, what is never a wrapper of the whole page
READERS = re.compile(r"comment|repl|respond|disqus", re.I)

# labelled blocks: words, link density, the same of the block before and after,
# in an article, in another part, heading -> main text
EXAMPLES = """
4 0.0 0 0.0 60 0.0 1 0 1 1
7 0.0 2 1.0 45 0.0 1 0 1 1
60 0.0 4 0.0 80 0.1 1 0 0 1
120 0.02 60 0.0 3 0.0 1 0 0 1
3 0.0 120 0.0 70 0.0 1 0 0 1
1 0.0 40 0.0 2 0.0 1 0 0 1
1 0.0 1 0.0 1 0.0 1 0 0 1
2 0.0 1 0.0 9 1.0 1 0 0 1
9 0.2 2 0.0 30 0.0 1 0 0 1
30 0.5 9 0.0 25 0.3 1 0 0 1
14 0.0 0 0.0 0 0.0 1 0 0 1
1 1.0 50 0.0 40 0.0 1 0 0 1
6 1.0 80 0.0 90 0.1 1 0 0 1
200 0.0 150 0.0 6 1.0 1 0 0 1
25 0.9 60 0.0 40 0.0 1 0 0 1
1 1.0 1 1.0 1 1.0 0 1 0 0
2 1.0 1 1.0 2 1.0 0 1 0 0
3 1.0 5 1.0 8 0.0 0 1 0 0
8 0.0 3 1.0 60 0.0 0 1 0 0
20 0.0 2 1.0 5 0.0 0 1 0 0
45 0.0 8 0.0 30 0.0 0 1 0 0
80 0.0 45 0.0 70 0.0 0 1 0 0
150 0.1 80 0.0 90 0.0 0 1 0 0
12 0.0 100 0.0 0 0.0 0 1 0 0
6 0.2 90 0.0 4 0.5 0 1 0 0
4 0.0 9 0.0 20 0.0 0 1 1 0
5 0.5 12 0.0 0 0.0 0 1 0 0
30 0.0 60 0.0 60 0.0 1 1 0 0
10 0.3 70 0.0 50 0.0 1 1 0 0
2 0.0 60 0.0 15 0.0 1 1 1 0
1 1.0 90 0.0 1 1.0 1 1 0 0
55 0.0 2 0.0 40 0.0 1 1 0 0
50 0.0 6 0.0 60 0.0 0 0 0 1
90 0.05 50 0.0 40 0.0 0 0 0 1
35 0.1 90 0.0 20 0.0 0 0 0 1
18 0.0 60 0.0 55 0.0 0 0 0 1
15 0.0 45 0.0 2 1.0 0 0 0 1
6 0.0 2 1.0 50 0.0 0 0 1 1
9 0.0 60 0.0 70 0.0 0 0 1 1
4 0.0 40 0.0 60 0.0 0 0 1 1
9 0.0 60 0.0 75 0.0 0 0 0 1
7 0.0 40 0.0 33 0.0 0 0 0 1
11 0.0 55 0.0 60 0.1 0 0 0 1
1 1.0 1 1.0 2 1.0 0 0 0 0
2 1.0 0 0.0 1 1.0 0 0 0 0
5 0.9 3 1.0 4 1.0 0 0 0 0
12 0.8 6 0.9 9 0.9 0 0 0 0
25 0.9 12 0.8 20 0.9 0 0 0 0
40 0.7 30 0.9 25 0.8 0 0 0 0
3 0.0 2 1.0 1 1.0 0 0 0 0
5 0.0 1 1.0 2 1.0 0 0 0 0
4 0.0 2 0.0 3 1.0 0 0 0 0
2 0.0 4 0.0 0 0.0 0 0 0 0
7 0.5 5 0.0 3 1.0 0 0 0 0
3 0.0 2 1.0 2 1.0 0 0 1 0
4 0.0 60 0.0 1 1.0 0 0 0 0
6 0.6 80 0.0 3 1.0 0 0 0 0
2 1.0 1 1.0 2 0.0 0 0 0 0
1 1.0 0 0.0 60 0.0 0 0 0 0
3 1.0 2 1.0 70 0.0 0 0 0 0
1 1.0 60 0.0 0 0.0 0 0 0 0
4 0.9 80 0.0 50 0.0 0 0 0 0
"""
FEATURES = 9


def examples():
    rows = np.array([line.split() for line in EXAMPLES.strip().splitlines()], np.float64)
    return rows[:, :FEATURES], rows[:, FEATURES].astype(bool)


def grow(x, y, depth=6):
    """A tree by Gini impurity: ('leaf', kept) or (feature, threshold, low, high)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return ("leaf", bool(share >= 0.5))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            p, q = y[low].mean(), y[~low].mean()
            cost = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, t, low)
    if best is None:
        return ("leaf", bool(share >= 0.5))
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree, x):
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    f, t, low, high = tree
    left = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def hinted(name, attributes):
    """What a container's class, id or role says: 0 nothing, 1 no article, 2 comments."""
    if name in ("body", "html") or name in ARTICLE or "=" not in attributes:
        return 0
    hints = [h for v in NAMED.findall(attributes) for h in HINTS.findall(v.strip("\"'"))]
    return 2 if any(map(READERS.search, hints)) else 1 if hints else 0


def wrappers(found, around):
    """Hinted containers that wrap the page: more than half of its words outside links,
    and no block in an article beside them."""
    free = [b[1] - b[2] for b in found]
    held, articles = {}, {}
    for words, block, inside in zip(free, found, around):
        for c in inside:
            held[c] = held.get(c, 0) + words
            articles[c] = articles.get(c, 0) + block[3]
    all_articles = sum(b[3] for b in found)
    return {c for c, n in held.items() if 2 * n > sum(free) and articles[c] == all_articles}


def text_blocks(page):
    """[(text, words, words in links, in an article, in another part, heading)]."""
    found, around, parts, link_words = [], [], [], 0
    # open elements: (name, in an article, in another part, heading, hinted containers)
    stack, state = [], (False, False, False, ())
    links, at, containers = 0, 0, 0

    def text(raw):
        nonlocal link_words
        if raw:
            parts.append(raw)
            if links:
                link_words += len(raw.split())

    def close():
        nonlocal parts, link_words
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                found.append((" ".join(words), len(words), min(link_words, len(words)), *state[:3]))
                around.append(state[3])
        parts, link_words = [], 0

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                links = 0 if m[2] else 1
            elif name == "br":
                parts.append(" ")
            elif name == "img":
                parts.append("")
            continue
        close()
        if m[2]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                del stack[k:]
                links = 0
        elif name not in VOID and not m[4].endswith("/"):
            if stack and stack[-1][0] == "p":
                stack.pop()  # a block ends an open paragraph
            before = stack[-1][1:] if stack else (False, False, False, ())
            inside = before[0] or name in ARTICLE
            page_header = name == "header" and not inside
            hint = hinted(name, m[4])
            other = (before[1] and name not in ARTICLE) or page_header or name in OUTSIDE or hint == 2
            outer = () if name in ARTICLE else before[3]
            if hint == 1:
                containers += 1
                outer = (*outer, containers)
            stack.append((name, inside, other, before[2] or name in HEADINGS, outer))
        state = stack[-1][1:] if stack else (False, False, False, ())
    text(page[at:])
    close()
    plain = wrappers(found, around)
    return [(*b[:4], b[4] or any(c not in plain for c in inside), b[5]) for b, inside in zip(found, around)]


def features(blocks):
    words = np.array([b[1] for b in blocks], np.float64)
    density = np.array([b[2] for b in blocks]) / words
    shifted = lambda v, d: np.concatenate(([0.0], v[:-1])) if d < 0 else np.concatenate((v[1:], [0.0]))
    flags = np.array([b[3:6] for b in blocks], np.float64)
    return np.column_stack((words, density, shifted(words, -1), shifted(density, -1), shifted(words, 1), shifted(density, 1), flags))


def extract(tree):
    def run(batches):
        for batch in batches:
            keep = [c for c in batch.schema.names if c != "html"]
            pages = batch.column("html").to_pylist()
            blocks = [text_blocks(p) if p else [] for p in pages]
            flat = [b for bs in blocks for b in bs]
            kept = np.concatenate([features(bs) for bs in blocks if bs]) if flat else np.zeros((0, FEATURES))
            kept, at, out = decide(tree, kept), 0, []
            for bs in blocks:
                out.append("\n".join(b[0] for b, k in zip(bs, kept[at : at + len(bs)]) if k))
                at += len(bs)
            columns = [*[batch.column(c) for c in keep], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return run


def main_text(pages, id_col="page_id", url_col="url", html_col="html"):
    """One row per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; ids and urls pass through, null or
    repeated; other columns are ignored; broken markup is read as far as it goes; an
    empty table gives an empty table.
    """
    A.ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(extract(grow(*examples())), f"page_id {kind}, url string, text string, n_chars long")
