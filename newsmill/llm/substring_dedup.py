"""Prefix-partitioned suffix trees over words: later occurrences of long repeats go.

Suffixes (word positions) are split into groups by a prefix of words: the window of
``length`` words is addressed by the suffix that starts at the smallest hash of a
short word prefix inside it, so equal windows meet in one group. A prefix with very
many different suffixes is lengthened until its groups are small. Each group's
subtree is built top-down in memory, edge by edge; a branch with one leaf is cut, and
the internal nodes that reach ``length`` words are the repeats, with their leaves.

Prefixes that occur once are dropped before any text moves; equal stretches of text
become one leaf list with a count.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.llm.suffix_dedup import group_chunks, spans_of

RUNS = "key long, ord long, a long, n long, m long, own boolean"
PIECES = "key long, ord long, a long, n long, m long, hot boolean, piece binary"
GROUPS = "g long, m long, t binary, at long, n long, ord long, key long, a long, piece binary"
FOUND = "key long, spans array<long>"
BLOCK = 3
CHUNK = 1 << 21
LOWEST = -(2**63)


def prefix_words(length):
    """Words of the shortest prefix that addresses a group."""
    return max(1, int(length * 0.4))


def kept_bytes(offs, raw, starts, ends, row, keep):
    """(row offsets, bytes): the kept words of each row, joined by one space."""
    w, e, r = starts[keep], ends[keep], row[keep]
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[w] += 1
    mark[e] -= 1
    stay = np.cumsum(mark, dtype=np.int8)[:-1] > 0
    inner = e[:-1][r[1:] == r[:-1]]
    stay[inner] = True
    data = raw.copy()
    data[inner] = 32
    upto = np.concatenate(([0], np.cumsum(stay)))
    return upto[offs], data[stay]


def tidy(offs, raw):
    """The block with its words joined by single spaces, and the words' places."""
    starts, ends, row = A.words_of(offs, raw)
    offs, raw = kept_bytes(offs, raw, starts, ends, row, np.ones(len(starts), bool))
    sizes = ends - starts
    gap = np.ones(len(sizes), np.int64)
    if len(row):
        gap[0] = 0
        gap[1:] = row[1:] == row[:-1]
    ends = np.cumsum(sizes + gap)
    return offs, raw, ends - sizes, ends, row


def window_minima(h, length):
    k = prefix_words(length)
    grams = A.ordered_hashes(h, k)
    return grams, A.sliding_min(grams, length - k + 1)


def first_words(row, n_rows):
    return np.searchsorted(row, np.arange(n_rows + 1))


def block_runs(h, row, length):
    """(row, first window in the row, windows, minimum, holds its prefix twice)."""
    width = length - prefix_words(length) + 1
    if len(h) < length:
        return None
    grams, mins = window_minima(h, length)
    at, sizes, m = A.minimum_runs(mins, row[: len(mins)], row[: len(mins)] == row[length - 1 :])
    own = np.zeros(len(at), bool)
    reach = np.arange(width)
    for s in range(0, len(at), 100000):
        e = slice(s, s + 100000)
        first = at[e] + (grams[at[e][:, None] + reach] == m[e][:, None]).argmax(1)
        back = at[e] + sizes[e] + width - 2
        own[e] = first != back - (grams[back[:, None] - reach] == m[e][:, None]).argmax(1)
    heads = np.searchsorted(row, row[at])
    return row[at], at - heads, sizes, m.view(np.int64), own


def find_runs(length):
    def run(batches):
        for batch in batches:
            keys, ords = batch.column("key").to_numpy(), batch.column("ord").to_numpy()
            for i, offs, raw in A.text_blocks(batch.column("text")):
                starts, ends, row = A.words_of(offs, raw)
                found = block_runs(A.word_hashes(raw, starts, ends), row, length)
                if found:
                    row, *rest = found
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i + row], ords[i + row], *rest)], names=["key", "ord", "a", "n", "m", "own"])

    return run


def cut_pieces(length):
    def run(batches):
        for batch in batches:
            keys, ords = batch.column("key").to_numpy(), batch.column("ord").to_numpy()
            lists = batch.column("runs")
            ends = lists.offsets.to_numpy()
            flat = [lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "n", "m", "hot")]
            for i, offs, raw in A.text_blocks(batch.column("text"), 1 << 20):
                offs, raw, w_start, w_end, w_row = tidy(offs, raw)
                lo, hi = ends[i], ends[i + len(offs) - 1]
                row = np.repeat(np.arange(len(offs) - 1), np.diff(ends[i : i + len(offs)]))
                a, n, m, hot = (x[lo:hi] for x in flat)
                word = first_words(w_row, len(offs) - 1)[row] + a
                piece = A.string_column(raw, w_start[word], w_end[word + n + length - 2])
                columns = [pa.array(x) for x in (keys[i + row], ords[i + row], a, n, m, hot)]
                yield pa.RecordBatch.from_arrays([*columns, piece], names=["key", "ord", "a", "n", "m", "hot", "piece"])

    return run


def hot_blocks(piece, m, length):
    """A longer prefix for a popular one: (group, first window, windows, bytes)."""
    raw = np.frombuffer(piece, np.uint8)
    starts, ends, _ = A.words_of(np.array([0, len(raw)]), raw)
    grams, mins = window_minima(A.word_hashes(raw, starts, ends), length)
    hits = np.flatnonzero(grams.view(np.int64) == m)
    first = hits[np.searchsorted(hits, np.arange(len(mins)))]
    r = first - np.arange(len(mins))
    cut = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (r[1:] // BLOCK != r[:-1] // BLOCK))))
    for s, n in zip(cut, np.diff(np.append(cut, len(mins)))):
        q = int(r[s]) // BLOCK
        core = int(first[s]) - q * BLOCK
        shared = b" ".join(piece[starts[j] : ends[j]] for j in range(max(core, 0), min(max(core - BLOCK + 1 + length, 0), len(starts))))
        digest = hashlib.blake2b(shared + q.to_bytes(4, "little"), digest_size=8, key=int(m & (2**63 - 1)).to_bytes(8, "little")).digest()
        yield int.from_bytes(digest, "little", signed=True), int(s), int(n), piece[starts[s] : ends[s + n + length - 2]]


def lengthen_prefixes(length):
    names = [x.split()[0] for x in GROUPS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [(g, r["m"], r["t"], s, n, r["ord"], r["key"], r["a"], text) for g, s, n, text in hot_blocks(r["piece"], r["m"], length)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def subtree_nodes(symbols, leaves, length):
    """Node of depth ``length`` that each leaf hangs on, for leaves that share theirs.

    The subtree grows top-down: a node's leaves are split by the label of the next
    edge (four words, at the end single ones), and lone leaves are cut off.
    """

    def named(pairs):
        return np.unique(pairs, return_inverse=True)[1].astype(np.int64)

    pad = np.concatenate((symbols, np.zeros(4, np.int64)))
    two = named((pad[:-1] << 31) | pad[1:])
    four = named((two[:-2] << 31) | two[2:])
    node, depth = np.zeros(len(leaves), np.int64), 0
    while depth < length and len(leaves):
        label, step = (four, 4) if length - depth >= 4 else (pad, 1)
        _, child, size = np.unique((node << 31) | label[leaves + depth], return_inverse=True, return_counts=True)
        stay = size[child] > 1
        leaves, node, depth = leaves[stay], child[stay].astype(np.int64), depth + step
    return leaves, node


def later_leaves(length):
    """Whole groups: windows of a run's first place that start earlier elsewhere."""

    def nodes(held):
        pieces = [r[8] for r in held]
        raw = np.frombuffer(b" ".join(pieces), np.uint8)
        starts, ends, _ = A.words_of(np.array([0, len(raw)]), raw)
        words = A.string_column(raw, starts, ends)
        symbols = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        per = np.array([r[4] + length - 1 for r in held])
        base = np.cumsum(per) - per
        n = np.array([r[4] for r in held])
        leaves = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        leaves, node = subtree_nodes(symbols, leaves, length)
        piece = np.searchsorted(base, leaves, "right") - 1
        return piece, leaves - base[piece], node

    def digests(held):
        # a huge group: short blocks by now; equal windows meet by their words' digest
        piece, at, keys = [], [], []
        for k, r in enumerate(held):
            w = r[8].split(b" ")
            for i in range(r[4]):
                piece.append(k)
                at.append(i)
                keys.append(hashlib.blake2b(b" ".join(w[i : i + length]), digest_size=16).digest())
        return np.array(piece), np.array(at), np.unique(np.array(keys, "S16"), return_inverse=True)[1]

    def run(batches):
        for rows in group_chunks(batches, lambda r: len(r[8]), CHUNK):
            # rows of one text follow each other, the earliest first; the rest go whole
            held, out = [], []
            for r in rows:
                if held and r[:4] == held[-1][:4]:
                    if r[5:8] != held[-1][5:8]:
                        out.append((r[6], [r[7], r[7] + r[4]]))
                else:
                    held.append(r)
            piece, at, node = nodes(held) if sum(len(r[8]) for r in held) < 8 * CHUNK else digests(held)
            ords, keys = np.array([r[5] for r in held]), np.array([r[6] for r in held])
            place = at + np.array([r[3] + r[7] for r in held])[piece]
            order = np.lexsort((place, keys[piece], ords[piece], node))
            head = np.ones(len(order), bool)
            head[1:] = node[order][1:] != node[order][:-1]
            later = np.zeros(len(order), bool)
            later[order] = ~head
            order = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[order], np.arange(len(held) + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                mine, r = order[cuts[k] : cuts[k + 1]], held[k]
                flags = np.zeros(r[4], bool)
                flags[at[mine]] = later[mine]
                spans = [r[3] + r[7] + x for x in spans_of(flags)]
                if spans:
                    out.append((r[6], spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["key", "spans"])

    return run


def keyed(documents, id_col, text_col):
    return A.keyed_texts(documents, id_col, text_col).withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))


def later_spans(documents, length=20, hot_runs=2000, id_col="doc_id", text_col="text"):
    """(key, spans): word windows that also start earlier, as [first, end) pairs."""
    A.ready(documents.sparkSession)
    docs = keyed(documents, id_col, text_col)
    runs = A.stored(docs.select("key", "ord", "text").mapInArrow(find_runs(length), RUNS), "tree-runs")
    often = runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 OR own")
    often = often.select("m", (F.col("c") > hot_runs).alias("hot"))
    listed = runs.select("key", "a", "n", "m").join(often, "m").groupBy("key").agg(F.collect_set(F.struct("a", "n", "m", "hot")).alias("runs"))
    pieces = docs.select("key", "ord", "text").join(listed, "key").mapInArrow(cut_pieces(length), PIECES)
    pieces = A.stored(pieces.withColumn("t", F.unhex(F.md5("piece"))), "tree-pieces")
    cool = pieces.where("NOT hot").selectExpr("m AS g", "m", "t", "0L AS at", "n", "ord", "key", "a", "piece")
    popular, own = pieces.where("hot"), F.struct("ord", "key", "a")
    once = popular.groupBy("m", "t", "n", "piece").agg(F.min(own).alias("first"))
    once = once.select("m", "t", "n", "first.*", "piece").mapInArrow(lengthen_prefixes(length), GROUPS)
    groups = cool.unionByName(once).repartition("g").sortWithinPartitions("g", "t", "at", "ord", "key", "a")
    first = groups.mapInArrow(later_leaves(length), FOUND)
    copies = popular.groupBy("m", "t").agg(F.count(F.lit(1)).alias("c"), F.min(own).alias("first")).where("c > 1").select("m", "t", "first")
    whole = popular.select("ord", "key", "a", "n", "m", "t").join(copies, ["m", "t"]).where(own != F.col("first"))
    whole = whole.select("key", F.array(F.col("a"), F.col("a") + F.col("n")).alias("spans"))
    return first.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removal(length, with_text):
    def run(batches):
        for batch in batches:
            ids, lists = batch.column("doc_id"), batch.column("spans").to_pylist()
            for i, offs, raw in A.text_blocks(batch.column("text")):
                starts, ends, row = A.words_of(offs, raw)
                rows = len(offs) - 1
                heads = first_words(row, rows)
                edge = np.zeros(len(starts) + 1, np.int64)
                for k in range(rows):
                    if lists[i + k]:
                        pairs = np.array(lists[i + k]).reshape(-1, 2)
                        np.add.at(edge, heads[k] + pairs[:, 0], 1)
                        np.add.at(edge, heads[k] + pairs[:, 1] - 1 + length, -1)
                keep = np.cumsum(edge)[:-1] == 0
                upto, data = kept_bytes(offs, raw, starts, ends, row, keep)
                counts = np.diff(heads)
                stay = np.diff(np.concatenate(([0], np.cumsum(keep)))[heads])
                rest = [data[upto[k] : upto[k + 1]].tobytes() for k in range(rows)]
                columns = [ids.slice(i, rows), pa.array(counts), pa.array(counts - stay), pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(rest, pa.binary()).cast(pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def substring_dedup(documents, length=20, hot_runs=2000, id_col="doc_id", text_col="text", with_text=False):
    """Remove each word covered by ``length`` words in a row that also start earlier:
    in a document with a smaller id, or earlier in the same document.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 and, ``with_text``,
    ``kept`` (kept words joined by one space). Null text has no words; a null id comes
    before all others; rows that repeat id and text share one decision and are not
    earlier than each other; rows with one id and different texts are ordered by a
    hash; other columns are ignored; an empty table gives an empty table.
    """
    spans = later_spans(documents, length, hot_runs, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    docs = A.keyed_texts(documents, id_col, text_col)
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(removal(length, with_text), schema)
