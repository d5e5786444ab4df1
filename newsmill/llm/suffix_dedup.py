"""Suffix-array removal of byte strings that occur more than once.

A string of ``length`` bytes is addressed by the smallest hash of the short grams
inside it. Equal strings have equal minima, so the groups of one minimum hold all
suffixes that can share ``length`` bytes, and groups are independent: this is the
range partition of the suffixes. Inside a partition the suffixes are sorted by the
difference cover of 3: sampled triples are sorted and named, names are sorted by
recursion, the other suffixes are merged in, and neighbours are compared.

* Minima seen once cannot repeat: their text never leaves the scan.
* Equal runs of text are counted once, before the suffix sort.
* A minimum with very many different runs (the edge of a popular passage) is split
  by the bytes that all windows of a short block share; equal windows stay together.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import arrays as A

RUNS = "key long, a long, n long, m long, own boolean"
PIECES = "key long, a long, n long, m long, hot boolean, piece binary"
GROUPS = "g long, m long, t binary, at long, n long, c long, key long, a long, piece binary"
FOUND = "key long, spans array<long>"
BLOCK = 12
CHUNK = 1 << 21


def gram_size(length):
    return 1 << (max(length // 6, 1).bit_length() - 1)


def window_minima(raw, length):
    """Gram hashes, and the smallest one inside each window."""
    k = gram_size(length)
    h = A.gram_hashes(A.BYTE_CODES[raw], k)
    return h, A.sliding_min(h, length - k + 1)


def block_runs(offs, raw, length, step=1 << 21):
    """(row, first window in the row, windows, minimum, holds its gram twice)."""
    width = length - gram_size(length) + 1
    total = len(raw) - length + 1
    for lo in range(0, max(total, 0), step):
        part = raw[lo : lo + step + length - 1]
        h, mins = window_minima(part, length)
        row = np.searchsorted(offs, np.arange(lo, lo + len(part)), "right") - 1
        at, sizes, m = A.minimum_runs(mins, row[: len(mins)], row[: len(mins)] == row[length - 1 :])
        own = np.zeros(len(at), bool)
        for s in range(0, len(at), 20000):
            e = slice(s, s + 20000)
            reach = np.arange(width)
            first = at[e] + (h[at[e][:, None] + reach] == m[e][:, None]).argmax(1)
            back = at[e] + sizes[e] + width - 2
            last = back - (h[back[:, None] - reach] == m[e][:, None]).argmax(1)
            own[e] = first != last
        yield row[at], at + lo - offs[row[at]], sizes, m.view(np.int64), own


def find_runs(length):
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, offs, raw in A.text_blocks(batch.column("text")):
                for row, a, n, m, own in block_runs(offs, raw, length):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[i + row], a, n, m, own)], names=["key", "a", "n", "m", "own"])

    return run


def cut_pieces(length):
    """The text of each run that may repeat."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            lists = batch.column("runs")
            ends = lists.offsets.to_numpy()
            flat = [lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "n", "m", "hot")]
            for i, offs, raw in A.text_blocks(batch.column("text"), 1 << 20):
                lo, hi = ends[i], ends[i + len(offs) - 1]
                row = np.repeat(np.arange(len(offs) - 1), np.diff(ends[i : i + len(offs)]))
                a, n, m, hot = (x[lo:hi] for x in flat)
                starts = offs[row] + a
                piece = A.string_column(raw, starts, starts + n + length - 1)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + row]), pa.array(a), pa.array(n), pa.array(m), pa.array(hot), piece], names=["key", "a", "n", "m", "hot", "piece"])

    return run


def hot_blocks(piece, m, length):
    """Blocks of windows of one hot run: (group, first window, windows)."""
    raw = np.frombuffer(piece, np.uint8)
    h, mins = window_minima(raw, length)
    hits = np.flatnonzero(h.view(np.int64) == m)
    first = hits[np.searchsorted(hits, np.arange(len(mins)))]
    r = first - np.arange(len(mins))
    cut = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (r[1:] // BLOCK != r[:-1] // BLOCK))))
    for s, n in zip(cut, np.diff(np.append(cut, len(mins)))):
        q = int(r[s]) // BLOCK
        core = int(first[s]) - q * BLOCK
        # the bytes that every window of a whole block contains
        shared = raw[max(core, 0) : max(core - BLOCK + 1 + length, 0)]
        digest = hashlib.blake2b(shared.tobytes() + q.to_bytes(4, "little"), digest_size=8, key=int(m & (2**63 - 1)).to_bytes(8, "little")).digest()
        yield int.from_bytes(digest, "little", signed=True), int(s), int(n)


def split_hot(length):
    names = [x.split()[0] for x in GROUPS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = [
                    (g, r["m"], r["t"], s, n, r["c"], r["key"], r["a"], r["piece"][s : s + n + length - 1])
                    for g, s, n in hot_blocks(r["piece"], r["m"], length)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def suffix_array(s):
    """Suffix array by the difference cover {1, 2} of 3. Symbols are below 2**21
    and positive; whatever ends the array must make all suffixes different."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    x = np.concatenate((s.astype(np.int64), [0, 0, 0]))
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n + (n % 3 == 1), 3)))
    triple = (x[sample] << 42) | (x[sample + 1] << 21) | x[sample + 2]
    order = np.argsort(triple)
    t = triple[order]
    step = np.ones(len(t), np.int64)
    step[1:] = t[1:] != t[:-1]
    names = np.empty(len(t), np.int64)
    names[order] = np.cumsum(step)
    if int(step.sum()) < len(t):
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    rest = np.arange(0, n, 3)
    pair = lambda i: (x[i] << 22) | rank[i + 1]
    wide = lambda i: (x[i] << 43) | (x[i + 1] << 22) | rank[i + 2]
    rest = rest[np.argsort(pair(rest))]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    place = np.arange(len(rest)) + np.searchsorted(pair(ones), pair(rest)) + np.searchsorted(wide(twos), wide(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sorted12
    return out


def same_prefixes(raw, left, right, length):
    """Which of the suffix pairs share their first ``length`` bytes."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    alive = np.arange(len(left))
    for at in [*range(0, length - 7, 8), length - 8]:
        a, b = word[left[alive] + at].view(np.uint64)[:, 0], word[right[alive] + at].view(np.uint64)[:, 0]
        alive = alive[a == b]
    same = np.zeros(len(left), bool)
    same[alive] = True
    return same


def equal_windows(pieces, sizes, length):
    """Sorted window starts of a chunk and a flag at each that equals its
    predecessor: (piece, window in it, same as the one before)."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    base = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + 1
    symbols[base + lengths] = 257 + np.arange(len(pieces))
    start = np.zeros(len(raw) + 1, np.int64)
    np.add.at(start, base, 1)
    np.add.at(start, base + sizes, -1)
    starts = np.cumsum(start)[:-1] > 0
    order = suffix_array(symbols)
    order = order[starts[order]]
    same = np.zeros(len(order), bool)
    if length >= 8:
        same[1:] = same_prefixes(raw, order[:-1], order[1:], length)
    else:
        same[1:] = [raw[i : i + length].tobytes() == raw[j : j + length].tobytes() for i, j in zip(order[:-1], order[1:])]
    piece = np.searchsorted(base, order, "right") - 1
    return piece, order - base[piece], same


def spans_of(flags):
    """[start, end, start, end, ...] of the true runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.tolist()


def group_chunks(batches, size_of, limit):
    """Rows (lists of columns) of whole groups, sorted by the first column, in
    chunks of about ``limit``; a single group may be larger."""
    held, volume = [], 0
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        for row in rows:
            if volume >= limit and held[-1][0] != row[0]:
                yield held
                held, volume = [], 0
            held.append(row)
            volume += size_of(row)
    if held:
        yield held


def repeated_starts(length):
    """Suffix sort of whole groups; spans of the windows that also start elsewhere."""

    def windows(held):
        # one group, one text: nothing to sort unless the text repeats inside itself
        if sum(len(r[8]) for r in held) <= 3 * CHUNK >> 1:
            return equal_windows([r[8] for r in held], np.array([r[4] for r in held]), length)
        # a huge group: short blocks, by now; equal windows meet by their bytes' digest
        digest = lambda p, i: hashlib.blake2b(p[i : i + length], digest_size=16).digest()
        keys = np.array([digest(r[8], i) for r in held for i in range(r[4])], "S16")
        piece = np.repeat(np.arange(len(held)), [r[4] for r in held])
        at = np.concatenate([np.arange(r[4]) for r in held])
        order = np.argsort(keys)
        same = np.zeros(len(order), bool)
        same[1:] = keys[order][1:] == keys[order][:-1]
        return piece[order], at[order], same

    def run(batches):
        for rows in group_chunks(batches, lambda r: len(r[8]), CHUNK):
            # rows of one text follow each other; c = 0 says that they are not counted yet
            held, copies, out = [], [], []
            for r in rows:
                if held and r[5] == 0 and r[:3] == held[-1][:3]:
                    copies[-1].append(r)
                else:
                    held.append(r)
                    copies.append([r])
            piece, at, same = windows(held)
            twice = same.copy()
            twice[:-1] |= same[1:]
            order = np.argsort(piece, kind="stable")
            cuts = np.searchsorted(piece[order], np.arange(len(held) + 1))
            for k, r in enumerate(held):
                if len(copies[k]) > 1:
                    out += [(x[6], [x[7], x[7] + x[4]]) for x in copies[k]]
                elif r[5] < 2:
                    mine = order[cuts[k] : cuts[k + 1]]
                    flags = np.zeros(r[4], bool)
                    flags[at[mine]] = twice[mine]
                    spans = [r[3] + r[7] + x for x in spans_of(flags)]
                    if spans:
                        out.append((r[6], spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["key", "spans"])

    return run


def repeated_spans(documents, length=200, hot_runs=2000, id_col="doc_id", text_col="text"):
    """(key, spans): per document that has any, the windows that start a repeated
    string, as [first, end) pairs; ``key`` is that of ``arrays.keyed_texts``."""
    A.ready(documents.sparkSession)
    docs = A.keyed_texts(documents, id_col, text_col)
    runs = A.stored(docs.select("key", "text").mapInArrow(find_runs(length), RUNS), "repeat-runs")
    often = runs.groupBy("m").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("own")).where("c > 1 OR own")
    often = often.select("m", (F.col("c") > hot_runs).alias("hot"))
    listed = runs.drop("own").join(often, "m").groupBy("key").agg(F.collect_set(F.struct("a", "n", "m", "hot")).alias("runs"))
    pieces = docs.select("key", "text").join(listed, "key").mapInArrow(cut_pieces(length), PIECES)
    pieces = A.stored(pieces.withColumn("t", F.unhex(F.md5("piece"))), "repeat-pieces")
    A.dropped(runs)
    cool = pieces.where("NOT hot").selectExpr("m AS g", "m", "t", "0L AS at", "n", "0L AS c", "key", "a", "piece")
    popular = pieces.where("hot")
    once = popular.groupBy("m", "t", "n", "piece").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "a")).alias("first"))
    once = once.select("m", "t", "n", "c", "first.*", "piece").mapInArrow(split_hot(length), GROUPS)
    sorted_groups = cool.unionByName(once).repartition("g").sortWithinPartitions("g", "t", "at")
    single = sorted_groups.mapInArrow(repeated_starts(length), FOUND)
    # a popular run seen twice repeats as a whole
    copies = popular.groupBy("m", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m", "t")
    whole = popular.select("key", "a", "n", "m", "t").join(copies, ["m", "t"], "left_semi").select("key", F.array(F.col("a"), F.col("a") + F.col("n")).alias("spans"))
    return single.unionByName(whole).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cover(text, spans, length):
    """Removed byte spans and the rest of one text."""
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    starts, ends = A.union_spans(pairs[:, 0], pairs[:, 1] - 1 + length)
    keep = np.ones(len(text), bool)
    edge = np.zeros(len(text) + 1, np.int64)
    edge[starts] += 1
    edge[ends] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return starts, ends, np.frombuffer(text, np.uint8)[keep].tobytes()


def removal(length, with_text):
    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary())
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist()):
                text = text.as_py() or b""
                if spans:
                    starts, ends, rest = cover(text, spans, length)
                else:
                    starts, ends, rest = [], [], text
                row = (doc_id, len(text), len(text) - len(rest), len(starts), hashlib.sha256(rest).hexdigest())
                out.append(row + ((rest,) if with_text else ()))
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

    return run


def suffix_dedup(documents, length=200, hot_runs=2000, id_col="doc_id", text_col="text", with_text=False):
    """Remove each byte covered by a string of ``length`` bytes that also starts
    anywhere else in the table, the same document included.

    One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    ``with_text``, ``kept`` (the remaining bytes; cuts may fall inside a character).
    Null text is empty; a null id stays null; repeated rows are copies of each other;
    texts shorter than ``length`` keep everything; other columns are ignored; an
    empty table gives an empty table.
    """
    spans = repeated_spans(documents, length, hot_runs, id_col, text_col)
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    docs = A.keyed_texts(documents, id_col, text_col)
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(removal(length, with_text), schema)


def kept_text(text, spans, length):
    """The rest of a text; a character that a cut splits goes whole."""
    pairs = np.array(spans, np.int64).reshape(-1, 2)
    raw = np.frombuffer(text, np.uint8)
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1] - 1 + length, -1)
    gone = np.cumsum(edge)[:-1] > 0
    letter = np.cumsum((raw & 0xC0) != 0x80) - 1
    cut = np.bincount(letter, gone) > 0
    return raw[~cut[letter]].tobytes().decode("utf-8")


def without_repeats(documents, length=200, hot_runs=2000, id_col="doc_id", text_col="text", size_col="n_chars"):
    """The documents, all columns, without bytes of strings of ``length`` bytes that
    also start elsewhere; ``size_col``, where present, follows the text. A text that
    keeps everything is unchanged, null included. Columns of any name are kept."""
    rows, name, back = A.masked(documents)
    id_col, text_col, size_col = name[id_col], name[text_col], name.get(size_col)
    spans = repeated_spans(rows, length, hot_runs, id_col, text_col)
    key = F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))
    columns_kept, schema = rows.columns, rows.schema
    rows = rows.withColumn("_key", key).join(spans.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")), "_key", "left").drop("_key")

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(text_col), batch.column("_spans").to_pylist()
            hit = [k for k, s in enumerate(lists) if s]
            if hit:
                new = texts.to_pylist()
                for k in hit:
                    new[k] = kept_text(new[k].encode("utf-8"), lists[k], length)
                texts = pa.array(new, texts.type)
            columns = [texts if c == text_col else batch.column(c) for c in columns_kept]
            if hit and size_col:
                at = columns_kept.index(size_col)
                sizes = columns[at].to_pylist()
                for k in hit:
                    sizes[k] = len(new[k])
                columns[at] = pa.array(sizes, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=columns_kept)

    return back(rows.mapInArrow(run, schema))
