"""Near-duplicate documents by SimHash fingerprints in a segment-popcount embedding.

A fingerprint has 64 bits: a bit is set where over half of the hashes of the text's
shingles (repeats included) have it set. Two fingerprints link at ``RADIUS`` or fewer
differing bits.

* Embedding: 32 segments of two bits, each mapped to its number of set bits. Flipping
  one bit changes one count by one, so the Manhattan distance of two embeddings is never
  above the number of differing bits. Counts are kept as thermometer codes (0: 00, 1: 01,
  2: 11), so that distance is the popcount of an exclusive or.
* Grid range join: the segments form ``RADIUS`` + 1 blocks. Vectors within Manhattan
  distance ``RADIUS`` agree in one block at least, so each fingerprint goes to the cell
  of its counts in each block; inside a cell those within ``RADIUS`` in total count
  (the embedding with one segment) are neighbours in order. Pairs left are tested by the
  Manhattan distance, then by the fingerprints themselves.
* A cell of more than ``CELL`` fingerprints is divided by the bits outside its block,
  again in ``RADIUS`` + 1 parts of which a linked pair shares one, and so on. The last
  level leaves a dozen free bits, so a cell is small by construction there.
* Fingerprints are distinct before the join. A cell returns links that join its
  components, fewer than it has members, never all its pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.llm.graph import components
from newsmill.llm.near_dedup import whole_groups

WORDS, SEED, RADIUS, CELL, DEPTH = 3, 42, 3, 4096, 5
LOW_BITS = 0x5555555555555555
CHUNK = 1 << 16


def shingle_spans(offs, raw, words):
    """(bytes, first, end, row): the words of the rows joined by one space, and the place
    in them of each shingle; a row with fewer words is one shingle."""
    raw = A.LOWER[raw]
    starts, ends, row = A.words_of(offs, raw)
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    src = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    joined[src + np.repeat(at - starts, sizes)] = raw[src]
    count = np.bincount(row, minlength=len(offs) - 1)
    base = np.cumsum(count) - count
    last = np.minimum(np.arange(len(row)) + words, (base + count)[row]) - 1
    heads = np.flatnonzero((np.arange(len(row)) == base[row]) | (last - np.arange(len(row)) == words - 1))
    last = last[heads]
    return joined.tobytes(), at[heads], at[last] + sizes[last], row[heads]


def fingerprints_of(offs, raw, words=WORDS, seed=SEED):
    """64-bit fingerprint of each row; zero without words."""
    text, first, end, row = shingle_spans(offs, raw, words)
    n = len(offs) - 1
    total, set_bits = np.bincount(row, minlength=n), np.zeros((n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for s in range(0, len(row), CHUNK):
        e = min(s + CHUNK, len(row))
        h = np.array([digest(text[a:b], seed) for a, b in zip(first[s:e].tolist(), end[s:e].tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows, at = np.unique(row[s:e], return_index=True)
        set_bits[rows] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * set_bits > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_rows(words, seed):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, offs, raw in A.text_blocks(batch.column("text")):
                found = fingerprints_of(offs, raw, words, seed).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(found)), pa.array(found)], names=["doc_id", "f"])

    return run


def signed(mask):
    return mask - (1 << 64) if mask >> 63 else mask


def parts_of(bits):
    """The bits in RADIUS + 1 parts of nearly equal size."""
    return [bits[i :: RADIUS + 1] for i in range(RADIUS + 1)]


def cell_masks():
    """For each level the masks of its cells by path; a path's children are its number
    times RADIUS + 1 and the next ones. Level 0 masks embeddings, the others bits."""
    segments = [[2 * s, 2 * s + 1] for s in range(32)]
    blocks = [sum(part, []) for part in parts_of(segments)]
    masks = [[sum(1 << b for b in block) for block in blocks]]
    free = [[b for b in range(64) if b not in block] for block in blocks]
    fixed = [0] * len(blocks)
    for _ in range(DEPTH):
        fixed, free = zip(*[(f | sum(1 << b for b in part), [b for b in rest if b not in part]) for f, rest in zip(fixed, free) for part in parts_of(rest)])
        masks.append(list(fixed))
    return masks


MASKS = cell_masks()


def embedding(f="f"):
    """Thermometer code of the bit count of each two-bit segment."""
    f = F.col(f)
    low, high = f.bitwiseAND(LOW_BITS), F.shiftrightunsigned(f, 1).bitwiseAND(LOW_BITS)
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def grid(fingerprints):
    """(cell, path, f) of each fingerprint for every block of the embedding."""
    code = embedding()
    cells = [F.struct(F.xxhash64(F.lit(p), code.bitwiseAND(signed(m))).alias("cell"), F.lit(p).alias("path")) for p, m in enumerate(MASKS[0])]
    return fingerprints.select("f", F.inline(F.array(*cells)))


def divided(rows, level):
    """Cells of one level more for the rows of large cells."""
    rows = rows.select("cell", "f", F.explode(F.array(*[F.col("path") * (RADIUS + 1) + k for k in range(RADIUS + 1)])).alias("path"))
    mask = F.element_at(F.lit([signed(m) for m in MASKS[level]]).cast("array<bigint>"), F.col("path") + 1)
    return rows.select(F.xxhash64("cell", "path", F.col("f").bitwiseAND(mask)).alias("cell"), "path", "f")


def near_pairs(cell, ones, code, f, radius):
    """Blocks of pairs (i, j) of one cell within the radius; rows are in order of cell
    and number of set bits."""
    i, d = np.arange(len(f)), 1
    while True:
        i = i[i + d < len(f)]
        i = i[(cell[i] == cell[i + d]) & (ones[i + d] - ones[i] <= radius)]
        if not len(i):
            return
        near = i[np.bitwise_count(code[i] ^ code[i + d]) <= radius]
        near = near[np.bitwise_count(f[near] ^ f[near + d]) <= radius]
        if len(near):
            yield near, near + d
        d += 1


def spanning(pairs, n):
    """Those of the pairs that join components: every round hooks each root to the
    smallest root it is paired with."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                break
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            order = order[np.append(True, high[order][1:] != high[order][:-1])]
            root[high[order]] = low[order]
            yield i[order], j[order]
            while (root != root[root]).any():
                root = root[root]


def link_cells(radius):
    def run(batches):
        for table in whole_groups(batches, "cell"):
            cell, ones = table.column("cell").to_numpy(), table.column("ones").to_numpy()
            code, f = (table.column(c).to_numpy().view(np.uint64) for c in ("code", "f"))
            for i, j in spanning(near_pairs(cell, ones, code, f, radius), len(f)):
                yield pa.RecordBatch.from_arrays([pa.array(f[i].view(np.int64)), pa.array(f[j].view(np.int64))], names=["x", "y"])

    return run


def fingerprint_links(fingerprints, small=None):
    """Links (x, y) that join the distinct fingerprints ``f`` within RADIUS bits."""
    small = small or CELL
    rows, found = grid(fingerprints), None
    for level in range(DEPTH + 1):
        large = A.stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("cell"), "large-cells")
        more = level < DEPTH and not large.isEmpty()
        here = rows.join(large, "cell", "left_anti") if more else rows
        here = here.select("cell", "f", F.bit_count("f").alias("ones"), embedding().alias("code"))
        here = here.repartition("cell").sortWithinPartitions("cell", "ones")
        links = here.mapInArrow(link_cells(RADIUS), "x long, y long")
        found = links if found is None else found.unionByName(links)
        if not more:
            return found
        rows = A.stored(divided(rows.join(large, "cell"), level + 1), "cells")


def simhash_dedup(documents, words=WORDS, seed=SEED, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Shingles are ``words`` consecutive lower-cased words joined by a space, a shorter
    text is one shingle; a text without words (null, empty, blank) has the fingerprint
    zero and links like any other. ``component_id`` is the smallest id of the component,
    null only if no id is known; rows that repeat share it. Other columns are ignored;
    an empty table gives an empty table.
    """
    A.ready(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = A.stored(docs.mapInArrow(fingerprint_rows(words, seed), f"doc_id {kind}, f long"), "simhash")
    classes = A.stored(docs.groupBy("f").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(fingerprint_links(classes.select("f"))).withColumnRenamed("v", "f")
    classes = classes.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    # classes of one row and one fingerprint need no look-up
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1")
    named = classes.join(lowest, "root").select("f", "component_id")
    out = docs.join(named, "f", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
