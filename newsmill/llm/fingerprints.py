"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, or a piece of it between content-defined cuts (about 16 bytes
apart), so an edit changes few digests. Each digest enters three cells, one in each
third of the sketch; a cell keeps a count, the xor of its digests and of their checks.
The difference of two sketches holds what only one text has; peeling cells with a
single digest recovers it. Where peeling stops early the pair is tried again with
sketches four times the size.

All pairs of a block are built and peeled together on arrays. The next document is
found by one range layout of the table: the first row of a range is also sent, as a
closing row, to the range before.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import arrays as A

CELLS = 18
SPREAD = 16
LOWEST = -(2**63)
SALTS = [A.U(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]


def digests(offs, raw):
    """(digest, row) of the paragraphs of each row; repeats are numbered, so equal
    paragraphs have different digests and equal texts equal lists."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = A.BYTE_CODES[raw]
    cut = raw == 10
    if n >= 4:
        h = A.gram_hashes(code, 4)
        cut[3:] |= (h & A.U(SPREAD - 1)) == 0
    row_at = np.searchsorted(offs, np.arange(n), "right") - 1
    # a cut looks at the four bytes before it, all in one row
    near = np.arange(n) - offs[row_at] < 3
    cut &= ~near | (raw == 10)
    start = np.zeros(n, bool)
    start[1:] = cut[:-1]
    start[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    h, row = A.span_hashes(code, starts, ends), row_at[starts]
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    first = np.ones(len(hs), bool)
    first[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    at = np.flatnonzero(first)
    number = np.arange(len(hs)) - np.repeat(at, np.diff(np.append(at, len(hs))))
    return A.mix(hs + number.astype(np.uint64) * A.STEP), rs


def check_of(keys):
    return A.mix(keys ^ A.U(0x5851F42D4C957F2D))


def cells_of(keys, owner, cells):
    third = cells // 3
    return [owner * cells + k * third + (A.mix(keys ^ salt) % A.U(third)).astype(np.int64) for k, salt in enumerate(SALTS)]


class Sketches:
    """One sketch per owner, all of one size."""

    def __init__(self, owners, cells):
        self.cells = cells
        self.count = np.zeros(owners * cells, np.int64)
        self.keys = np.zeros(owners * cells, np.uint64)
        self.checks = np.zeros(owners * cells, np.uint64)

    def add(self, keys, owner, sign):
        check = check_of(keys)
        for at in cells_of(keys, owner, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)
        return self

    def peel(self):
        """(digests on either side per owner, owner is decoded)."""
        owners = len(self.count) // self.cells
        found = np.zeros(owners, np.int64)
        while True:
            one = np.flatnonzero(np.abs(self.count) == 1)
            one = one[self.checks[one] == check_of(self.keys[one])]
            if not len(one):
                break
            owner, key, sign = one // self.cells, self.keys[one], self.count[one]
            order = np.lexsort((key, owner))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            pick = order[new]
            found += np.bincount(owner[pick], minlength=owners)
            self.add(key[pick], owner[pick], -sign[pick])
        return found, ~(self.count.reshape(owners, -1).any(1) | self.keys.reshape(owners, -1).any(1))

    def text(self, owner):
        s = slice(owner * self.cells, (owner + 1) * self.cells)
        return base64.b64encode(self.count[s].astype("<i4").tobytes() + self.keys[s].astype("<u8").tobytes() + self.checks[s].astype("<u2").tobytes()).decode()


def take(lists, which):
    """Digests and new owner numbers of some rows of (digest, row, offsets)."""
    keys, cuts = lists
    sizes = cuts[which + 1] - cuts[which]
    base = np.cumsum(sizes) - sizes
    at = np.repeat(cuts[which] - base, sizes) + np.arange(int(sizes.sum()))
    return keys[at], np.repeat(np.arange(len(which)), sizes)


def likeness(lists, left, right):
    """Shared share of the digests of row pairs, from the difference of sketches."""
    cuts = lists[1]
    n_left, n_right = cuts[left + 1] - cuts[left], cuts[right + 1] - cuts[right]
    apart = np.zeros(len(left), np.int64)
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        # blocks of pairs keep the cells in bounds
        step, failed = max(1, (1 << 21) // cells), []
        for s in range(0, len(todo), step):
            part = todo[s : s + step]
            sketch = Sketches(len(part), cells)
            sketch.add(*take(lists, left[part]), 1).add(*take(lists, right[part]), -1)
            found, done = sketch.peel()
            apart[part[done]] = found[done]
            failed.append(part[~done])
        todo, cells = np.concatenate(failed), cells * 4
    shared = (n_left + n_right - apart) / 2
    total = n_left + n_right - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def sha256(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def describe(rows, kind):
    """Result rows for (doc_id, text, next text)."""
    edited = []
    for _, text, after in rows:
        n = len(text) // 4
        edited.append(text[: len(text) - n] + after[:n])
    texts = [t for _, t, _ in rows] + edited + [a for _, _, a in rows]
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    keys, row = digests(offs, np.frombuffer(b"".join(data), np.uint8))
    lists = (keys, np.searchsorted(row, np.arange(len(texts) + 1)))
    n = len(rows)
    own = np.arange(n)
    base = Sketches(2 * n, CELLS).add(*take(lists, np.arange(2 * n)), 1)
    columns = [
        pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([sha256(t) for t in edited]),
        pa.array([base.text(k) for k in own]), pa.array([base.text(n + k) for k in own]),
        pa.array(likeness(lists, own, n + own)), pa.array(likeness(lists, own, 2 * n + own)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def spread_ranges(splits, heads):
    """Give each row its range; a range's first row also closes the range before."""

    def run(batches):
        for batch in batches:
            order = batch.column("ord").to_numpy()
            bucket = np.searchsorted(splits, order, "left").astype(np.int64)
            at, to = [np.arange(len(order))], [bucket]
            for head, before in heads:
                hit = np.flatnonzero(order == head)
                at.append(hit)
                to.append(np.full(len(hit), before))
            last = np.zeros(sum(map(len, at)), bool)
            last[len(order) :] = True
            out = batch.take(pa.array(np.concatenate(at)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(to)), pa.array(last)], names=[*batch.schema.names, "bucket", "last"])

    return run


def only_buckets(splits):
    def run(batches):
        for batch in batches:
            order = batch.column("ord").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(splits, order, "left").astype(np.int64)), pa.array(order)], names=["bucket", "ord"])

    return run


def with_next(limit=1 << 19):
    """Pair each row with the next one of its range and describe them in blocks."""

    def run(batches):
        held, size, before = [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for r in zip(*[batch.column(c).to_pylist() for c in ("bucket", "last", "doc_id", "text")]):
                if before is not None and before[0] == r[0] and not before[1]:
                    held.append((before[2], before[3], r[3]))
                    size += 2 * len(before[3]) + len(r[3])
                    if size > limit:
                        yield describe(held, kind)
                        held, size = [], 0
                # only the first closing row of a range counts
                before = r
        if held:
            yield describe(held, kind)

    return run


def fingerprints(documents, id_col="doc_id", text_col="text", partitions=None):
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Rows are ordered by id, null ids first, equal ids by text; the last is followed by
    the first. Null text is empty; two empty texts have likeness 1; a table of one row
    is followed by itself; other columns are ignored; an empty table gives none.
    """
    spark = A.ready(documents.sparkSession)
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shares = [k / partitions for k in range(1, partitions)]
    # one number per range reaches the driver
    splits = np.unique(np.array(docs.select(F.col("ord").cast("double")).approxQuantile("ord", shares, 0.01 / partitions) if shares else [], np.float64)).astype(np.int64)
    firsts = docs.select("ord").mapInArrow(only_buckets(splits), "bucket long, ord long").groupBy("bucket").agg(F.min("ord").alias("head")).orderBy("bucket").collect()
    heads = [(firsts[(k + 1) % len(firsts)]["head"], firsts[k]["bucket"]) for k in range(len(firsts))]
    spread = docs.mapInArrow(spread_ranges(splits, heads), f"doc_id {kind}, text string, ord long, bucket long, last boolean")
    laid = spread.repartition(partitions, "bucket").sortWithinPartitions("bucket", "last", "ord", "text")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.mapInArrow(with_next(), schema)
