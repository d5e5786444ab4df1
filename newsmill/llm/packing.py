"""Best-fit packing of tokenized documents by linear grouping.

Lengths are whole numbers up to the capacity, so their counts say all that packing
needs and stay small whatever the corpus: the plan is made from that table, and each
document looks up its place by its length and its rank among documents of that length.

Large lengths are put into groups of equal cardinality and rounded up to the group's
largest; patterns of these few sizes that fill a sequence best are chosen by dynamic
programming and used as often as the demand allows; actual lengths then take the
slots; small lengths go, longest first, where they fit best.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.llm.tokens import crc, encoder, text_groups

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n, capacity):
    """Piece sizes of a document of n ids: full pieces, the first may be shorter."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def tokenize_pieces(tokenizer, capacity, end_id):
    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, texts in text_groups(batch.column("text")):
                offs, ids = enc.encode(texts)
                out = []
                for k in range(len(texts)):
                    own = np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id))
                    start = 0
                    for j, n in enumerate(cut(len(own), capacity)):
                        out.append((doc_ids[i + k], j, start, n, crc(own[start : start + n])))
                        start += n
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Plan:
    """Places for all pieces of each length, as intervals of their ranks."""

    def __init__(self, counts, capacity):
        self.capacity, self.left = capacity, dict(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.rows, self.sequences, self.open = [], 0, {}

    def new(self, n):
        self.sequences += n
        return self.sequences - n

    def put(self, length, n, base, fill):
        """One piece of ``length`` into each of n sequences from ``base`` on."""
        self.rows.append((length, self.rank[length], base, fill))
        self.rank[length] += n
        self.left[length] -= n

    def keep_open(self, base, n, fill):
        if fill < self.capacity:
            self.open.setdefault(self.capacity - fill, []).append((base, n))


def grouped(lengths, counts, groups):
    """Linear grouping: [(rounded size, [[length, count], ...])], largest first."""
    total = sum(counts[x] for x in lengths)
    per, out, room = -(-total // groups) if total else 1, [], 0
    for x in sorted(lengths, reverse=True):
        c = counts[x]
        while c:
            if not room:
                out.append((x, []))
                room = per
            k = min(c, room)
            out[-1][1].append([x, k])
            c, room = c - k, room - k
    return out


def best_pattern(sizes, demand, capacity):
    """How many of each size fill a sequence best: the largest wanted one and what
    goes best with it."""
    lead = next(i for i, d in enumerate(demand) if d)
    reach = np.zeros(capacity + 1, np.int64) - 1
    start = sizes[lead]
    reach[start] = -2
    used = [0] * len(sizes)
    back = {start: None}
    for i, (size, d) in enumerate(zip(sizes, demand)):
        for _ in range(min(d - (i == lead), capacity // size)):
            src = np.flatnonzero(reach[: capacity + 1 - size] != -1)
            dst = src[reach[src + size] == -1] + size
            if not len(dst):
                break
            reach[dst] = i
            back.update((int(x), (int(x) - size, i)) for x in dst)
    at = int(np.flatnonzero(reach != -1)[-1])
    while back[at] is not None:
        at, i = back[at]
        used[i] += 1
    used[lead] += 1
    return used


def pack_lengths(counts, capacity=2048, groups=512, small=None, full=0.99):
    """Plan for {length: count}, lengths from 1 to the capacity. A large size without
    a pattern that fills ``full`` of a sequence waits for the best-fit pass."""
    counts = {int(x): int(c) for x, c in counts.items() if c}
    small = small or capacity // 8
    plan = Plan(counts, capacity)
    if counts.get(capacity):
        plan.put(capacity, counts[capacity], plan.new(counts[capacity]), 0)
    large = [x for x in counts if small <= x < capacity]
    pools = grouped(large, counts, groups)
    merged = []
    for size, pool in pools:  # one length may make several groups
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(pool)
        else:
            merged.append((size, list(pool)))
    sizes, demand = [s for s, _ in merged], [sum(k for _, k in p) for _, p in merged]
    while any(demand):
        used = best_pattern(sizes, demand, capacity)
        if sum(s * u for s, u in zip(sizes, used)) < full * capacity:
            demand[next(i for i, d in enumerate(demand) if d)] = 0
            continue
        times = min(d // u for d, u in zip(demand, used) if u)
        classes = [(plan.new(times), times, 0)]
        for i, u in enumerate(used):
            demand[i] -= u * times
            for _ in range(u):
                pool, filled = merged[i][1], []
                for base, n, fill in classes:
                    while n:
                        length, have = pool[0]
                        k = min(n, have)
                        plan.put(length, k, base, fill)
                        filled.append((base, k, fill + length))
                        base, n = base + k, n - k
                        pool[0][1] -= k
                        if not pool[0][1]:
                            pool.pop(0)
                classes = filled
        for c in classes:
            plan.keep_open(*c)
    for length in sorted(counts, reverse=True):
        while plan.left[length]:
            room = min((r for r in plan.open if r >= length), default=None)
            if room is None:
                n = -(-plan.left[length] // (capacity // length))
                plan.open[capacity] = [(plan.new(n), n)]
                room = capacity
            base, n = plan.open[room].pop()
            if not plan.open[room]:
                del plan.open[room]
            k = min(n, plan.left[length])
            plan.put(length, k, base, capacity - room)
            if n > k:
                plan.open.setdefault(room, []).append((base + k, n - k))
            plan.keep_open(base, k, capacity - room + length)
    return plan


def place(pieces, capacity=2048):
    """Add sequence_id and offset to rows with a ``length``. Ranks are counted in
    salted parts of each length, so a length that a third of all rows share is not
    ranked in one task."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = pack_lengths(counts, capacity)
    by_length = {}
    for length, lo, base, fill in sorted(plan.rows):
        for column, value in zip(by_length.setdefault(length, ([], [], [])), (lo, base, fill)):
            column.append(value)
    # bounded by the number of lengths and patterns, not by the corpus
    table = spark.createDataFrame([(k, *v) for k, v in by_length.items()], "length long, los array<long>, bases array<long>, fills array<long>")
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", F.coalesce(F.sum("n").over(part), F.lit(0)).alias("before"))
    ranked = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    at = ranked.join(F.broadcast(table), "length").withColumn("k", F.size(F.filter("los", lambda x: x <= F.col("rank"))))
    pick = lambda c: F.element_at(c, F.col("k"))
    at = at.withColumn("sequence_id", pick("bases") + F.col("rank") - pick("los")).withColumn("offset", pick("fills"))
    return at.select(*pieces.columns, "sequence_id", "offset")


def best_fit_packing(documents, tokenizer, capacity=2048, end_id=0, id_col="doc_id", text_col="text"):
    """Pack all documents into few sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null text is empty (one end id), null ids stay null, rows that repeat are packed
    as often as they occur, other columns are ignored, an empty table packs nothing.
    Only documents of more than ``capacity`` ids are cut; the first piece may be shorter.
    """
    A.ready(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = A.stored(docs.mapInArrow(tokenize_pieces(tokenizer, capacity, end_id), PIECES), "packing-pieces")
    return place(pieces, capacity)
