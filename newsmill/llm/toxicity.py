"""Toxicity by a factorization machine over hashed terms.

A term is a run of letters, lower-cased, or the first few bytes of one, so that
compounds of known stems are known; a document is the set of its terms' hashes. The
machine scores every term and, by inner products of short vectors, every pair of terms,
so two terms may say together what neither says alone.

It is fitted on a bounded sample of labelled rows, in the order of a hash of the id: at
most ``sample`` rows, and no row after the one that brings the terms of their whole texts
to ``SAMPLE_TERMS``. One task fits it, so neither the number nor the length of the rows
reaches the driver; the machine, of at most 2^``BUCKET_BITS`` terms, is a table in the
shared folder, which every Python worker reads once. Scoring reads every whole text and
needs no shuffle.
"""

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.session import run_dir

BUCKET_BITS, RANK = 24, 6
PREFIXES = (3, 4, 5, 6, 8)
SAMPLE_TERMS = 1 << 25
TEXT_BLOCK = 1 << 19
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def term_sets(offs, raw):
    """(bucket, row) of the distinct hashed terms of each row, sorted by row."""
    raw = A.LOWER[raw]
    starts, ends, row = A.words_of(offs, raw, NO_LETTER)
    both = [(row << BUCKET_BITS) | bucket_of(A.word_hashes(raw, starts, ends))]
    for k in PREFIXES:
        longer = ends - starts > k
        first, r = starts[longer], row[longer]
        both.append((r << BUCKET_BITS) | bucket_of(A.mix(A.word_hashes(raw, first, first + k) + A.U(k))))
    both = np.unique(np.concatenate(both))
    return both & ((1 << BUCKET_BITS) - 1), both >> BUCKET_BITS


def bucket_of(hashes):
    return (hashes >> A.U(64 - BUCKET_BITS)).astype(np.int64)


def list_terms(batches):
    for batch in batches:
        ids, label = batch.column("doc_id"), batch.column("label")
        for i, offs, raw in A.text_blocks(batch.column("text"), TEXT_BLOCK):
            bucket, row = term_sets(offs, raw)
            n = len(offs) - 1
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), label.slice(i, n), lists], names=["doc_id", "label", "terms"])


def held_out(doc_id):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


class Machine:
    """bias + sum of w over the set + sum over pairs of <v_i, v_j>."""

    def __init__(self, buckets, bias, w, v):
        self.buckets, self.bias, self.w, self.v = buckets, bias, w, v

    def scores(self, bucket, row, n):
        z = np.full(n, self.bias)
        if len(self.buckets) and len(bucket):
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            at, row = at[hit], row[hit]
            z += np.bincount(row, self.w[at], n)
            for v in self.v.T:
                s = np.bincount(row, v[at], n)
                z += (s * s - np.bincount(row, v[at] ** 2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slices(n, step=1 << 20):
    return [slice(i, i + step) for i in range(0, n, step)]


def weighed(at, ends, y, prior, kinds):
    """How much each term can tell: how far its share of toxic rows is from the prior,
    in standard errors, smoothed; 1 from four errors on. Rare terms that are pure
    weigh as much as frequent ones, and none is dropped."""
    seen, bad = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    for s in slices(len(at)):
        seen += np.bincount(at[s], minlength=kinds)
    for i in np.flatnonzero(y == 1):
        bad[at[ends[i] : ends[i + 1]]] += 1  # terms of a row are distinct
    z = np.abs(bad - seen * prior) / np.sqrt(seen * prior * (1 - prior) + 0.2)
    return np.minimum(z / 4, 1) ** 1.5


def fit(bucket, ends, labels, passes=10, steps=400, batch=128, rates=(0.1, 0.03), seed=1):
    """Fit by Adagrad on the logistic loss; deterministic. Row i has the terms
    ``bucket[ends[i] : ends[i + 1]]``; the array is used up. A step takes ``batch`` sparse
    rows and touches only their terms; there are at least ``steps`` of them."""
    y = np.asarray(labels, np.float64)
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not n or y.min() == y.max() or not ends[-1]:
        return Machine(np.zeros(0, np.int32), bias if n else -30.0, np.zeros(0), np.zeros((0, RANK)))
    known = np.zeros(1 << BUCKET_BITS, bool)
    known[bucket] = True
    kinds, at = np.flatnonzero(known).astype(np.int32), bucket
    del known
    for s in slices(len(at)):
        at[s] = np.searchsorted(kinds, at[s])
    scale = weighed(at, ends, y, prior, len(kinds))
    rng = np.random.default_rng(seed)
    # row k holds the k-th place of every term's vector; row 0 its weight
    theta = np.zeros((RANK + 1, len(kinds)), np.float32)
    theta[1:] = rng.normal(0, 0.02, (RANK, len(kinds)))
    power, bias_power = np.full(theta.shape, 1e-4, np.float32), 1e-4
    rate = np.array([rates[0]] + [rates[1]] * RANK)[:, None]
    for _ in range(max(passes, -(-steps * batch // max(n, batch)))):
        order = rng.permutation(n)
        for some in (order[i : i + batch] for i in range(0, n, batch)):
            m, r = len(some), np.repeat(np.arange(len(some)), ends[some + 1] - ends[some])
            if not len(r):
                continue
            terms, t = np.unique(np.concatenate([at[ends[i] : ends[i + 1]] for i in some]), return_inverse=True)
            x, old = scale[terms], theta[:, terms]
            told = old * x
            sums = np.stack([np.bincount(r, u[t], m) for u in told])
            squares = np.bincount(r, (told[1:] ** 2).sum(0)[t], m)
            score = bias + sums[0] + ((sums[1:] ** 2).sum(0) - squares) / 2
            e = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[some]
            plain = np.bincount(t, e[r], len(terms))
            slope = [plain, *[np.bincount(t, (e * u)[r], len(terms)) - plain * v for u, v in zip(sums[1:], told[1:])]]
            slope = np.stack(slope) * x / m
            power[:, terms] += slope**2
            theta[:, terms] = old - rate * slope / np.sqrt(power[:, terms])
            bias_power += e.mean() ** 2
            bias -= rates[0] * e.mean() / np.sqrt(bias_power)
    theta *= scale
    return Machine(kinds, float(bias), theta[0], theta[1:].T)


def train(documents, labels, sample=20000, id_col="doc_id", text_col="text", label_col="toxic"):
    """Path of the machine fitted on at most ``sample`` labelled rows that are not held out."""
    spark = A.ready(documents.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # at most ``sample`` ids and labels: small enough to send everywhere
    rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # repeated ids count once, so the sample is what one task receives at most
    rows = rows.mapInArrow(list_terms, f"doc_id {kind}, label int, terms array<int>").dropDuplicates(["doc_id"])
    rows = rows.select("label", "terms", F.xxhash64("doc_id").alias("h"), "doc_id").repartition(1).sortWithinPartitions("h", "doc_id")
    path = run_dir(spark, "machine")
    rows.select("label", "terms").mapInArrow(fit_sample(SAMPLE_TERMS), MACHINE).write.parquet(path)
    return path


MACHINE = "bucket int, w float, " + ", ".join(f"v{k} float" for k in range(RANK))


def fit_sample(most):
    """The machine of the rows, as a table; the row of bucket -1 holds the bias."""

    def run(batches):
        labels, terms, held = [], [], 0
        for batch in batches:
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy())
            before = held + np.cumsum(sizes) - sizes
            n = int(np.searchsorted(before, most))  # rows that begin below the bound
            labels.append(batch.column("label").to_numpy()[:n])
            terms.append((lists.slice(0, n).flatten().to_numpy(), sizes[:n]))
            held += int(sizes[:n].sum())
            if n < len(sizes):
                break
        for _ in batches:
            pass  # read to the end
        sizes = np.concatenate([z for _, z in terms]) if terms else np.zeros(0, np.int64)
        bucket, at = np.empty(held, np.int32), 0
        while terms:
            some = terms.pop(0)[0]
            bucket[at : at + len(some)] = some
            at += len(some)
        machine = fit(bucket, np.concatenate(([0], np.cumsum(sizes))), np.concatenate(labels) if labels else [])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([machine.bias], pa.float32()), *[pa.array([0], pa.float32())] * RANK], names=machine_names())
        for s in slices(len(machine.buckets), 1 << 16):
            columns = [machine.buckets[s], machine.w[s], *machine.v[s].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), *[pa.float32()] * (RANK + 1)))], names=machine_names())

    return run


def machine_names():
    return ["bucket", "w", *[f"v{k}" for k in range(RANK)]]


_machines = {}


def machine_at(path):
    """The machine of a table; a worker reads it once and keeps the last one."""
    if path not in _machines:
        where, base = pa.fs.FileSystem.from_uri(path)
        found = [f.path for f in where.get_file_info(pa.fs.FileSelector(base)) if f.path.endswith(".parquet")]
        tables = [t for t in (pa.parquet.read_table(f, filesystem=where) for f in found) if len(t)]
        _machines.clear()
        if tables:
            table = pa.concat_tables(tables).sort_by("bucket")
            bucket, w, *v = (table.column(c).to_numpy() for c in machine_names())
            _machines[path] = Machine(bucket[1:], float(w[0]), w[1:], np.stack(v, 1)[1:])
        else:  # no labelled row, so no task
            _machines[path] = fit(np.zeros(0, np.int32), np.zeros(1, np.int64), [])
    return _machines[path]


def score_texts(path):
    def run(batches):
        machine = machine_at(path)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, offs, raw in A.text_blocks(batch.column("text"), TEXT_BLOCK):
                n = len(offs) - 1
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(machine.scores(*term_sets(offs, raw), n))], names=["doc_id", "score"])

    return run


def score_toxicity(documents, labels, sample=20000, id_col="doc_id", text_col="text", label_col="toxic"):
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without terms; rows without an id are
    scored too (held_out is null) but never learned from; rows that repeat score alike;
    without usable labels every score is near 0; other columns are ignored.
    """
    path = train(documents, labels, sample, id_col, text_col, label_col)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(score_texts(path), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(documents, labels, sample=20000, id_col="doc_id", text_col="text", label_col="toxic"):
    """The documents, all columns, without those predicted toxic."""
    path = train(documents, labels, sample, id_col, text_col, label_col)

    def run(batches):
        machine = machine_at(path)
        for batch in batches:
            for i, offs, raw in A.text_blocks(batch.column(text_col), TEXT_BLOCK):
                n = len(offs) - 1
                yield batch.slice(i, n).filter(pa.array(machine.scores(*term_sets(offs, raw), n) < 0.5))

    return documents.mapInArrow(run, documents.schema)
