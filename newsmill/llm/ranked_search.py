"""Ranked lexical search, a term at a time with limited accumulators.

The documents stay where they are. One scan leaves, per document, its number of terms
and the counts of those terms that the items ask for; the corpus statistics are sums over
that. Each task then turns its documents into posting lists, a few thousand documents at
a time, and answers every item on them:

* terms are taken rarest first, so that the first accumulators hold high scores;
* the bound of a term is its largest contribution in these documents. Once the bounds of
  the terms left add up to less than the k-th best partial score (of these documents and
  of the best ones found earlier in the task), no further document gets an accumulator;
* the documents that have one are updated by all terms left, so their scores are exact.

A task returns k rows an item, which are ranked once more over all tasks. Items come in
blocks of at most ``ITEM_BYTES`` of text (or one longer item), so what a task is sent is
bounded whatever the number of items. Terms are told apart by 64-bit hashes; a false
match needs a corpus word and an item's term with equal ones.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.llm import arrays as A

ITEM_BYTES = 16 << 20
NO_TERM = np.ones(256, bool)
NO_TERM[0x30:0x3A] = NO_TERM[0x41:0x5B] = NO_TERM[0x61:0x7B] = NO_TERM[0x80:] = False


def term_hashes(offs, raw):
    """(hash, row) of every term, repeats included."""
    raw = A.LOWER[raw]
    starts, ends, row = A.words_of(offs, raw, NO_TERM)
    return A.word_hashes(raw, starts, ends), row


def count_terms(vocabulary):
    """Number of terms of each text, and the counts of those in the vocabulary."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for i, offs, raw in A.text_blocks(batch.column("text")):
                n = len(offs) - 1
                h, row = term_hashes(offs, raw)
                at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                both, count = np.unique(row[hit] * max(len(vocabulary), 1) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(both // max(len(vocabulary), 1), np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both % max(len(vocabulary), 1), count)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, n), pa.array(np.bincount(row, minlength=n).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "tf"])

    return run


def weight(documents, df):
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Postings:
    """Posting lists of a block of documents, in order of term and document."""

    def __init__(self, n, terms, tf, weights, documents, total):
        """``n``: terms of each document; ``terms`` and ``tf``: lists of one document
        after the other, as (offsets, values)."""
        row = np.repeat(np.arange(len(n)), np.diff(terms[0]))
        m = 10 + 90 * n * documents // max(total, 1)
        count = tf[1].astype(np.int64)
        value = weights[terms[1]] * (1_000_000_000 * count // (1000 * count + 8 * m[row]))
        order = np.argsort(terms[1], kind="stable")
        self.rows, self.values, self.size = row[order], value[order], len(n)
        self.terms, self.first = np.unique(terms[1][order], return_index=True)
        self.end = np.append(self.first[1:], len(order))
        self.bound = np.maximum.reduceat(self.values, self.first) if len(order) else np.zeros(0, np.int64)

    def search(self, item, k, known):
        """(rows, scores, accumulators made) of an item's terms, rarest first; the rows
        include the k best that beat or meet the scores ``known`` already."""
        at = np.searchsorted(self.terms, item)
        at = at[at < len(self.terms)] if not len(self.terms) else at[self.terms[np.minimum(at, len(self.terms) - 1)] == item]
        left = np.cumsum(self.bound[at][::-1])[::-1]
        score, made, floor, open_ = np.zeros(self.size, np.int64), np.zeros(0, np.int64), 0, True
        if len(known) >= k:
            floor = known[k - 1]
        for j, t in enumerate(at):
            rows, values = self.rows[self.first[t] : self.end[t]], self.values[self.first[t] : self.end[t]]
            if open_ and left[j] < floor:
                open_, made = False, np.flatnonzero(score)
                if not len(made):
                    break
            if open_:
                score[rows] += values
                floor = max(floor, kth(score, known, k))
            elif len(made) < len(rows) // 8:
                place = np.searchsorted(rows, made)
                place[place == len(rows)] = 0
                hit = rows[place] == made
                score[made[hit]] += values[place[hit]]
            else:
                hit = score[rows] > 0
                score[rows[hit]] += values[hit]
        if open_:
            made = np.flatnonzero(score)
        return made, score[made], len(made)


def kth(score, known, k):
    """The k-th best of both, 0 if there are fewer."""
    best = np.partition(score, -k)[-k:] if len(score) > k else score
    best = np.concatenate((best, known))
    return int(np.partition(best, -k)[-k]) if len(best) >= k else 0


def best(score, doc, known, k):
    """Places of the k best: highest score, then smallest id, unknown ids last."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((doc[at], ~known[at], -score[at]))[:k]]


def rank_documents(items, weights, documents, total, k):
    """The k best documents of a task for each item."""

    def run(batches):
        none = np.zeros(0, np.int64)
        top = [(none, none, np.zeros(0, bool))] * len(items)
        for batch in batches:
            if not len(batch):
                continue
            lists = [batch.column(c) for c in ("terms", "tf")]
            lists = [(c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten().to_numpy()) for c in lists]
            block = Postings(batch.column("n").to_numpy(), *lists, weights, documents, total)
            ids = batch.column("doc_id")
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for q, item in enumerate(items):
                rows, score, _ = block.search(item, k, top[q][0])
                if len(rows):
                    score, doc, named = (np.concatenate(p) for p in zip(top[q], (score, ids[rows], known[rows])))
                    at = best(score, doc, named, k)
                    top[q] = score[at], doc[at], named[at]
        for q, (score, doc, named) in enumerate(top):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q)), pa.array(doc, mask=~named), pa.array(score)], names=["q", "doc_id", "score"])

    return run


def answer(docs, items, k, kind):
    """Rows for the (item_id, text) of one block."""
    spark = docs.sparkSession
    offs = np.cumsum([0, *[len((t or "").encode()) for _, t in items]])
    raw = np.frombuffer("".join(t or "" for _, t in items).encode(), np.uint8)
    h, row = term_hashes(offs, raw) if len(raw) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    vocabulary = np.unique(h)
    counted = docs.mapInArrow(count_terms(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>")
    counted = A.stored(counted.where("n > 0"), "term-counts")
    documents, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each term of the items at most
    df = np.zeros(len(vocabulary), np.int64)
    for t, n in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():
        df[t] = n
    weights = np.array([weight(documents, n) for n in df.tolist()], np.int64)
    asked = []
    for q in range(len(items)):
        terms = np.unique(np.searchsorted(vocabulary, h[row == q]))
        asked.append(terms[np.lexsort((terms, df[terms]))])
    found = counted.mapInArrow(rank_documents(asked, weights, documents, total, k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], f"q long, item_id {kind}")
    return found.join(names, "q").select("item_id", "rank", "doc_id", "score")


def ranked_search(documents, items, k=10, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    A term is a run of ASCII letters, digits and signs beyond ASCII, with A-Z in lower
    case. Its weight w is floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents
    with a term; a document of n terms has m = 10 + 90 n N div L, L being all terms, and
    scores the sum of w * (10^9 tf div (1000 tf + 8 m)) over an item's terms, once each.
    Only scores above 0 count; equal ones go by ascending id, null ids last.

    Null texts have no terms. Every row of ``items`` is an item of its own, also where an
    id repeats; rows of documents that repeat are ranked each. Items or documents without
    terms, or an empty table, give no rows. Other columns are ignored.
    """
    A.ready(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks, out = max(1, -(-size // ITEM_BYTES)), None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = answer(docs, [tuple(r) for r in part.collect()], k, kind)
        out = rows if out is None else out.unionByName(rows)
    return out
