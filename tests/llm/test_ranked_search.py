import math
import random
import re

import numpy as np
import pytest

from newsmill.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            s = 0
            for t in set(terms(text)) & set(b):
                tf, m = b.count(t), 100 - 90 + 90 * len(b) * n_docs // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = ["the", "of"] + ["".join(rnd.choice("abcÉé9") for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    draw = lambda n: " ".join(vocabulary[int(rnd.paretovariate(0.6)) % len(vocabulary)] + rnd.choice(["", ",", "_", "-"]) for _ in range(n))
    docs = [(i, draw(rnd.choice([0, 1, 5, 30, 200])).title()) for i in range(n)]
    docs += [(1000 + i, docs[i][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "..."), (2003, docs[9][1]), (2003, docs[9][1]), (None, docs[9][1])]
    items = [(i, draw(rnd.randint(0, 12))) for i in range(40)] + [(50, None), (51, ""), (52, "!?"), (53, "zzz unseen"), (54, docs[9][1]), (54, docs[9][1]), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, table, seed):
    docs, items = corpus(seed)
    asked = table(items, schema="item_id long, text string")
    assert found(R.ranked_search(table(docs, parts=5), asked)) == brute(docs, items)


def test_items_in_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(R, "ITEM_BYTES", 300)
    docs, items = corpus(4, 100)
    assert found(R.ranked_search(table(docs), table(items, schema="item_id long, text string"), k=3)) == brute(docs, items, 3)


def test_small_batches_carry_the_best(spark, table):
    docs, items = corpus(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert found(R.ranked_search(table(docs, parts=1), table(items, schema="item_id long, text string"))) == brute(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def block():
    """1000 documents of 10 terms: a common term 0, and a rare term 1 in 20 of them."""
    lists = [[0, 1] if d % 50 == 0 else [0] for d in range(1000)]
    offs, values = np.cumsum([0, *map(len, lists)]), np.array(sum(lists, []), np.int32)
    weights = np.array([R.weight(1000, 1000), R.weight(1000, 20)], np.int64)
    return R.Postings(np.full(1000, 10), (offs, values), (offs, np.ones(len(values), np.int32)), weights, 1000, 10000)


def test_accumulators_are_limited():
    item, none = np.array([1, 0]), np.zeros(0, np.int64)
    rows, score, made = block().search(item, 10, none)
    assert made == 20 and rows.tolist() == list(range(0, 1000, 50))
    every = dict(zip(*(x.tolist() for x in block().search(item, 1000, none)[:2])))
    assert score.tolist() == [every[r] for r in rows.tolist()]


def test_known_scores_close_a_block():
    rows, _, made = block().search(np.array([1, 0]), 10, np.full(10, 10**12))
    assert made == 0 and not len(rows)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000)) + " " + "x" * 200_000
    docs = spark.createDataFrame([(1, long, 5, "a"), (2, "w1 w2", 6, "b"), (3, "rare", 7, "c")], "doc_id long, text string, n long, terms string")
    items = spark.createDataFrame([(1, "W1 rare w4999", 1, 2)], "item_id long, text string, rank long, q long")
    assert found(R.ranked_search(docs, items)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, "W1 rare w4999")])


def test_empty_tables(spark, table):
    one = table([(1, "a b")])
    items = table([(1, "a")], schema="item_id long, text string")
    nothing = table([], schema="item_id long, text string")
    assert R.ranked_search(table([]), items).count() == 0
    assert R.ranked_search(one, nothing).count() == 0
    assert R.ranked_search(one, nothing).columns == ["item_id", "rank", "doc_id", "score"]
