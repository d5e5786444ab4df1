import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsmill.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    """Sequences that plain best fit, longest first, needs."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity
        if room > x:
            insort(rooms, room - x)
    return n


def pieces_of(rows, capacity):
    enc, out = Tokenizer.from_file(PATH), []
    for i, t in rows:
        ids = enc.encode(t or "", add_special_tokens=False).ids + [0]
        start, k = 0, 0
        first = len(ids) % capacity or capacity
        while start < len(ids):
            own = ids[start : start + (first if k == 0 else capacity)]
            out.append((i, k, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
            start, k = start + len(own), k + 1
    return out


def check(got, rows, capacity=2048):
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(pieces_of(rows, capacity), key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in got]
    assert -(-sum(lengths) // capacity) <= len(held) <= best_fit(lengths, capacity)


def test_hot_length_long_texts_and_ties(table):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "été", "of", "the"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 9, 60, 200, 600])))) for i in range(300)]
    rows += [(1000 + i, "one and the same text") for i in range(200)]
    rows += [(2000, " ".join(rnd.choices(words, k=9000))), (2001, None), (2002, ""), (2003, "a"), (2003, "a"), (None, "a b"), (None, None)]
    check(P.best_fit_packing(table(rows), PATH).collect(), rows)


def test_small_capacity(table):
    rows = [(i, "word " * (i % 23)) for i in range(150)]
    check(P.best_fit_packing(table(rows), PATH, capacity=16).collect(), rows, 16)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(P.best_fit_packing(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(table):
    assert P.best_fit_packing(table([]), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_length_once(seed):
    rnd = random.Random(seed)
    counts = {rnd.randint(1, 2048): rnd.randint(1, 40) for _ in range(rnd.choice([1, 5, 60, 400]))}
    counts[rnd.randint(1, 2048)] = 5000
    plan = P.pack_lengths(counts)
    assert plan.rank == counts and not any(plan.left.values())
    lengths = [x for x, c in counts.items() for _ in range(c)]
    assert plan.sequences <= 1.005 * best_fit(lengths, 2048)  # grouping may lose a little against plain best fit
