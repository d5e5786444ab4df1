import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from newsmill.llm import fingerprints as P


def exact(a, b):
    def pieces(t):
        keys, _ = P.digests(np.array([0, len(t.encode())]), np.frombuffer(t.encode(), np.uint8))
        return Counter(keys.tolist())

    a, b = pieces(a), pieces(b)
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 1.0


def check(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(exact(t, edited), 9), round(exact(t, after), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    text = {i: t or "" for i, t in rows}
    prints = {}
    for r in got:
        if list(i for i, _ in rows).count(r.doc_id) == 1:
            assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_edges_and_order(table, parts):
    rnd = random.Random(parts)
    text = lambda n: "".join(rnd.choice(["abc ", "dé\n", "x", "日本 ", "the "]) for _ in range(n))
    rows = [(rnd.randint(-50, 10**12), text(rnd.choice([0, 1, 3, 30, 400]))) for _ in range(60)]
    rows += [(7, None), (8, ""), (9, "same " * 50), (10, "same " * 50), (11, text(20000)), (None, "no id")]
    check(P.fingerprints(table(rows), partitions=parts).collect(), rows)


def test_repeated_and_single(table):
    rows = [(1, "a b c"), (1, "a b c"), (1, "b"), (2, "z")]
    check(P.fingerprints(table(rows), partitions=3).collect(), rows)
    check(P.fingerprints(table([(4, "alone here")])).collect(), [(4, "alone here")])
    assert P.fingerprints(table([])).count() == 0


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = P.fingerprints(docs).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.4 for r in long]) > 0.9 and np.mean([r.near_next < 0.3 for r in long]) > 0.9
