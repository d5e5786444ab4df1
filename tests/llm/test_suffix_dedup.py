import hashlib
import os
import random

import numpy as np
import pytest

from newsmill.llm import suffix_dedup as S
from newsmill.session import shared_dir


def brute(rows, length):
    seen, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(40), text(25)
    rows = [(i, text(rnd.randint(0, 60))) for i in range(30)]
    rows += [(100 + i, text(5) + passage + text(rnd.randint(0, 9))) for i in range(25)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, other), (201, other), (202, None), (203, ""), (204, "ab" * 400), (205, "x" * 90), (206, text(30) + passage[3:80] + other[:70] + passage)]
    return rows


@pytest.mark.parametrize("length,hot", [(24, 2000), (40, 3), (64, 2000)])
def test_against_brute_force(table, length, hot):
    rows = corpus(length)
    got = S.suffix_dedup(table(rows), length=length, hot_runs=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, length)


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in S.suffix_dedup(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 200)


def test_empty_table(table):
    assert S.suffix_dedup(table([]), length=24).count() == 0


def test_suffix_array():
    rnd = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 10, 50, 300]:
        s = np.append(rnd.integers(1, 4, n), 9)
        assert S.suffix_array(s).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_runs_are_deleted_once_pieces_are_cut(spark, table):
    """The runs of all minima are read no more when the pieces are stored, and are gone then."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    passage = " ".join(f"word{i}" for i in range(60))
    spans = S.repeated_spans(table([(1, "a " + passage), (2, "b " + passage), (3, "short")]))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "repeat-runs" not in left and "repeat-pieces" in left
    assert spans.count() == 2
