import math
import os
import random
import re

import numpy as np
import pytest

from newsmill.llm import near_dedup as N
from newsmill.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = low.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, c == i))
    return sorted(out, key=repr)


def corpus(seed, copies=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeÉf") for _ in range(rnd.randint(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(30)
    rows = [(i, " ".join(text(rnd.randint(0, 70)) + (passage if i % 2 else []))) for i in range(120)]
    base = text(150)

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[rnd.randrange(len(w))] = word()
        return " ".join(w)

    rows += [(1000 + i, edited(base, rnd.randint(0, 9))) for i in range(copies)]
    rows += [(3000 + i, edited(rows[i][1].split() or ["x"], rnd.randint(0, 3)).upper().replace("É", "É")) for i in range(120)]
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A\tB"), (5005, "a b"), (5005, "a b"), (None, "a b c"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(table, seed):
    rows = corpus(seed)
    got = N.near_dedup(table(rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("depth", [2, 6])
def test_large_nodes(table, monkeypatch, depth):
    monkeypatch.setattr(N, "SMALL", 8)
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "DEPTH", depth)
    rows = corpus(5)
    assert sorted((tuple(r) for r in N.near_dedup(table(rows)).collect()), key=repr) == brute(rows)


def family(seed, size=150):
    """Edits of one text: most pairs lie a little below the similarity, some above."""
    rnd = random.Random(seed)
    base, rows = [f"w{rnd.randrange(10**6)}" for _ in range(200)], []
    for i in range(size):
        w = list(base)
        for k in rnd.sample(range(200), rnd.choice([2, 3, 4, 5, 6])):
            w[k] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small", [16, 256])
def test_family_below_the_similarity(table, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "BLOCK", small)
    rows = family(3) + [(1000 + i, t + " and more") for i, t in family(3)[::3]] + [(2000 + i, t) for i, t in family(4, 40)]
    assert sorted((tuple(r) for r in N.near_dedup(table(rows)).collect()), key=repr) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted((tuple(r) for r in N.near_dedup(docs).collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(table):
    assert N.near_dedup(table([])).count() == 0


def test_sketch_bound_loses_no_link():
    share = 0.75 + 0.25 / 16  # of a sketch's tokens, at exactly the similarity
    miss = sum(math.comb(N.TOKENS, k) * share**k * (1 - share) ** (N.TOKENS - k) for k in range(N.LIKELY))
    assert miss < 1e-8
    sketch = np.zeros((2, N.TOKENS // 2), np.uint8)
    sketch[1, 80:] = 0x11  # 160 of 256 agree
    group, key, size = np.zeros(2, np.int64), np.arange(2), np.full(2, 100)
    found = list(N.likely_pairs(group, key, size, sketch, 0.75, lambda i, j: np.ones(len(i), bool)))
    assert [(a.tolist(), b.tolist(), n.tolist()) for a, b, n in found] == [([0], [1], [160])]


def test_near_copies_do_not_branch(spark, monkeypatch):
    """A large node of near copies is compared where it is: more levels would only repeat its rows."""
    monkeypatch.setattr(N, "SMALL", 64)
    rnd = np.random.Generator(np.random.PCG64(1))
    base, rows = rnd.integers(1, 2**32, N.PATH_TOKENS, dtype=np.uint32), []
    for key in range(600):
        mins = base.copy()
        mins[rnd.integers(0, N.PATH_TOKENS, 1)] = key
        rows.append((key, bytearray(mins.tobytes())))
    nodes = N.nodes_to_compare(spark.createDataFrame(rows, "key long, mins binary")).collect()
    large = [n for n in nodes if n.blocks > 1]
    assert len({n.node for n in large}) == N.TREES * N.BRANCHES
    assert {n.path % N.CHOICE.shape[1] for n in large} <= set(range(1, N.BRANCHES + 1))


def test_steps_are_stored_once_and_deleted(spark, table):
    """Of the tables of the descent and of the full sets nothing is left in the shared folder;
    what is left holds no tokens, and the result is read from it."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = corpus(3)
    found = N.near_dedup(table(rows))
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"paths", "dense-nodes", "path-nodes", "shingle-sets", "set-classes", "full-sets", "likeliest"}
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_large_levels_are_decided_once(spark, monkeypatch):
    """Whether nodes are dense is worked out once a level, not for each reader of the level."""
    monkeypatch.setattr(N, "SMALL", 8)
    seen, dense = [], N.dense_below
    monkeypatch.setattr(N, "dense_below", lambda rows, reps, level: seen.append(level) or dense(rows, reps, level))
    rnd = np.random.Generator(np.random.PCG64(2))
    rows = [(k, bytearray(rnd.integers(1, 3, N.PATH_TOKENS, dtype=np.uint32).tobytes())) for k in range(200)]
    nodes = N.nodes_to_compare(spark.createDataFrame(rows, "key long, mins binary"))
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) > 1 and "Aggregate" not in plan and "MapInArrow" not in plan
