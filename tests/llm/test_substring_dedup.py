import hashlib
import random
import re

import pytest

from newsmill.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    """Ids are distinct here, or the whole row repeats."""
    first, out = {}, []
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    for known, i, t in order:
        w = WORD.findall(t)
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (known, i, s))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] != (i is not None, i or 0, s):
                gone[s : s + length] = [True] * length
        rest = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice(["a", "bé", "c", "d x"]) + rnd.choice([" ", "\n", " \t ", "\x0b"]) for _ in range(n))
    passage, other = text(40), text(25)
    rows = [(i, text(rnd.randint(0, 60))) for i in range(30)]
    rows += [(100 + i, text(5) + passage + text(rnd.randint(0, 9))) for i in range(25)]
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, other), (201, other), (202, None), (203, ""), (204, "ab " * 60), (205, " \n"), (206, text(30) + passage + other + passage), (-4, passage)]
    return rows


@pytest.mark.parametrize("length,hot", [(8, 2000), (12, 3), (20, 5)])
def test_against_brute_force(table, length, hot):
    rows = corpus(length)
    got = S.substring_dedup(table(rows), length=length, hot_runs=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, length)


def test_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in S.substring_dedup(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 20)


def test_empty_table(table):
    assert S.substring_dedup(table([]), length=8).count() == 0
