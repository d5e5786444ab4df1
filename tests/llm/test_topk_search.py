import math

import numpy as np
import pytest

from newsmill.llm import topk_search as S

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(1024 * float(np.float32(x))) for x in v]
        usable[i] = min(usable.get(i, w), w)
    out = []
    for q, v in usable.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(table, seed, monkeypatch):
    monkeypatch.setattr(S, "ANNULUS", 16)
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.choice([1, 3]) + rng.normal(size=8) * 0.2).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, [0.0] * 8), (2010, [1.0, 2.0]), (3, rows[9][1])]
    rows += [(2020, None), (None, rows[1][1]), (2030, [1.0, None]), (2040, [float("nan")] * 8), (2050, [float("inf")] * 8), (2060, [])]
    got = S.topk_search(table(rows, schema=SCHEMA), every=10, k=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 5)


def test_small_tables(table):
    assert S.topk_search(table([], schema=SCHEMA)).count() == 0
    rows = [(0, [1.0, 0.5]), (1, [2.0, 0.0]), (2, None)]
    assert sorted(map(tuple, S.topk_search(table(rows, schema=SCHEMA)).collect())) == brute(rows, 100, 10)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert sorted(map(tuple, S.topk_search(df).collect())) == brute([(r.vec_id, r.embedding) for r in df.collect()], 100, 10)
