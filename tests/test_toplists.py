import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsmill.operators import toplists


def brute(rows, k):
    groups = {}
    for g, f, m in rows:
        groups.setdefault(g, Counter())[f, m] += 1
    low = lambda x: (x is not None, x or "")  # nulls first
    out = set()
    for g, c in groups.items():
        ranked = sorted(c.items(), key=lambda e: (-e[1], low(e[0][0]), low(e[0][1])))
        out |= {(g, f, m, n, r) for r, ((f, m), n) in enumerate(ranked[:k], 1)}
    return out


def rows(seed, n=3000):
    """Zipf-like items in one hot group, flat ones in another, nulls, few in a third."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        g = rng.choice(["hot", "hot", "flat", None])
        m = f"m{int(rng.paretovariate(0.8))}" if g == "hot" else f"m{rng.randrange(400)}" if g == "flat" else rng.choice(["a", None])
        out.append((g, rng.choice(["f", None]), m))
    return out


@pytest.mark.parametrize("counters,held", [(1000, 1 << 20), (20, 1 << 20), (3, 1 << 20), (20, 25)])
def test_equals_counting_all(spark, counters, held):
    """With room for all items, with too few counters, and with summaries handed on early."""
    data = rows(counters)
    df = spark.createDataFrame(data, "g string, f string, m string").repartition(5)
    got = toplists.top_items(df, ["g"], ["f", "m"], 5, counters, held)
    assert got.columns == ["g", "f", "m", "n", "rank"]
    assert {tuple(r) for r in got.collect()} == brute(data, 5)


def test_no_group_no_rows(spark):
    df = spark.createDataFrame(rows(1, 200), "g string, f string, m string")
    assert toplists.top_items(df, [], ["m"], 3).count() == 3
    assert toplists.top_items(df.limit(0), ["g"], ["m"], 3).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 12)), st.integers(1, 4))
def test_summary_bounds(items, counters):
    s = toplists.Summary(counters)
    for i in items:
        s.add(i, 1)
        assert len(s.low) <= 2 * counters
    for i, n in Counter(items).items():
        assert s.low.get(i, 0) <= n <= s.low.get(i, 0) + s.lost
    assert s.lost * (counters + 1) <= len(items)
