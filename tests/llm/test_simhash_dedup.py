import random
import re

import pytest
import xxhash

from newsmill.llm import simhash_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, radius=3):
    """Smallest id reachable over marks (id, fingerprint) that differ in few bits."""
    root = list(range(len(marks)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(marks):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(marks))]


def brute(rows):
    marks = [(i, plain_fingerprint(t)) for i, t in rows]
    return sorted(((i, f"{f:016x}", c) for (i, f), c in zip(marks, plain_components(marks))), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: " ".join("".join(rnd.choice("abÉcdé") for _ in range(rnd.randint(1, 5))) for _ in range(n))
    base = text(400).split()

    def edited(k):
        w = list(base)
        for _ in range(k):
            w[rnd.randrange(len(w))] = text(1)
        return " \n".join(w)

    rows = [(i, text(rnd.randint(0, 40))) for i in range(150)]
    rows += [(500 + i, edited(rnd.randint(0, 6))) for i in range(150)]
    rows += [(900 + i, rows[i][1].upper()) for i in range(40)]
    odd = [None, "", " \t\n", "a", "A b", "a  b", "a b c", "ÄB c D e", "x " * 5000]
    return rows + [(1000 + i, t) for i, t in enumerate(odd)] + [(1003, "a"), (1003, "a"), (None, "a b c"), (None, "lone text here now")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(table, seed):
    rows = corpus(seed)
    assert found(S.simhash_dedup(table(rows))) == brute(rows)


@pytest.mark.parametrize("small", [2, 20])
def test_divided_cells(spark, monkeypatch, small):
    """Fingerprints in a ball, so that cells stay large level after level."""
    monkeypatch.setattr(S, "CELL", small)
    rnd = random.Random(4)
    centre, marks = [rnd.getrandbits(64) for _ in range(3)], set()
    for _ in range(400):
        f = rnd.choice(centre)
        for _ in range(rnd.choice([1, 2, 4, 5, 6, 7])):
            f ^= 1 << rnd.randrange(64)
        marks.add(f)
    marks = sorted(marks)
    links = S.fingerprint_links(spark.createDataFrame([(S.signed(f),) for f in marks], "f long")).collect()
    assert all(((r.x ^ r.y) & (2**64 - 1)).bit_count() <= 3 for r in links)
    want = plain_components(list(enumerate(marks)))
    at, root = {S.signed(f): k for k, f in enumerate(marks)}, list(range(len(marks)))
    for r in links:
        a, b = root[at[r.x]], root[at[r.y]]
        root = [min(a, b) if k in (a, b) else k for k in root]
    assert root == want


def test_links_do_not_grow_with_pairs(spark):
    """A dense cell returns fewer links than it has members."""
    marks = [(x,) for x in range(256)]
    per_cell = S.fingerprint_links(spark.createDataFrame(marks, "f long")).count()
    assert 255 <= per_cell <= 255 * (S.RADIUS + 1)


def test_long_text(table):
    words = [f"w{i * i % 7919}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:100_000] + ["x"] + words[100_000:])), (3, "w" * 300_000)]
    assert found(S.simhash_dedup(table(rows))) == brute(rows)


def test_empty_table(table):
    out = S.simhash_dedup(table([]))
    assert out.count() == 0 and out.columns == ["doc_id", "fingerprint", "component_id"]


def test_other_columns_and_null_type(spark):
    df = spark.sql("SELECT CAST(7 AS INT) doc_id, CAST(NULL AS STRING) text, 'z' f, 'z' fingerprint, 'z' component_id, 1 root, 1 cell")
    assert found(S.simhash_dedup(df)) == [(7, "0" * 16, 7)]


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(S.simhash_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
