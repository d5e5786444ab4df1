import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from newsmill.llm import packing, token_files
from newsmill.llm.tokens import crc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def encoded(text, end):
    return LIB.encode(text or "", add_special_tokens=False).ids + [end]


def check_files(df, rows):
    start = 0
    got = sorted(map(tuple, df.collect()), key=lambda r: r[1])
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(rows)
    for (doc_id, at, n, check), (i, text) in zip(got, rows):
        ids = encoded(text, 2)
        assert (doc_id, at, n, check) == (i, start, len(ids), crc(np.array(ids)))
        start += n


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    check_files(token_files.token_files(docs, PATH, partitions=3), [(r.doc_id, r.text) for r in docs.collect()])


EDGE = [(3, "a b"), (3, "a b"), (1, None), (None, "x"), (2, ""), (9, "word " * 90000), (-5, "<|endoftext|> it's")]


def test_edges(table):
    check_files(token_files.token_files(table(EDGE), PATH, partitions=4), EDGE)
    assert token_files.token_files(table([]), PATH, partitions=2).count() == 0


def test_random_access_reads_few_frames(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} " * 40000) for i in range(4)], "doc_id long, text string")
    part = token_files.write_tokens(df, PATH, folder=f"file://{tmp_path}/t", partitions=1).first()
    file = token_files.Reader(part.path)
    seen, frame = [], file.frame
    file.frame = lambda k: seen.append(k) or frame(k)
    assert file.ids(2).tolist() == encoded("text 2 " * 40000, 2)
    assert 0 not in seen and len(file.upto) - 2 not in seen
    import zstandard

    raw = open(part.path.removeprefix("file://"), "rb").read()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as r:
        assert np.frombuffer(r.read(), "<u2").tolist() == sum((encoded(f"text {i} " * 40000, 2) for i in range(4)), [])


def check_packing(df, rows, capacity):
    got = [r.asDict() for r in df.collect()]
    want = []
    for i, text in rows:
        ids = np.array(encoded(text, 0))
        at = 0
        for j, n in enumerate(packing.cut(len(ids), capacity)):
            want.append((i, j, at, n, crc(ids[at : at + n])))
            at += n
    key = lambda r: (repr(r[0]), *r[1:])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), sum(r["length"] for r in got)


def test_packing(spark, table, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, total = check_packing(packing.best_fit_packing(docs, PATH), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= total / 2048 * 1.03 + 1
    check_packing(packing.best_fit_packing(table(EDGE), PATH, capacity=64), EDGE, 64)
    assert packing.best_fit_packing(table([]), PATH).count() == 0


def best_fit_decreasing(counts, capacity):
    room = []
    import bisect

    for x in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        k = bisect.bisect_left(room, x)
        left = (room.pop(k) if k < len(room) else capacity) - x
        bisect.insort(room, left)
    return len(room)


def test_plan_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for draw in (rng.integers(1, 2048, 5000), rng.integers(600, 1500, 4000), np.minimum(rng.lognormal(5.5, 1.2, 8000).astype(int) + 1, 2047), rng.integers(680, 700, 3000), np.full(1000, 700)):
        counts = dict(zip(*np.unique(draw, return_counts=True)))
        counts = {int(k): int(v) for k, v in counts.items()}
        plan = packing.pack_lengths(counts, 2048)
        assert not any(plan.left.values())

        assert plan.sequences <= best_fit_decreasing(counts, 2048) * 1.02 + 1
