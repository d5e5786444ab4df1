import hashlib
import random
import zlib

import pytest

from newsmill.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
AFTER = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        case = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if case == 1:
            text = ""
        if case == 2:
            text = "".join(c for c in text if c not in ".!?")
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return out


def plain(rows):
    """Result for the damaged rows of one conversation: from the last row backwards, the
    cheapest and then least edit string for every state, kept whole."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        sign = text.strip(WHITE)[-1:]
        faults.append("blank" if not sign else "duplicate" if (role, text) in seen else "truncated" if sign not in ".!?" else None)
        seen.add((role, text))
    name = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(4):
            for s, nexts in AFTER.items():
                for t in nexts:
                    if t != "s" and t in best:
                        cost, edits, lines = best[t]
                        new = (cost + 2, "I" + edits, (f"{name[t]}:", lines))
                        if s not in best or new[:2] < best[s][:2]:
                            best[s] = new
        return best

    best = with_inserts({"": (0, "", None), "a": (0, "", None)})
    for (_, _, role, text), fault in reversed(list(zip(rows, faults))):
        before = {}
        for s, nexts in AFTER.items():
            options = []
            if s in best:
                cost, edits, lines = best[s]
                options.append((cost + 3, "D" + edits, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for t in nexts:
                    if t in best and role[:1] == t:
                        options.append((best[t][0] + more, "K" + best[t][1], (f"{role}:{text}", best[t][2])))
                    if t in best and t != "s":
                        options.append((best[t][0] + 2 + more, "R" + best[t][1], (f"{name[t]}:{text}", best[t][2])))
            if options:
                before[s] = min(options, key=lambda o: o[:2])
        best = with_inserts(before)
    cost, edits, chain = best[""]
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    left = damage(rows)
    return sorted(((c, *plain([r for r in left if r[0] == c])) for c in {r[0] for r in rows}), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(seed, n=250):
    rnd = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "USER", "", None, "unit", "a"]
    texts = ["Yes.", "No!", "why?", "cut", "cut \n", "Ends. ", "", " \t", None, "Ü?", "long text. and more", "é"]
    rows = []
    for c in range(n):
        rich = rnd.random() < 0.5
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 14])):
            turn = rnd.choice([t, t, t, t, t + 3, None, t // 2])
            text = rnd.choice(texts) if rich else f"{c} {t}{rnd.choice(['.', '.', '!', '', ' '])}"
            rows.append((c, turn, rnd.choice(roles[:5] if not rich else roles), text))
    rows += [(None, t, r, x) for t, r, x in [(0, "user", "a."), (1, "assistant", "b."), (1, "assistant", "b."), (None, None, None)]]
    return rows + [(10**12, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(30)] + [(-5, 2**60, "user", "x."), (-5, -(2**60), "system", "y.")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(table, seed):
    rows = corpus(seed)
    assert found(C.conversation_repair(table(rows, schema=SCHEMA))) == brute(rows)


def test_state_is_carried_and_spilled(spark, table, monkeypatch):
    """Giant conversations over many Arrow batches, with back-pointers in files."""
    rnd = random.Random(9)
    roles = ["user", "assistant", "user", "system"]
    rows = [(c, t, rnd.choice(roles[: 2 + c]), f"{rnd.randrange(900)}" + rnd.choice(".!?  ")) for c in range(3) for t in range(3000)]
    monkeypatch.setattr(C, "HELD", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert found(C.conversation_repair(table(rows, schema=SCHEMA))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pointers_come_back_from_the_file(tmp_path):
    pointers = C.Pointers(f"file://{tmp_path}/spill", 7)
    for value in range(40):
        pointers.add(value * 99991)
    assert len(list((tmp_path / "spill").iterdir())) == 1
    assert [v for chunk in pointers.backwards() for v in chunk] == [value * 99991 for value in reversed(range(40))]
    assert not list((tmp_path / "spill").iterdir())


def test_number_of_steps_is_bounded():
    steps, rnd, at = C.Steps(), random.Random(3), 0
    for _ in range(200_000):
        at = steps.step(at, (rnd.choice("suat"), rnd.random() < 0.2, rnd.random() < 0.3))[0]
    assert len(steps.states) < 3000 and len(steps.table) < 255


def test_long_text_ties_and_empty_tables(table):
    rows = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y " * 100_000 + "."), (1, 1, "assistant", "b."), (1, 1, "assistant", "b.")]
    assert found(C.conversation_repair(table(rows, schema=SCHEMA))) == brute(rows)
    assert C.conversation_repair(table([], schema=SCHEMA)).count() == 0


def test_conversation_without_rows(table):
    gone = next((c, t) for c in range(1000) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*gone, "user", "hello."), (*gone, "user", "hello.")]
    assert found(C.conversation_repair(table(rows, schema=SCHEMA))) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert found(C.conversation_repair(rows)) == brute([tuple(r) for r in rows.collect()])
