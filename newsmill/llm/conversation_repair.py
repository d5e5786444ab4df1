"""Repair of conversations by the cheapest edits, in one pass over their sorted rows.

Rows are dealt by conversation and sorted by turn inside the partitions, by Spark, so a
giant conversation is sorted on disk. ``mapInArrow`` (``mapInPandas`` without the copy,
which would turn turns with nulls into doubles) then reads a stream: a conversation may
begin in one Arrow batch and end in another, and what is carried across is one small state.

The wanted roles are ``(s?(ua)+)?``: an automaton with the states empty, s, u and a. Per
state the pass carries the least cost of edits that lead there, the order of the edit
strings among states (for ties), and the hash of the repaired text so far. The step from
row to row depends on the costs' differences, the order and the kind of row only, so each
different step is worked out once and remembered. A step's choices go into four bytes of
back-pointers; beyond ``HELD`` rows of one conversation they are written to the shared
folder, and read backwards when its edit string is put together. So memory is bounded for
any conversation, but for the edit string itself, which is a cell of the result.

The repaired text's digest is a chain over all rows of a conversation; that is why a
conversation is one task's stream and is not split.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.session import run_dir

SPACE = r"\x20\x09-\x0D"
HELD = 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def inserted(state):
    """(state, inserts) after 0, 1 or 2 inserted turns; a third never pays."""
    out = [(state, [])]
    for _ in range(2):
        out.append((NEXT[out[-1][0]], [*out[-1][1], NEXT[out[-1][0]]]))
    return out


def moves(kind):
    """Ways over a row: (state, state after, cost, edits, inserted roles, role of the row).
    The kind is the row's role initial, whether it must go and whether it is truncated; the role is None where the
    row is deleted and '' where it keeps its own."""
    initial, must_go, cut = kind
    out = []
    for state in FOLLOWS:
        for at, roles in inserted(state):
            cost, edits = INSERT * len(roles), "I" * len(roles)
            out.append((state, at, cost + DELETE, edits + "D", roles, None))
            if must_go:
                continue
            if initial in FOLLOWS[at]:
                out.append((state, FOLLOWS[at][initial], cost + TRUNCATED * cut, edits + "K", roles, ""))
            out.append((state, NEXT[at], cost + REROLE + TRUNCATED * cut, edits + "R", roles, ROLE[NEXT[at]]))
    return out


class Steps:
    """The automaton of steps: a state is (cost above the least, rank) per role state, None
    where unreachable; remembered with the choices they make."""

    START = ((0, 0), None, None, None)

    def __init__(self):
        self.known, self.moves, self.numbers, self.states = {}, {}, {self.START: 0}, [self.START]
        self.table, self.index = [], {}

    def number(self, move):
        """Back-pointer of a move: its place in the table of all that were used."""
        key = (move[0], move[3], tuple(move[4]), move[5])
        if key not in self.index:
            self.index[key] = len(self.table)
            self.table.append((move[0], move[3]))
        return self.index[key]

    def step(self, at, kind):
        """(state, cost added, back-pointers, [(state, inserted roles, role)])."""
        key = (at, kind)
        if key not in self.known:
            self.known[key] = self._step(at, kind)
        return self.known[key]

    def _step(self, at, kind):
        if kind not in self.moves:
            self.moves[kind] = moves(kind)
        state, best = self.states[at], [None] * 4
        for move in self.moves[kind]:
            if state[move[0]] is None:
                continue
            cost, rank = state[move[0]]
            value = (cost + move[2], rank, move[3], move)
            if best[move[1]] is None or value[:3] < best[move[1]][:3]:
                best[move[1]] = value
        least = min(b[0] for b in best if b)
        # a state this far above is never on a cheapest path: two inserts and a deletion
        # more make up for any state, only the empty start and s have more to offer
        bound = least + 2 * INSERT + DELETE + TRUNCATED
        best = [b if b and b[0] <= bound else None for b in best]
        order = sorted((b[1:3], t) for t, b in enumerate(best) if b)
        rank = {t: r for r, (_, t) in enumerate(order)}
        after = tuple((b[0] - least, rank[t]) if b else None for t, b in enumerate(best))
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        pointers = sum((self.number(b[3]) if b else 255) << (8 * t) for t, b in enumerate(best))
        return self.numbers[after], least, pointers, [(b[3][0], b[3][4], b[3][5]) if b else None for b in best]

    def finish(self, at):
        """(state, cost, edits, inserted roles) of the best end."""
        ends = []
        for s, held in enumerate(self.states[at]):
            if held:
                for end, roles in inserted(s):
                    if end in (EMPTY, ASSISTANT):
                        ends.append((held[0] + INSERT * len(roles), held[1], "I" * len(roles), s, roles))
        cost, _, edits, state, roles = min(ends, key=lambda e: e[:3])
        return state, cost, edits, roles


class Pointers:
    """Back-pointers of one conversation; beyond ``most`` rows they are in a file."""

    def __init__(self, folder, most):
        self.folder, self.most, self.held, self.sizes, self.path, self.sink = folder, most, [], [], None, None

    def add(self, value):
        self.held.append(value)
        if len(self.held) >= self.most:
            if self.sink is None:
                self.where, base = pa.fs.FileSystem.from_uri(self.folder)
                self.where.create_dir(base, recursive=True)
                self.path = f"{base}/{uuid.uuid4().hex}"
                self.sink = self.where.open_output_stream(self.path, compression=None)
            self.sink.write(np.array(self.held, "<u4").tobytes())
            self.sizes.append(len(self.held))
            self.held = []

    def backwards(self):
        """Chunks of back-pointers, the last first."""
        yield self.held[::-1]
        if self.sink is not None:
            self.sink.close()
            with self.where.open_input_file(self.path) as file:
                end = 4 * sum(self.sizes)
                for n in reversed(self.sizes):
                    end -= 4 * n
                    yield np.frombuffer(file.read_at(4 * n, end), "<u4")[::-1].tolist()
            self.where.delete_file(self.path)


class Conversation:
    """What is carried along one conversation."""

    def __init__(self, steps, folder, most):
        self.steps, self.at, self.cost = steps, 0, 0
        self.pointers = Pointers(folder, most)
        self.digests = [hashlib.sha256(), None, None, None]
        self.faults, self.illegal = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
        self.low = self.high = self.turn = None
        self.turns, self.last = 0, None

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if self.last is not None and self.last[0][:1] + initial not in LEGAL:
            self.illegal += 1
        if fault != "blank" and self.last == (role, text, turn):
            fault = "duplicate"  # equal rows of one turn stand side by side
        self.last = (role, text, turn)
        if turn is not None and turn != self.turn:
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
            self.turns += 1
        if fault:
            self.faults[fault] += 1
        self.at, least, pointers, ways = self.steps.step(self.at, (initial, fault in ("blank", "duplicate"), fault == "truncated"))
        self.cost += least
        self.pointers.add(pointers)
        self.write(ways, role, text)

    def write(self, ways, role, text):
        left = [0] * 4
        for way in ways:
            if way:
                left[way[0]] += 1
        after = [None] * 4
        for t, way in enumerate(ways):
            if not way:
                continue
            s, inserts, named = way
            left[s] -= 1
            digest = self.digests[s] if not left[s] else self.digests[s].copy()
            lines = [f"{ROLE[r]}:" for r in inserts]
            if named is not None:
                lines.append(f"{named or role}:{text}")
            if lines:
                digest.update(("\n" * (s != EMPTY) + "\n".join(lines)).encode("utf-8", "surrogatepass"))
            after[t] = digest
        self.digests = after

    def result(self):
        state, cost, edits, roles = self.steps.finish(self.at)
        digest = self.digests[state]
        if roles:
            digest.update(("\n" * (state != EMPTY) + "\n".join(f"{ROLE[r]}:" for r in roles)).encode())
        parts, table = [edits[::-1]], self.steps.table
        for chunk in self.pointers.backwards():
            out = []
            for value in chunk:
                state, way = table[value >> (8 * state) & 255]
                out.append(way[::-1])
            parts.append("".join(out))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost + cost, "".join(parts)[::-1], digest.hexdigest())


def repair_rows(schema, folder, most, limit=4 << 20):
    """One row per conversation; the input is sorted by conversation and turn."""

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], names=schema.names)

    def run(batches):
        steps, now, conversation, out, size = Steps(), None, None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for conv_id, turn, role, text, fault in zip(*columns):
                if conversation is None or conv_id != now:
                    if conversation is not None:
                        out.append((now, *conversation.result()))
                        size += len(out[-1][-2]) + 100
                        if size > limit:
                            yield packed(out)
                            out, size = [], 0
                    now, conversation = conv_id, Conversation(steps, folder, most)
                if text is not None:
                    conversation.add(turn, role, text, fault)
        if conversation is not None:
            out.append((now, *conversation.result()))
        if out:
            yield packed(out)

    return run


def damaged(conversations):
    """The rows after damage; role and text are null in one row that stands for the
    conversation itself, whatever is dropped."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    role = F.when(case == 4, "user").otherwise(space("role"))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(case == 0, 0).when(case == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repair(rows):
    """Cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, copies):
    rows stand ``copies`` times in a row; a conversation all of whose rows have 0 copies
    is empty. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256. Rows go by turn, nulls first, then role and text."""
    spark = A.ready(rows.sparkSession)
    kept = F.col("copies") > 0
    rows = rows.withColumns({c: F.when(kept, F.col(c)) for c in ("turn", "role", "text")})
    rows = rows.withColumn("text", F.when(kept, F.coalesce("text", F.lit(" ")))).withColumn("role", F.when(kept, F.coalesce("role", F.lit(" "))))
    rows = rows.repartition("conv_id")
    # the first of equal role and text; one exchange serves this and the stream
    first = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    rows = rows.withColumn("nth", first)
    sign = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    fault = F.when(sign == "", "blank").when(F.col("nth") > 1, "duplicate").when(~sign.rlike("[.!?]"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "nth", fault.alias("fault"), F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1)))).alias("c")).drop("c")
    rows = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"), "nth")
    kind = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}"
    schema = pa.schema([("conv_id", arrow_type(spark, kind)), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return rows.mapInArrow(repair_rows(schema, run_dir(spark, "back-pointers"), HELD), kind)


def arrow_type(spark, kind):
    return spark.createDataFrame([], kind).toArrow().schema.field(0).type


def conversation_repair(conversations):
    """Damage the rows of ``conversations`` (conv_id, turn, role, text) by the fixed rule
    and repair them; one row per original conv_id, see ``repair``.

    Null ids form one conversation, null turns come first, null role or text is one
    space; rows of one turn go by role, then text. A role whose initial is not s, u or a
    cannot be kept. A conversation without rows after damage has zeros, no edits and the
    digest of the empty text. Other columns are ignored; an empty table gives none.
    """
    return repair(damaged(conversations))
