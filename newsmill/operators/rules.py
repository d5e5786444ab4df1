"""Link rules kept in a table: literals by an automaton, patterns only on its hits.

A rule table has ``rule`` (its name), ``kind`` ('skip' or 'accept') and ``pattern``, searched
anywhere in a URL without regard to ASCII case. A rule whose pattern needs a certain piece
of text is tried only on URLs that hold the piece; one automaton finds the pieces of all
rules in a single pass over a URL, so its time does not grow with the number of rules.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
RULES, CHARS = 100_000, 16 << 20  # of one automaton


def fold(text):
    return text.translate(ASCII_LOWER)


def required_piece(pattern):
    """(longest text that every match holds, whether the pattern is nothing else).

    Only characters outside classes, groups, choices and repeats count; a pattern with a
    group, a choice or an inline flag is not looked into and has the empty piece.
    """
    if re.search(r"(?<!\\)(?:\\\\)*[(|]", pattern):
        return "", False
    pieces, at, plain = [""], 0, True
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            pieces[-1] += pattern[at + 1]
            at += 2
            continue
        if c not in "\\[]{}*+?.^$":
            pieces[-1] += c
            at += 1
            continue
        plain = False
        if c in "*?{":  # what stands before may be missing
            pieces[-1] = pieces[-1][:-1]
        pieces.append("")
        if c == "[":
            close = pattern.find("]", at + 3 if pattern[at + 1 : at + 2] == "^" else at + 2)
            # an escape in a class could hide its end
            if close < 0 or "\\" in pattern[at:close] and pattern[close - 1] == "\\":
                return "", False
            at = close + 1
        elif c == "{":
            close = pattern.find("}", at)
            at = len(pattern) if close < 0 else close + 1
        elif c == "\\":
            if pattern[at + 1 : at + 2] not in tuple("dDwWsSbB"):
                return "", False
            at += 2
        else:
            at += 1
    return fold(max(pieces, key=len)), plain


class RuleSet:
    """Rules of one kind: the least rule that matches a URL."""

    def __init__(self, rules):
        self.machine, self.always, self.patterns, by_piece = ahocorasick.Automaton(), [], {}, {}
        for rule, pattern in rules:
            piece, plain = required_piece(pattern)
            if not plain:
                self.patterns[rule, pattern] = None
            (by_piece.setdefault(piece, []) if piece else self.always).append((rule, pattern))
        for piece, held in by_piece.items():
            self.machine.add_word(piece, held)
        self.filled = bool(by_piece)
        if self.filled:
            self.machine.make_automaton()

    def search(self, rule, url):
        if rule not in self.patterns:
            return True  # the piece is the rule
        if self.patterns[rule] is None:
            self.patterns[rule] = re.compile(rule[1], re.ASCII | re.IGNORECASE)
        return self.patterns[rule].search(url) is not None

    def first(self, url):
        found = set(self.always)
        if self.filled:
            for _, held in self.machine.iter(fold(url)):
                found.update(held)
        return next((rule[0] for rule in sorted(found) if self.search(rule, url)), None)


def _tried(rules, n):
    """Arrow pass over (n kept columns, url, skip_rule, accept_rule)."""

    def run(batches):
        sets = None
        for batch in batches:
            sets = sets or [RuleSet([r[1:] for r in rules if r[0] == kind]) for kind in ("skip", "accept")]
            urls, memory = batch.column(n).to_pylist(), {}
            for u in set(urls) - {None}:
                memory[u] = [s.first(u) for s in sets]
            columns = list(batch.columns)
            for i, at in enumerate((n + 1, n + 2)):
                before = columns[at].to_pylist()
                now = [memory.get(u, (None, None))[i] for u in urls]
                columns[at] = pa.array([min((x for x in pair if x is not None), default=None) for pair in zip(before, now)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def rule_chunks(rules, limit=RULES, chars=CHARS):
    """The rule table in lists of bounded size, each row once; one list as a rule."""
    clean = rules.where("kind IN ('skip', 'accept') AND pattern != '' AND rule IS NOT NULL").select("kind", "rule", "pattern").distinct()
    n, size = clean.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("rule") + F.length("pattern")), F.lit(0))).first()
    parts = max(1, -(-2 * n // limit), -(-2 * size // chars)) if n > limit or size > chars else 1
    if parts == 1:
        yield [tuple(r) for r in clean.collect()]
        return
    part = F.pmod(F.xxhash64("kind", "rule", "pattern"), F.lit(parts))
    for k in range(parts):
        yield [tuple(r) for r in clean.where(part == k).collect()]


def link_rules(df, rules, url="url", keep=("page_id",), limit=RULES):
    """(keep..., url, skip_rule, accept_rule): the least rule of each kind that matches.

    The size of the rule table is counted first. Up to ``limit`` rules go to the workers as
    one list; a larger table is dealt into several, and the links pass one automaton after
    another, so no worker holds more than one list's share and no rule is left out. A null
    URL matches nothing; rules without a name, a pattern or a known kind are not tried.
    ``$`` is a pattern's end or a last line feed.
    """
    blank = F.lit(None).cast("string")
    out = df.select(*keep, F.col(url).alias("url"), blank.alias("skip_rule"), blank.alias("accept_rule"))
    for chunk in rule_chunks(rules, limit):
        out = out.mapInArrow(_tried(chunk, len(keep)), out.schema)
    return out


def link_filter_by_table(df, rules, url="url", keep=("page_id",)):
    """Links that no skip rule and at least one accept rule of a table matches."""
    return link_rules(df, rules, url, keep).where("skip_rule IS NULL AND accept_rule IS NOT NULL").select(*keep, "url")
