"""Token ids of byte-level BPE, many texts at a time.

The tokenizer's own split of a text into pieces (contractions, letters, numbers,
other signs with one leading space, white space) is done on arrays; every different
piece goes through the tokenizers library once and is remembered, up to a bound.
"""

import os
import unicodedata
import zlib
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from newsmill.llm import arrays as A

# categories of a code point; what ends a text is none of them
OTHER, LETTER, NUMBER, SPACE, END = range(5)
# the white space of Unicode, which differs from str.isspace
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values of the vocabulary's split pattern
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
# and its sign for each byte: printable ones stand for themselves, the others from 256 on
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - PRINTABLE))}
MEMO = 1 << 20
_kinds = None


def kinds():
    global _kinds
    if _kinds is None:
        _kinds = np.zeros(0x110000, np.uint8)
        first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        first = np.array(first)
        _kinds[first == "L"], _kinds[first == "N"] = LETTER, NUMBER
        _kinds[WHITE] = SPACE
    return _kinds


def piece_starts(codes, ends):
    """Where the pieces of texts start; ``ends`` marks the sign after each text."""
    c = kinds()[codes]
    c[ends] = END
    before = np.concatenate(([END], c[:-1]))
    after = np.concatenate((c[1:], [END]))
    blank = np.concatenate(([False], (codes[:-1] == 0x20) & (c[:-1] == SPACE)))
    # the last blank of a run goes with what follows; another white space stands alone
    start = (before != c) & ~(blank & (c != END))
    start |= (c == SPACE) & (before == SPACE) & (after != SPACE) & (after != END)
    for text in CONTRACTIONS:
        at = np.flatnonzero(start & (codes == 0x27) & (c == OTHER))
        at = at[at + len(text) < len(codes)]
        for j, sign in enumerate(text[1:], 1):
            at = at[(codes[at + j] == ord(sign)) & (c[at + j] == LETTER)]
        start[at + 1] = False
        rest = at + len(text)
        start[rest[c[rest] == LETTER]] = True
    return np.flatnonzero(start), c


class Encoder:
    """ids of texts; one per worker."""

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.codes = A._seeded.integers(1, 2**63, 1 << 16, dtype=np.uint64) * A.U(2) + A.U(1)
        self.forget()

    def forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _places(self, keys):
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at

    def _learn(self, keys, checks, pieces):
        if len(self.keys) + len(keys) > MEMO:
            return False
        # the pieces are split already, so the vocabulary's merges are all that is left
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(p.encode().decode("latin-1").translate(BYTE_SIGNS))] for p in pieces]
        count = np.array([len(x) for x in found], np.int64)
        first = np.cumsum(count) - count + len(self.pool)
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum()))))
        # new keys come in order, so the remembered ones stay so without a sort
        at = np.searchsorted(self.keys, keys)
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        return True

    def encode(self, texts):
        """(offsets, ids) of some megabytes of texts."""
        odd = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            offs, ids = self.encode([t if k not in set(odd) else "" for k, t in enumerate(texts)])
            parts = [ids[offs[k] : offs[k + 1]] for k in range(len(texts))]
            for k in odd:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts)
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts, kind = piece_starts(codes, ends)
        stops = np.append(starts[1:], len(codes))
        real = kind[starts] != END
        starts, stops = starts[real], stops[real]
        row = np.searchsorted(ends, starts, "right")
        if not len(starts):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        value = self.codes[codes & 0xFFFF] + (codes >> 16).astype(np.uint64)
        value[ends] = 0
        pad = np.concatenate(([0], starts))
        pos = np.arange(len(codes)) - np.repeat(pad, np.diff(np.append(pad, len(codes))))
        longest = int(pos.max()) + 1
        keys = A.mix(np.add.reduceat(value * A.powers(longest)[pos], starts) + (stops - starts).astype(np.uint64))
        checks = np.add.reduceat((value ^ (value >> A.U(31))) * A.powers(longest, A.FOLDS[1])[pos], starts)
        if len(self.keys) > MEMO // 2:
            self.forget()
        at = self._places(keys)
        missed = np.ones(len(keys), bool) if not len(self.keys) else (self.keys[at] != keys)
        if missed.any():
            new, where = np.unique(keys[missed], return_index=True)
            where = np.flatnonzero(missed)[where]
            if not self._learn(new, checks[where], [joined[i:j] for i, j in zip(starts[where].tolist(), stops[where].tolist())]):
                half = len(texts) // 2
                if not half:
                    ids = np.array(self.tokenizer.encode(texts[0], add_special_tokens=False).ids, np.uint32)
                    return np.array([0, len(ids)]), ids
                self.forget()
                a, b = self.encode(texts[:half]), self.encode(texts[half:])
                return np.concatenate((a[0], b[0][1:] + a[0][-1])), np.concatenate((a[1], b[1]))
            at = self._places(keys)
        if (self.checks[at] != checks).any():
            found = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
            return np.concatenate(([0], np.cumsum([len(x) for x in found]))), np.array([i for x in found for i in x], np.uint32)
        count = self.count[at]
        total = np.cumsum(count)
        src = np.repeat(self.first[at] - (total - count), count) + np.arange(int(total[-1]))
        ids = self.pool[src]
        upto = np.concatenate(([0], total))
        offs = upto[np.searchsorted(row, np.arange(len(texts) + 1))]
        return offs, ids


_encoders = {}


def encoder(path):
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_groups(column, limit=1 << 20):
    """(first row, texts) of about ``limit`` characters; null counts as empty."""
    texts = [t or "" for t in column.to_pylist()]
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (n == 0 or n + len(texts[j]) <= limit):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def crc(ids):
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
