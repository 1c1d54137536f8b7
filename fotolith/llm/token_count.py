"""Token counts of byte-level BPE by compiled transducers.

The splitting pattern of the tokenizer is a deterministic transducer over classes of characters; each transition tells whether the character
read, or the one before it, begins a piece. Chunks of text are maps from states to states; they compose by a parallel prefix scan, which
gives every chunk its first state, and one more run from there gives the pieces. Each distinct piece is compiled once, by applying
the merges to all new pieces at once, to a transition annotated with the number of tokens that it emits.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scratch import bounded_batches
from .words import Words, pieces, text_buffer

PIECE_BYTES = 2 << 20
#: Distinct pieces that a task keeps compiled; beyond, it starts anew.
KEPT = 1 << 20
#: Longer pieces are merged one by one, with a heap.
LONG = 256

# The splitting pattern of the tokenizer,
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
# and the code points of \s.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, END = range(7)
#: Letters of contractions have classes of their own: those that end one at once, then first and second letters.
QUICK = 7
OWN = {c: QUICK + i for i, c in enumerate(["", *sorted({x[0] for x in CONTRACTIONS if len(x) == 2} | {x[1] for x in CONTRACTIONS if len(x) == 2})]) if c}
CLASSES = QUICK + 1 + len(OWN)


def _kind(c: int) -> int:
    return LETTER if c >= QUICK else c


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state by state and class, and what begins: 1 the character read, 2 the one before."""
    pairs = {x for x in CONTRACTIONS if len(x) == 2}
    names = {i: c for c, i in OWN.items()}
    # A state: ('start',), ('run', kind), ('white', is a space, is held back), ('quote',), ('after', first letter) or ('done',).
    states, table = [("start",)], []
    for state in states:
        row = []
        for c in range(CLASSES):
            kind, begins, before = _kind(c), 1, 0
            if state[0] == "after" and (c not in names or state[1] + names[c] not in pairs):
                before, state_ = 2, ("run", LETTER)
            else:
                state_ = state
            if kind == END:
                to, begins = ("start",), 0
            elif kind in (SPACE, WHITE):
                held = state_[0] == "white"
                to, begins = ("white", kind == SPACE, held), 0 if held else 1
            elif state_[0] == "after":
                to, begins = ("done",), 0
            elif state_[0] == "quote" and c == QUICK:
                to, begins = ("done",), 0
            elif state_[0] == "quote" and c in names and any(p[0] == names[c] for p in pairs):
                to, begins = ("after", names[c]), 0
            elif state_[0] == "quote" and kind in (OTHER, QUOTE):
                to, begins = ("run", OTHER), 0
            elif state_[0] == "white" and state_[1]:
                to, begins, before = ("run", OTHER if kind == QUOTE else kind), 0, 2 * state_[2]
            elif state_[0] == "run" and state_[1] == (OTHER if kind == QUOTE else kind):
                to, begins = state_, 0
            else:
                to, before = ("quote",) if kind == QUOTE else ("run", kind), before or 2 * (state_[0] == "white" and state_[2])
            if to not in states:
                states.append(to)
            row.append((states.index(to), begins | before))
        table.append(row)
    table = np.array(table)
    return table[:, :, 0].astype(np.uint8), table[:, :, 1].astype(np.uint8)


NEXT, BEGINS = _compile()
STATES = len(NEXT)


def _triples() -> np.ndarray:
    """Next state by state and three classes, for the maps."""
    two = NEXT[NEXT]  # state, class, class
    return NEXT[two].reshape(-1)


TRIPLES = _triples()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        out = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                out[c] = LETTER if k == "L" else NUMBER
        out[SPACES] = WHITE
        out[0x20], out[0x27] = SPACE, QUOTE
        for x in CONTRACTIONS:
            if len(x) == 1:
                out[ord(x)] = QUICK
        for x, c in OWN.items():
            out[ord(x)] = c
        _classes.append(out)
    return _classes[0]


CHUNK = 96


def begins(symbols: np.ndarray) -> np.ndarray:
    """Where pieces begin in a string of classes that starts after an END."""
    n = len(symbols)
    count = -(-n // CHUNK)
    padded = np.full(count * CHUNK, END, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(count, CHUNK).T).astype(np.int32)
    # The map of each chunk, from all states at once.
    code = (grid[0::3] * CLASSES + grid[1::3]) * CLASSES + grid[2::3]
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], count, 1)
    for row in code:
        maps = TRIPLES.take(maps * np.int32(CLASSES**3) + row)
    # Prefix scan by composition of doubling runs of chunks.
    step, lane = 1, np.arange(count)
    while step < count:
        maps[:, step:] = maps[:, step:][maps[:, :-step], lane[: count - step]]
        step *= 2
    state = np.zeros(count, np.uint8)
    state[1:] = maps[0, :-1]
    flags = np.empty((CHUNK, count), np.uint8)
    for i, row in enumerate(grid):
        at = state * np.int32(CLASSES) + row
        flags[i] = BEGINS.reshape(-1).take(at)
        state = NEXT.reshape(-1).take(at)
    flags = flags.T.reshape(-1)[:n]
    out = (flags & 1).astype(bool)
    out[:-1] |= flags[1:] >= 2
    return out


class Merges:
    """The merges of a byte-level BPE: a table from pairs of tokens to rank and merged token, and the token of each byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right, new = (np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.rank, self.new = key[order], order.astype(np.int64), new[order]
        # Byte-level vocabularies write a printable byte as itself and the others, in order, as the characters from U+0100 on.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(0x100, 0x200))
        self.byte = np.array([vocab[chr(b) if b in printable else chr(next(spare))] for b in range(256)], np.int64)
        self.special = [t["content"].encode() for t in told.get("added_tokens", [])]

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, -1 where it isn't."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[start:end], all merged side by side: in each round every piece merges its pair of least rank."""
        out = np.zeros(len(start), np.int64)
        length = end - start
        for i in np.flatnonzero(length > LONG):
            out[i] = self._long(self.byte[data[start[i] : end[i]]].tolist())
        live = np.flatnonzero((length <= LONG) & (length > 0))
        if not len(live):
            return out
        n = length[live]
        owner = np.repeat(np.arange(len(live)), n)
        token = self.byte[data[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[live], n)]]
        none = np.int64(1 << 40)
        while len(owner):
            pair = np.full(len(owner), -1)
            pair[:-1] = np.where(owner[1:] == owner[:-1], self.find(token[:-1], token[1:]), -1)
            rank = np.where(pair >= 0, self.rank[pair], none)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(owner)))
            over = least == none
            out[live[owner[first[over]]]] = size[over]
            hit = (rank == np.repeat(least, size)) & (rank < none)
            # Of overlapping hits (a a a) every other one counts, from the left.
            at = np.flatnonzero(hit)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, bool)
            head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            token[at] = self.new[pair[at]]
            stay = ~np.repeat(over, size)
            stay[at + 1] = False
            owner, token = owner[stay], token[stay]
        return out

    def _long(self, token: list[int]) -> int:
        n = len(token)
        after, before, left = [*range(1, n), -1], [-1, *range(n - 1)], n
        heap = []

        def push(at):
            if at >= 0 and after[at] >= 0:
                k = int(self.find(np.array([token[at]]), np.array([token[after[at]]]))[0])
                if k >= 0:
                    heapq.heappush(heap, (int(self.rank[k]), at, token[at], token[after[at]], int(self.new[k])))

        pair = self.find(np.array(token[:-1]), np.array(token[1:]))
        heap = [(int(self.rank[k]), i, token[i], token[i + 1], int(self.new[k])) for i, k in enumerate(pair.tolist()) if k >= 0]
        heapq.heapify(heap)
        while heap:
            _, at, a, b, new = heapq.heappop(heap)
            nxt = after[at]
            if token[at] != a or nxt < 0 or token[nxt] != b:
                continue
            token[at], token[nxt] = new, -1
            after[at] = after[nxt]
            if after[at] >= 0:
                before[after[at]] = at
            left -= 1
            push(at)
            push(before[at])
        return left


class Counter:
    """Counts tokens of batches of texts; keeps the pieces that it has compiled."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.keys, self.more, self.tokens = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(data):
            return out
        first, end, text = offsets[:-1], offsets[1:], np.arange(len(out))
        cuts = self._special(data, offsets)
        if cuts:
            at, stop = (np.array(x) for x in zip(*cuts, strict=True))
            mine = np.searchsorted(offsets, at, "right") - 1
            np.add.at(out, mine, 1)
            first, end, text = np.concatenate([first, stop]), np.concatenate([end, at]), np.concatenate([text, mine])
            end = end[np.lexsort((end, text))]
            order = np.lexsort((first, text))
            first, text = first[order], text[order]
        # The classes of all characters, with an END after every text or part of one.
        inside = np.ones(len(data), bool)
        for a, b in cuts:
            inside[a:b] = False
        lead = np.flatnonzero(((data & 0xC0) != 0x80) & inside)
        symbols = classes()[_code_points(data, lead)]
        edge = np.searchsorted(lead, first)
        symbols = np.insert(symbols, np.searchsorted(lead, end), END)
        place = np.arange(len(lead)) + np.repeat(np.arange(len(first)), np.diff(np.append(edge, len(lead))))
        start = lead[begins(symbols)[place]]
        if not len(start):
            return out
        owner = np.searchsorted(first, start, "right") - 1
        stop = np.minimum(np.append(start[1:], len(data)), end[owner])
        w = Words.__new__(Words)
        w.start, w.end = start, stop
        w._hash(data, True)
        h, one, where = np.unique(w.hash, return_index=True, return_inverse=True)
        tokens = self._tokens(h, w.hash2[one], data, start[one], stop[one])[where]
        other = np.flatnonzero(w.hash2 != w.hash2[one][where])  # pieces that share 64 bits with another one
        if len(other):
            tokens[other] = self.merges.counts(data, start[other], stop[other])
        np.add.at(out, text[owner], tokens)
        return out

    def _special(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where the special strings stand within a text, from the left."""
        raw, out = data.tobytes(), []
        for s in self.merges.special:
            at = raw.find(s)
            while at >= 0:
                inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(s) - 1, "right")
                if inside:
                    out.append((at, at + len(s)))
                at = raw.find(s, at + (len(s) if inside else 1))
        return sorted(out)

    def _tokens(self, h: np.ndarray, h2: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of pieces that are told by 128 bits, in order of the first 64."""
        at = np.searchsorted(self.keys, h)
        same = at < len(self.keys)
        same[same] = self.keys[at[same]] == h[same]
        known = same.copy()
        known[same] = self.more[at[same]] == h2[same]
        out = np.zeros(len(h), np.int64)
        out[known] = self.tokens[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.merges.counts(data, start[new], end[new])
            if len(self.keys) > KEPT:
                self.keys, self.more, self.tokens = self.keys[:0], self.more[:0], self.tokens[:0]
                at, same = at * 0, np.zeros(len(h), bool)
            new = new[~same[new]]
            self.keys, self.more, self.tokens = (np.insert(old, at[new], x[new]) for old, x in ((self.keys, h), (self.more, h2), (self.tokens, out)))
        return out


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 characters that begin at lead."""
    out = data[lead].astype(np.int32)
    byte = data[lead]
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        some = np.flatnonzero((byte >= low) & (byte < high))
        x = byte[some].astype(np.int32) & bits
        for k in range(1, more + 1):
            x = x << 6 | data[lead[some] + k] & 0x3F
        out[some] = x
    return out


def _count(merges, text_at: int, names: list[str]):
    def run(batches):
        counter = Counter(merges.value)
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_at))
            found = [counter.count(x, y) for _, _, x, y in pieces(data, offsets, PIECE_BYTES)]
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            keep = [c for i, c in enumerate(batch.columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())], names)

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """The columns of docs but text, and n_bytes (UTF-8) and n_tokens, as the tokenizer in the file `path` gives them.

    path names a byte-level BPE in the format of tokenizers' .json, on the driver. Null counts as empty: no bytes, no tokens. Special
    strings inside a text are one token each. Columns of docs named n_bytes or n_tokens are replaced; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens")
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))  # a vocabulary: a few MB
    at = docs.columns.index("text")
    kept = [f for i, f in enumerate(docs.schema.fields) if i != at]
    kind = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(_count(merges, at, kind.names), kind)
