"""Words, windows and their hashes over whole batches of UTF-8 texts, in numpy.

Both word patterns that the operators use are sets of ASCII separators, so they can be told from single bytes of UTF-8. A word's hash
chains its eight-byte blocks through a bijective mixer; a window's hash sums its words' hashes with random odd factors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


FACTORS = constants(1, 2)
#: By how many bytes of a block belong to the word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEPS = (constants(5, 64), constants(6, 64))

_separators = np.zeros(256, bool)
_separators[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x20\x09-\x0D]+
SPACED = ~_separators
_plain = np.zeros(256, bool)
_plain[0x00:0x30] = _plain[0x3A:0x61] = _plain[0x7B:0x80] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = ~_plain
ALNUM[0x41:0x5B] = True  # A-Z, which are lower-cased


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: longest runs of bytes of one kind in the table inside, where kind 0 (False) separates. start, end: bytes of each word; first: n + 1 bounds of the texts' words; hash: by word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool, twice: bool = False):
        self.data, self.offsets = data, offsets
        kind = inside[data].view(np.uint8)
        change = np.empty(len(data) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        self.start = np.flatnonzero(change[:-1] & (kind > 0))
        self.end = np.flatnonzero(change[1:] & (kind > 0)) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.first[-1] = len(self.start)
        self._hash(LOWER[data] if lower else data, twice)

    def _hash(self, data: np.ndarray, twice: bool) -> None:
        length = self.end - self.start
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        blocks = np.lib.stride_tricks.as_strided(padded[:8].view(U), (len(data) + 1,), (1,))
        h, h2 = mix(length), mix(~length) if twice else None
        rest, at, some = length, self.start, None  # some: the words that have a block more
        while len(rest):
            x = blocks[at] & MASKS[np.minimum(rest, 8)]
            if some is None:
                h = mix(h * FACTORS[0] + x)
                h2 = mix(h2 * FACTORS[1] + x) if twice else None
            else:
                h[some] = mix(h[some] * FACTORS[0] + x)
                if twice:
                    h2[some] = mix(h2[some] * FACTORS[1] + x)
            more = np.flatnonzero(rest > 8)
            rest, at, some = rest[more] - 8, at[more] + 8, more if some is None else some[more]
        self.hash, self.hash2 = h, h2

    def windows(self, size: int, twice: bool = False) -> np.ndarray:
        """Hashes of the windows of size words that start at each word, over the ends of texts too; valid() tells which count."""
        h = self.hash2 if twice else self.hash
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, U)
        out = np.zeros(n, U)
        for j in range(size):
            out += h[j : j + n] * STEPS[twice][j]
        return mix(out)

    def text_of(self) -> np.ndarray:
        """The text of each word, as its number in the batch."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """How many words its text has from each word on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
    """Splits a batch into runs of whole texts of about `most` bytes: (first text, end text, bytes, offsets)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of which row i holds values[bounds[i]:bounds[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
