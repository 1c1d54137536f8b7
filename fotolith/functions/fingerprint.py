"""The stable 64-bit hash of files (FNV-1a), as expressions that don't overflow under ANSI arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

# Fixed values of FNV-1a, 64 bits: the offset basis and the prime.
OFFSET = 0xCBF29CE484222325
PRIME_LOW = 0x1B3  # the prime is 2**40 + 0x1b3
PRIME = (1 << 40) + PRIME_LOW
#: Bytes of a file that are hashed at each end.
SPAN = 65536


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _times_prime(h: Column) -> Column:
    """h * prime modulo 2**64, from two halves of 32 bits."""
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    a = low * F.lit(PRIME_LOW)
    b = (high * F.lit(PRIME_LOW) + F.shiftrightunsigned(a, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(b, 32).bitwiseOR(a.bitwiseAND(F.lit(0xFFFFFFFF)))


def fnv1a(content: Column, seed: Column | None = None) -> Column:
    """FNV-1a of binary content as a signed long; seed goes on from another hash."""
    hexed = F.hex(content)
    each = F.sequence(F.lit(1), F.length(content))
    start = F.lit(_signed(OFFSET)).cast("long") if seed is None else seed
    step = lambda h, i: _times_prime(h.bitwiseXOR(F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")))
    return F.when(F.length(content) > 0, F.aggregate(each, start, step)).otherwise(start)


def little_endian(n: Column, width: int = 8) -> Column:
    """The bytes of a non-negative long, lowest first."""
    digits = F.lpad(F.hex(n), width * 2, "0")
    return F.unhex(F.concat(*[F.substring(digits, width * 2 - 1 - 2 * k, 2) for k in range(width)]))


def fingerprint(content: Column, size: Column) -> Column:
    """Hash of the size, the first and the last 64 KiB; the last part begins after the first one."""
    tail = F.greatest(F.lit(SPAN).cast("long"), size - SPAN)
    ends = F.concat(little_endian(size), F.substring(content, 1, SPAN), F.substring(content, (tail + 1).cast("int"), F.lit(SPAN)))
    return fnv1a(ends)


def _fnv_rows(parts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings side by side: one step for each place of the longest, over the strings that reach it."""
    length = np.array([len(p) for p in parts])
    order = np.argsort(-length, kind="stable")
    out = np.full(len(parts), OFFSET, np.uint64)
    data = np.frombuffer(b"".join(parts[i] for i in order), np.uint8).astype(np.uint64)
    start = np.cumsum(length[order]) - length[order]
    reach = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")  # strings longer than each place
    for k, n in enumerate(reach):
        out[:n] = (out[:n] ^ data[start[:n] + k]) * np.uint64(PRIME)
    back = np.empty_like(out)
    back[order] = out
    return back.view(np.int64)


@pandas_udf(LongType())
def _ends_hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for ends in batches:
        yield pd.Series([], dtype="int64") if not len(ends) else pd.Series(_fnv_rows([bytes(x) if x is not None else b"" for x in ends]))


def file_fingerprint(content: Column, size: Column) -> Column:
    """The same as fingerprint, for whole files: both ends are cut in the JVM and hashed by batches of files, byte place by byte place."""
    tail = F.greatest(F.lit(SPAN).cast("long"), size - SPAN)
    return _ends_hashed(F.concat(little_endian(size), F.substring(content, 1, SPAN), F.substring(content, (tail + 1).cast("int"), F.lit(SPAN))))


@pandas_udf(LongType())
def _triples_hashed(size: pd.Series, modified_ns: pd.Series, print_: pd.Series) -> pd.Series:
    """FNV-1a of the three numbers' bytes, lowest first, the second in 16 bytes; a step for each byte place, over a batch of files."""
    h = np.full(len(size), OFFSET, np.uint64)
    for column, zeros in ((size, 0), (modified_ns, 8), (print_, 0)):
        n = column.to_numpy(np.int64).view(np.uint64)
        for k in range(8):
            h = (h ^ (n >> np.uint64(8 * k) & np.uint64(0xFF))) * np.uint64(PRIME)
        for _ in range(zeros):
            h = h * np.uint64(PRIME)
    return pd.Series(h.view(np.int64))


def source_id(size: Column, modified_ns: Column, print_: Column) -> Column:
    """Hash of size, time (16 bytes) and fingerprint, all longs; the path isn't in it, so it follows a moved file. Null where one of them is."""
    three = (size, modified_ns, print_)
    known = three[0].isNotNull() & three[1].isNotNull() & three[2].isNotNull()
    return F.when(known, _triples_hashed(*(F.coalesce(c, F.lit(0)).cast("long") for c in three)))
