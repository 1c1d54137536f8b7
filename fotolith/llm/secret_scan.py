"""Secrets in texts: parts that are told by their form alone, and weaker ones that are told by the parts around them.

A credential has an identifier, a secret and often an endpoint. Strong parts are reported wherever they are. Names, bare keys and hosts
are weak: most are no credentials. Each is widened by a reach within its scope (a paragraph of its document), and the widened intervals
are joined with the parts of the other roles, for all documents of a batch at once, by bisection over sorted ends. Only a weak part that
meets what it lacks is reported. Texts stay in the task that reads them, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .words import pieces, text_buffer

#: All kinds in the order in which spans that start together are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "user", "key", "host")
BASE = KINDS[:3]
ASSIGN, ACCESS, HEX, USER, KEY, HOST = range(6)
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_KEY = 8, 16, 32, 20
#: Bytes between two parts of one credential at most, and what ends a scope.
REACH, SCOPE_END = 200, re.compile(rb"\n[ \t\r]*\n")

# Patterns over bytes; letter case is ASCII's. Each goes with words of which one is in every match, so that most texts needn't be searched.
_SET = rb"""["']?\x20*[:=]\x20*["']?"""
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)" + _SET + rb"([A-Za-z0-9+/_.=-]+)", re.I)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_USER = re.compile(rb"(?<![a-z])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|(?:access_?)?key_?id)" + _SET + rb"([A-Za-z0-9+/_.@=-]{3,})", re.I)
_USER_WORDS = (b"user", b"login", b"account", b"client", b"key")
_NAMED = re.compile(rb"(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|(?:access|secret|shared|private|auth|api)_?key|signature)" + _SET + rb"([^\s\"'<>,;]{4,})", re.I)
_NAMED_WORDS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"key", b"signature")
_URL = re.compile(rb"[a-z][a-z0-9+.-]{1,20}://(?:([^\s/:@\"'<>]+)(?::([^\s/@\"'<>]+))?@)?([A-Za-z0-9.-]+(?::[0-9]+)?)", re.I)
_HOST = re.compile(rb"(?<![a-z])(?:host(?:name)?|server|endpoint)" + _SET + rb"([A-Za-z0-9.-]{4,}(?::[0-9]+)?)", re.I)
_HOST_WORDS = (b"host", b"server", b"endpoint")


def _table(*ranges: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[r[0] : r[-1] + 1] = True
    return out


_DIGIT, _LOWER, _UPPER = _table(b"09"), _table(b"az"), _table(b"AZ")
_HEXES = _DIGIT | _table(b"af")
_KEYS = _DIGIT | _LOWER | _UPPER | _table(b"+", b"/", b"_", b"=", b"-")


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the longest runs of bytes inside a table, of at least so many bytes, none over the end of a text."""
    kind = inside[data]
    change = np.empty(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    long = (np.diff(at) >= least) & kind[at[:-1]]
    return at[:-1][long], at[1:][long]


def _strong_and_weak(raw: bytes, low: bytes, at: int, out: list[tuple[int, int, int]]) -> None:
    """Puts (kind, start, end) of one text's matches into out; the text starts at byte `at` of its piece."""
    has = lambda words: any(w in low for w in words)
    if has(_ASSIGN_WORDS):
        out.extend((ASSIGN, at + m.start(), at + m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= LEAST_VALUE)
    if b"AKIA" in raw:
        out.extend((ACCESS, at + m.start(), at + m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= LEAST_ACCESS)
    if (b":" in raw or b"=" in raw) and has(_USER_WORDS):
        out.extend((USER, at + m.start(1), at + m.end(1)) for m in _USER.finditer(raw))
    if (b":" in raw or b"=" in raw) and has(_NAMED_WORDS):
        out.extend((KEY, at + m.start(1), at + m.end(1)) for m in _NAMED.finditer(raw))
    if b"://" in raw:
        for m in _URL.finditer(raw):
            out.append((HOST, at + m.start(3), at + m.end(3)))
            out.extend((kind, at + m.start(g), at + m.end(g)) for kind, g in ((USER, 1), (KEY, 2)) if m.start(g) >= 0)
    if has(_HOST_WORDS):
        out.extend((HOST, at + m.start(1), at + m.end(1)) for m in _HOST.finditer(raw))


def _meets(low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each interval from low to high meets one of the others (start, end): of those that start by high, the one that ends last."""
    if not len(start):
        return np.zeros(len(low), bool)
    order = np.argsort(start, kind="stable")
    furthest = np.maximum.accumulate(end[order])
    before = np.searchsorted(start[order], high, "right")
    return (before > 0) & (furthest[np.maximum(before - 1, 0)] >= low)


def _apart(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans stay so that no weak one meets a strong one or a weak one that comes first by kind (user, host, key), start and length."""
    keep = kind < USER
    for k in (USER, HOST, KEY):
        of = np.flatnonzero(kind == k)
        if not len(of):
            continue
        free = of[~_meets(start[of] + 1, end[of] - 1, start[keep], end[keep] - 1)]
        free = free[np.lexsort((-end[free], start[free]))]
        # Of spans of one kind that meet, the first stays; those that begin before its end go.
        last = -1
        for i in free:
            if start[i] >= last:
                keep[i], last = True, end[i]
    return keep


def linked(kind: np.ndarray, start: np.ndarray, end: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which spans are reported; ends are the sorted places that part scopes (starts of what parts them). All of one buffer of bytes.

    Strong parts are. A user needs a secret (assign, hex or key) within reach in its scope, a key an identifier (access or user), a host both.
    """
    scope = np.searchsorted(ends, start, "right")
    bound = np.concatenate([[0], ends, [np.iinfo(np.int64).max]])
    low, high = np.maximum(start - REACH, bound[scope]), np.minimum(end + REACH, bound[scope + 1])
    secret, identifier = np.isin(kind, (ASSIGN, HEX, KEY)), np.isin(kind, (ACCESS, USER))
    # A part that ends where a scope ends doesn't reach into the next one, which starts a byte later at least.
    with_secret, with_identifier = (_meets(low + 1, high - 1, start[f], end[f]) for f in (secret, identifier))
    return (kind < USER) | ((kind == USER) & with_secret) | ((kind == KEY) & with_identifier) | ((kind == HOST) & with_secret & with_identifier)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, kind, start and end (code points) of the spans of a piece, by text, start, kind and end."""
    whole, found, ends = data.tobytes(), [], list(offsets[1:])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        raw = whole[a:b]
        _strong_and_weak(raw, raw.lower(), int(a), found)
    for a, b in zip(*_runs(data, offsets, _HEXES, LEAST_HEX), strict=True):
        found.append((HEX, a, b))
    run = _runs(data, offsets, _KEYS, LEAST_KEY)
    counts = [np.concatenate([[0], np.cumsum(t[data])]) for t in (_DIGIT, _LOWER, _UPPER)] if len(run[0]) else []
    for a, b in zip(*run, strict=True):
        if all(c[b] > c[a] for c in counts):
            found.append((KEY, a, b))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    kind, start, end = np.array(sorted(set(found)), np.int64).T
    if (kind >= USER).any():
        stay = _apart(kind, start, end)
        kind, start, end = kind[stay], start[stay], end[stay]
        ends += [m.start() for m in SCOPE_END.finditer(whole)]
        stay = linked(kind, start, end, np.unique(np.array(ends, np.int64)))
        kind, start, end = kind[stay], start[stay], end[stay]
    order = np.lexsort((end, kind, start))
    kind, start, end = kind[order], start[order], end[order]
    text = np.searchsorted(offsets, start, "right") - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return text, kind, points[start] - points[offsets[text]], points[end] - points[offsets[text]]


SPANS = "array<struct<kind: string, start: long, end: long>>"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of each row and spans, an array of (kind, start, end): places in code points, end exclusive, by start, kind (as in KINDS) and end.

    assign, access and hex are told by their form, leftmost and non-overlapping by kind. user (names), key (bare or named keys) and host are
    told with other parts of a credential, within REACH and a paragraph, and never overlap them or one another. A null or empty text has no
    spans, a null key and repeated rows stay as they are, further columns have no influence, texts are read whole, no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("_text"))
            parts, first = [], 0
            for a, _, piece, places in pieces(data, offsets):
                t, kind, start, end = _spans(piece, places)
                parts.append((t + a, kind, start, end))
            t, kind, start, end = (np.concatenate(c) if parts else np.zeros(0, np.int64) for c in zip(*parts or [((),) * 4], strict=True))
            first = np.concatenate([[0], np.cumsum(np.bincount(t.astype(np.int64), minlength=batch.num_rows))]).astype(np.int32)
            names = pa.array(KINDS).take(pa.array(kind.astype(np.int32)))
            spans = pa.StructArray.from_arrays([names, pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["kind", "start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.ListArray.from_arrays(pa.array(first), spans)], ["_key", "spans"])

    return rows.mapInArrow(told, f"_key {rows.schema[0].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("_key", key)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

