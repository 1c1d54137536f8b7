"""Verdicts on URLs: rules by host and path, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bounded_batches
from .url_table import labelled_urls
from .words import U, mix, pieces, text_buffer

DIMENSIONS = 1 << 16
GRAMS = (3, 4, 5, 6)
#: The weight of a path beside its host, and the sign between them.
PATH, BREAK = 0.5, 0x0A
#: The share of URLs to block that is expected before a URL is seen.
PRIOR = 0.4


def host_of(url: Column) -> Column:
    """What follows the first ://, up to / ? # or the end, lower-cased for A-Z; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none. rules: (verdict, host and path); of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last put on is asked first
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all character n-grams of the hosts and paths that _shown joins; none holds both.

    The n-grams of a host have a square sum of 1 if they differ, those of a path of PATH squared.
    """
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    breaks = np.concatenate([[0], np.cumsum(data == BREAK)])
    part = 2 * text + (breaks[1:] > breaks[offsets[:-1]][text])
    owners, features = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in GRAMS:
        m = len(data) - size + 1
        if m <= 0:
            continue
        h = np.full(m, U(size))
        for j in range(size):
            h = mix(h ^ data[j : j + m].astype(U))
        same = np.flatnonzero(part[:m] == part[size - 1 :])
        owners.append(part[same])
        features.append(((h[same] + (part[same] % 2).astype(U)) % U(DIMENSIONS)).astype(np.int64))
    owner, feature = np.concatenate(owners), np.concatenate(features)
    value = np.where(owner % 2, PATH, 1.0) / np.sqrt(np.maximum(np.bincount(owner, minlength=2 * n), 1))[owner]
    return owner // 2, feature, value


def _shown(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(pa.array([f".{h}.\n{p}" for h, p in zip(hosts, paths, strict=True)], pa.large_string()))


def train(urls: list[tuple[str, int]], steps: int = 1000, rate: float = 2.0, l1: float = 3e-5, prior: float = PRIOR) -> np.ndarray:
    """Weights by full gradient steps over the labelled table, both labels of equal weight, each followed by shrinking all weights by l1.

    The last weight is the bias, the log odds of the prior; it isn't learnt, so that n-grams which both labels have weigh nothing.
    """
    y = np.array([label for _, label in urls], float)
    cut = [u.partition("://")[2].partition("#")[0].partition("?")[0].partition("/") for u, _ in urls]
    text, feature, share = _grams(*_shown([c[0].lower() for c in cut], [c[1] + c[2] for c in cut]))
    even = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w = np.zeros(DIMENSIONS)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(text, w[feature] * share, len(y))))
        w -= rate * np.bincount(feature, ((p - y) * even)[text] * share, DIMENSIONS)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return np.append(w, np.log(prior / (1 - prior)))


def scores(w: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The likelihood of block for each text of host and path."""
    n = len(offsets) - 1
    text, feature, share = _grams(data, offsets)
    return 1 / (1 + np.exp(-(np.bincount(text, w[feature] * share, n) + w[-1])))


def _scores(weights):
    def run(batches):
        w = weights.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            out = []
            for _, _, x, y in pieces(data, offsets):
                out.append(scores(w, x, y))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """For each row of pages (page_id, url; other columns are ignored): page_id, host, path, rule, verdict, score.

    A rule's verdict comes first, that of the longest rule that fits; without one the score, the likelihood of a URL to block, decides:
    block from 0.5 on. Null URLs and those without :// have an empty host and path and are scored as such, very long ones whole. Rows that tie or
    repeat are judged alike; no rows give no rows.
    """
    bounded_batches(pages.sparkSession)
    weights = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_urls()))
    held = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shown = F.concat(F.lit("."), "host", F.lit(".\n"), "path").alias("shown")
    scored = held.select("*", shown).mapInArrow(_scores(weights), "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
