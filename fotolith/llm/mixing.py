"""Sources mixed to target weights by Poisson replication, with SQL functions only.

A document's number of copies is the inverse of the Poisson distribution, with its source's repetition rate as mean, at a uniform
value hashed from the seed and the document. Copies are dealt out and sorted by a hash, which is a global shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of md5 that are taken: 13 hexadecimal digits.
UNIFORM = float(1 << 52)


def cumulative(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution, as far as 52 bits tell them from 1."""
    total, k, out = 0.0, 0, []
    while True:
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else 1.0
        out.append(total)
        k += 1
        if total >= 1 - 1 / UNIFORM or (k > rate and k > rate + 12 * math.sqrt(rate) + 40):
            return out


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def identity() -> Column:
    """What tells a document: its doc_id, or its text where that is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def uniform(seed: int) -> Column:
    """A value in [0, 1) for each document."""
    return F.conv(F.substring(_key(F.lit(str(seed)), identity()), 1, 13), 16, 10).cast("long") / F.lit(UNIFORM)


#: The highest mean number of copies of a document; a target that needs more is refused.
MOST_COPIES = 1e6


def rates(counts: dict[str | None, int], targets: dict[str, float], size: float) -> dict[str | None, float]:
    """The mean number of copies by source; None stands for all sources without a target, which share the weight that is left."""
    total = sum(counts.values())
    weights = {s: w for s, w in targets.items() if counts.get(s)}
    if counts.get(None):
        weights[None] = max(0.0, 1 - sum(targets.values()))
    whole = sum(weights.values())
    return {s: size * total * w / whole / counts[s] if whole else 0.0 for s, w in weights.items()}


def mixed(docs: DataFrame, targets: dict[str, float], size: float = 1.0, seed: int = 17) -> DataFrame:
    """The columns of docs (doc_id, text and source among them), copy_no from 1 on, and mix_key, by which rows are sorted in each partition.

    The mix has about size times the rows of docs; targets are shares of it by source, positive and at most 1 in sum. Sources that docs lacks
    give their share to the others. A null source has no target. Rows that tie are repeated alike; a null text counts as any other; columns
    named copy_no or mix_key are replaced. No rows give no rows.
    """
    if any(w <= 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets must be positive and at most 1 in sum")
    docs = docs.drop("copy_no", "mix_key")
    # Steps of the distribution reach the tasks as a table of a row for each target, however high the rates are.
    listed = F.when(F.col("source").isin(*targets), F.col("source"))
    counts = {r[0]: r[1] for r in docs.groupBy(listed.alias("source")).count().collect()}  # a row for each target and one more
    rate = rates(counts, targets, size)
    if max(rate.values(), default=0) > MOST_COPIES:
        raise ValueError(f"a target needs more than {MOST_COPIES:.0f} copies of each document of its source")
    steps = [(source, cumulative(r)) for source, r in rate.items()]
    table = docs.sparkSession.createDataFrame(steps, "_source string, _steps array<double>")  # a row for each target and one more
    held = docs.withColumn("_listed", listed).join(F.broadcast(table), F.col("_listed").eqNullSafe(F.col("_source")), "left")
    held = held.withColumn("_u", uniform(seed)).withColumn("_n", F.size(F.filter(F.coalesce("_steps", F.array().cast("array<double>")), lambda c: c <= F.col("_u"))))
    held = held.select(*docs.columns, "_n")
    each = held.filter("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long")))).drop("_n")
    out = each.withColumn("mix_key", _key(F.lit(str(seed + 1)), identity(), F.col("copy_no").cast("string")))
    return out.repartition("mix_key").sortWithinPartitions("mix_key")
