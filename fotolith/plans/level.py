"""Automatic level: the angle that straightens a photo, from the directions of its edges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pixels import LUMA
from .tiles import Tile, box, on_tiles

# The largest angle in degrees, bins of a degree, the least agreement, the least luminance and edge, and the blur of the histogram in bins.
MOST, BINS, AGREEMENT, DARKEST, FAINTEST, SPREAD, KERNEL, NEAR = 15.0, 10, 0.075, 1e-4, 1e-2, 3.0, 9, 5
LEAST_EDGE = 16
#: A blur of one pixel twice, the gradient's neighbour and the tensor's window.
REACH = 2 + 1 + 3


def _votes(t: Tile) -> dict[str, np.ndarray]:
    """bin and weight: how much edge of a tile each angle would level."""
    light = sum(t.planes[c] * k for c, k in zip("rgb", LUMA, strict=True))
    l = box(np.log2(np.maximum(light, DARKEST)), 1, 2)  # noqa: E741
    gx, gy = np.zeros_like(l), np.zeros_like(l)
    if min(l.shape) > 2:
        across, down = l[:, 2:] - l[:, :-2], l[2:] - l[:-2]
        gx[1:-1, 1:-1] = 3 * across[:-2] + 10 * across[1:-1] + 3 * across[2:]
        gy[1:-1, 1:-1] = 3 * down[:, :-2] + 10 * down[:, 1:-1] + 3 * down[:, 2:]
    a, b, c = (t.own(box(p, 3)) for p in (gx * gx, gy * gy, gx * gy))
    trace = a + b
    line = np.degrees(0.5 * np.arctan2(2 * c, a - b) + np.pi / 2)
    line = np.where(line > 90, line - 180, line)
    steep = np.abs(line) >= 90 - MOST
    turn = np.where(steep, line - 90 * np.sign(line), line)
    used = (trace >= FAINTEST) & (steep | (np.abs(line) <= MOST))
    coherence = np.sqrt((a - b) ** 2 + 4 * c * c)[used] / trace[used]
    at = np.minimum(np.floor((turn[used] + MOST) * BINS + 0.5).astype(np.int64), int(2 * MOST * BINS))
    weight = np.bincount(at, np.sqrt(trace[used]) * coherence**4, int(2 * MOST * BINS) + 1)
    some = np.flatnonzero(weight)
    return {"bin": some, "weight": weight[some]}


def level_estimates(df: DataFrame) -> DataFrame:
    """image_id, angle (in tenths of a degree) and confidence, the share of the evidence within half a degree of it.

    Images (image_id, y, x, r, g, b) of any sizes; those under 16 pixels either way, and those without edges, have no row.
    """
    large = df.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w")).filter((F.col("_h") >= LEAST_EDGE - 1) & (F.col("_w") >= LEAST_EDGE - 1))
    votes = on_tiles(df.join(large.select("image_id"), "image_id", "left_semi"), ["r", "g", "b"], _votes, "bin int, weight double", REACH)
    counts = votes.groupBy("image_id", "bin").agg(F.sum("weight").alias("n"))
    last = int(2 * MOST * BINS)
    # At most 301 bins of an image.
    held = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total")).filter("total > 0")
    at = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0))
    held = held.withColumn("hist", F.transform(F.sequence(F.lit(0), F.lit(last)), at))
    kernel = F.array(*(F.lit(math.exp(-k * k / (2 * SPREAD * SPREAD))) for k in range(-KERNEL, KERNEL + 1)))
    within = lambda i, reach: F.sequence(F.greatest(i - reach, F.lit(0)), F.least(i + reach, F.lit(last)))
    blur = lambda i: F.aggregate(within(i, KERNEL), F.lit(0.0), lambda s, j: s + F.get("hist", j) * F.get(kernel, j - i + KERNEL))
    held = held.withColumn("smooth", F.transform(F.sequence(F.lit(0), F.lit(last)), blur))
    held = held.withColumn("peak", (F.lit(last + 1) - F.array_position(F.reverse("smooth"), F.array_max("smooth"))).cast("int"))
    near = F.aggregate(within(F.col("peak"), NEAR), F.lit(0.0), lambda s, j: s + F.get("hist", j))
    l, c, r = (F.get("smooth", F.col("peak") + k) for k in (-1, 0, 1))  # noqa: E741
    bend = l - 2.0 * c + r
    offset = F.coalesce(F.when(F.abs(bend) > 1e-12, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), (l - r) * 0.5 / bend))), F.lit(0.0))
    tenths = F.col("peak") + F.when((F.col("peak") > 0) & (F.col("peak") < last), offset).otherwise(0.0) - MOST * BINS
    angle = F.signum(tenths) * F.floor(F.abs(tenths) + 0.5) / BINS + 0.0
    return held.select("image_id", angle.alias("angle"), (near / F.col("total")).alias("confidence"))


def auto_level(df: DataFrame) -> DataFrame:
    """image_id, angle (null where the edges don't agree on one) and confidence, for each image that has edges."""
    return level_estimates(df).withColumn("angle", F.when(F.col("confidence") >= AGREEMENT, F.col("angle")))
