"""Red eyes: the red that a flash leaves in pupils, found around a place and made dark and neutral.

Circles are joined with the pixels that they cover; only those are carried on. Circles of an image that don't touch go together, as spots do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dust import labels
from .pixels import smoothstep
from .retouch import _over, _rounds
from .written import written

# Ranges and standard values, the threshold of redness by the size of the pupil, its softness and the edge's, how far a pupil is darkened, and what a region of red must be.
STANDARD = {"x": (0.0, 1.0, 0.5), "y": (0.0, 1.0, 0.5), "radius": (0.001, 0.1, 0.01), "pupil": (0.0, 100.0, 50.0), "darken": (0.0, 100.0, 50.0)}
HIGHEST, BY_PUPIL, BELOW, ABOVE, EDGE, DARKENED, FAINTEST, LEVELS = 0.65, 0.2, 0.12, 0.05, 0.75, 0.75, 0.002, 65535
RED, FEWEST, LARGER, LEAST_SEARCH, LEAST_RADIUS = 0.55, 4, 1.5, 3.0, 1.5


def redness(r: Column, g: Column, b: Column) -> Column:
    """How far red outweighs green and blue, from 0 for grey to 1."""
    return F.when(r < FAINTEST, 0.0).otherwise(F.greatest((r - F.greatest(g, b)) / r, F.lit(0.0)))


def _value(c: str) -> Column:
    low, high, standard = STANDARD[c]
    ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))).otherwise(F.lit(standard))


def _cells(df: DataFrame, reach: str) -> DataFrame:
    """Each row for every pixel (y, x) of the box around its circle (cx, cy and a column with the radius), inside the frame."""
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - F.col(reach))), F.least(F.col(n), F.ceil(F.col(c) + F.col(reach))) - 1)
    inside = df.filter(f"cx + {reach} > 0 AND cy + {reach} > 0 AND cx - {reach} < width AND cy - {reach} < height")
    return inside.withColumn("y", F.explode(span("cy", "height"))).withColumn("x", F.explode(span("cx", "width")))


def corrected(df: DataFrame, frames: DataFrame, eyes: DataFrame) -> DataFrame:
    """Images (image_id, y, x, r, g, b from 0 to 1) after corrections (image_id, nth, x, y, radius, pupil, darken), in their order.

    Places are shares of the width and height, the radius one of the long edge; missing values are standard ones. Changed pixels have 16 bits.
    """
    base = df.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    known = eyes.join(frames.select("image_id", "width", "height"), "image_id").withColumns({c: _value(c) for c in STANDARD})
    known = known.select(
        "image_id", "nth", (F.col("x") * F.col("width")).alias("cx"), (F.col("y") * F.col("height")).alias("cy"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.greatest(F.col("radius") * F.greatest("width", "height"), F.lit(LEAST_RADIUS)).alias("r_"),
        (HIGHEST - F.col("pupil") / 100.0 * BY_PUPIL).alias("t"), (1.0 - F.col("darken") / 100.0 * DARKENED).alias("dark"), "width", "height",
    ).withColumnRenamed("r_", "r")
    known = written(known.groupBy("image_id").applyInArrow(_rounds, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields) + ", round int"))
    last = known.agg(F.max("round")).first()[0]
    changed = None
    for k in range(0 if last is None else last + 1):
        pixels = _over(base, changed)
        held = _cells(known.filter(F.col("round") == k).withColumnRenamed("r", "reach"), "reach").join(pixels, ["image_id", "y", "x"])
        d = F.hypot(F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")) / F.col("reach")
        own = (1.0 - smoothstep(EDGE, 1.0, d)) * _soft(redness(*(F.col(c) for c in "rgb")), F.col("t") - BELOW, F.col("t") + ABOVE)
        held = held.withColumn("own", own)
        # Softened over a pixel each way, within the circle's box.
        for axis, line, of in (("x", "y", "own"), ("y", "x", "_m")):
            held = held.withColumn("_m", F.avg(of).over(Window.partitionBy("image_id", "nth", line).orderBy(axis).rangeBetween(-1, 1)))
        held = held.withColumn("a", (F.col("own") + F.col("_m")) * 0.5).filter("a > 0")
        shade = F.greatest(F.col("dark"), F.least(F.lit(1.0), 1.0 - (1.0 - F.col("dark")) * F.col("own") / F.greatest("a", F.lit(1e-6))))
        pupil = {"r": (F.col("g") + F.col("b")) / 2.0, "g": F.col("g"), "b": F.col("b")}
        code = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * LEVELS + 0.5) / LEVELS
        fresh = held.select("image_id", "y", "x", *(code(F.col(c) + (v * shade - F.col(c)) * F.col("a")).alias(c) for c, v in pupil.items()))
        changed = written(fresh if changed is None else fresh.unionByName(changed.join(fresh.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")))
    return _over(base, changed)


def _soft(v: Column, low: Column, high: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return t * t * (3.0 - 2.0 * t)


def _region(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The connected red pixels of one search of which one is nearest to its centre: how many, and their centre."""
    y, x, d = (table.column(c).to_numpy() for c in ("y", "x", "d"))
    mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
    mask[y - y.min(), x - x.min()] = True
    label = labels(mask)[y - y.min(), x - x.min()]
    start = np.lexsort((x, y, d))[0]
    same = label == label[start]
    row = {"image_id": [key[0].as_py()], "nth": [key[1].as_py()], "n": [int(same.sum())], "sx": [float(x[same].mean() + 0.5)], "sy": [float(y[same].mean() + 0.5)]}
    return pa.table(row)


def find(df: DataFrame, frames: DataFrame, clicks: DataFrame) -> DataFrame:
    """image_id, nth, x, y and radius of the red pupil at or near each click (image_id, nth, x, y and search, its radius as a share of the long edge).

    It is the region of red nearest to the click, of those within the search, as a circle a little larger; clicks without one have no row.
    """
    long = F.greatest("width", "height")
    placed = clicks.join(frames.select("image_id", "width", "height"), "image_id")
    placed = placed.select("image_id", "nth", (F.col("x") * F.col("width")).alias("cx"), (F.col("y") * F.col("height")).alias("cy"), F.greatest(F.col("search") * long, F.lit(LEAST_SEARCH)).alias("reach"), "width", "height")
    red = df.select("image_id", "y", "x", redness(*(F.col(c).cast("double") for c in "rgb")).alias("red")).filter(F.col("red") >= RED)
    d = F.hypot(F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy"))
    held = _cells(placed, "reach").join(red, ["image_id", "y", "x"]).withColumn("d", d).filter("d <= reach")
    # Only the red pixels of a search come together.
    found = held.select("image_id", "nth", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "d").groupBy("image_id", "nth").applyInArrow(_region, "image_id long, nth long, n long, sx double, sy double")
    found = found.filter(F.col("n") >= FEWEST).join(frames.select("image_id", "width", "height"), "image_id")
    low, high, _ = STANDARD["radius"]
    radius = (F.sqrt(F.col("n") / np.pi) * LARGER + 1.0) / long
    return found.select("image_id", "nth", (F.col("sx") / F.col("width")).alias("x"), (F.col("sy") / F.col("height")).alias("y"), F.least(F.greatest(radius, F.lit(low)), F.lit(high)).alias("radius"))
