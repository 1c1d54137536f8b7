"""Lens profiles: distortion undone, vignetting as a gain, and red and blue sampled where the lens put them.

A profile is a row for each image: curves over the distance from the centre, in shares of the half diagonal, as values at up to 32 knots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import gathered
from .written import written

# Knots at most, and how far a curve may be from 1.
MOST_KNOTS, DISTORTION, BRIGHTNESS, CHROMATIC = 32, 0.25, 1 / 16, 0.005
#: Places along the radius at which a scale is tried, and bisections of it.
TRIED, HALVINGS = 64, 30
CURVES = {"distortion": (1 - DISTORTION, 1 + DISTORTION), "vignetting": (BRIGHTNESS, 1.0), "red": (1 - CHROMATIC, 1 + CHROMATIC), "blue": (1 - CHROMATIC, 1 + CHROMATIC)}


def span(knots: Column, at: Column) -> Column:
    """The number of the span between knots in which a place lies."""
    return F.greatest(F.lit(0), F.least(F.size(knots) - 2, F.size(F.filter(knots, lambda k: k <= at)) - 1))


def curve(knots: Column, values: Column, at: Column, i: Column) -> Column:
    """A smooth curve through the values at the knots, at a place in span i; beyond its ends the ends' values."""
    n = F.size(knots)

    def slope(j: Column) -> Column:
        a, b = F.greatest(F.lit(0), j - 1), F.least(n - 1, j + 1)
        return (F.get(values, b) - F.get(values, a)) / (F.get(knots, b) - F.get(knots, a))

    x0, x1 = F.get(knots, i), F.get(knots, i + 1)
    h = x1 - x0
    t = (at - x0) / h
    t2, t3 = t * t, t * t * t
    inside = (2.0 * t3 - 3.0 * t2 + 1.0) * F.get(values, i) + (t3 - 2.0 * t2 + t) * h * slope(i) + (3.0 * t2 - 2.0 * t3) * F.get(values, i + 1) + (t3 - t2) * h * slope(i + 1)
    return F.when(at <= F.get(knots, F.lit(0)), F.get(values, F.lit(0))).when(at >= F.get(knots, n - 1), F.get(values, n - 1)).otherwise(inside)


def profiles(lenses: DataFrame) -> DataFrame:
    """image_id, knots and CURVES of the profiles that are sound and change anything, values in range, and fill, the scale at which the corrected photo fills its frame.

    lenses: image_id, knots and CURVES, arrays of which all but knots may be null; knots ascend and all arrays are as long as they.
    """
    sound = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    n = F.size("knots")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get("knots", i) > F.get("knots", i - 1))
    held = lenses.select("image_id", *(F.col(c).cast("array<double>").alias(c) for c in ("knots", *CURVES)))
    held = held.filter(n.between(2, MOST_KNOTS)).filter(sound("knots")).filter(F.forall(steps, lambda v: v))
    for c, (low, high) in CURVES.items():
        held = held.filter(F.col(c).isNull() | ((F.size(c) == n) & sound(c)))
        flat = F.transform("knots", lambda _: F.lit(1.0))
        held = held.withColumn(c, F.coalesce(F.transform(c, _within(low, high)), flat))
    held = written(held.filter(F.exists(F.concat(*CURVES), lambda v: v != 1.0)))  # a row for each image

    def fits(s: Column) -> Column:
        return F.forall(F.sequence(F.lit(0), F.lit(TRIED)), lambda i: s * curve(F.col("knots"), F.col("distortion"), s * i / TRIED, span(F.col("knots"), s * i / TRIED)) <= 1.0 + 1e-6)

    halved = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(1.0 - DISTORTION).alias("a"), F.lit(1.0).alias("b")), lambda s, _: _half(s, fits), lambda s: s["a"])
    return written(held.withColumn("fill", F.when(fits(F.lit(1.0)), 1.0).otherwise(halved)))


def _within(low: float, high: float):
    return lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v))


def _half(s: Column, fits) -> Column:
    mid = (s["a"] + s["b"]) * 0.5
    ok = fits(mid)
    return F.struct(F.when(ok, mid).otherwise(s["a"]).alias("a"), F.when(ok, s["b"]).otherwise(mid).alias("b"))


def corrected(df: DataFrame, frames: DataFrame, lenses: DataFrame) -> DataFrame:
    """Images (image_id, y, x, r, g, b) after their lenses' profiles; those without a sound one stay as they are."""
    known = profiles(lenses).join(frames, "image_id")
    far = F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")) / 2.0
    known = known.select("image_id", "knots", *CURVES, "fill", (F.col("width") / 2.0).alias("cx"), (F.col("height") / 2.0).alias("cy"), F.greatest(far, F.lit(1e-3)).alias("half"))
    points = df.select("image_id", "y", "x").join(known, "image_id")
    value = lambda name: curve(F.col("knots"), F.col(name), F.col("_r"), F.col("_i"))
    placed = lambda held, at: held.withColumn("_r", at).withColumn("_i", span(F.col("knots"), F.col("_r")))
    dx, dy = F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")
    points = placed(points, F.sqrt(dx * dx + dy * dy) / F.col("half") * F.col("fill"))
    points = points.withColumn("_k", F.col("fill") * value("distortion"))
    points = points.withColumns({"_dx": dx * F.col("_k"), "_dy": dy * F.col("_k")})
    points = placed(points, F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / F.col("half"))
    points = points.withColumns({"_red": value("red"), "_blue": value("blue"), "_gain": 1.0 / value("vignetting")})
    points = points.select("image_id", "y", "x", "_dx", "_dy", "cx", "cy", "_red", "_blue", "_gain")
    for c, scale in (("r", F.col("_red")), ("g", F.lit(1.0)), ("b", F.col("_blue"))):
        places = points.withColumns({"sx": F.col("cx") + F.col("_dx") * scale - 0.5, "sy": F.col("cy") + F.col("_dy") * scale - 0.5})
        points = gathered(places, df, frames, {c: f"_{c}"}).drop("sx", "sy")
    out = points.select("image_id", "y", "x", *((F.col(f"_{c}") * F.col("_gain")).alias(c) for c in "rgb"))
    return out.unionByName(df.select("image_id", "y", "x", "r", "g", "b").join(known.select("image_id"), "image_id", "left_anti"))
