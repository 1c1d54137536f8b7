"""Pixel stages as column expressions and grouped aggregates over a table of linear pixels (image_id, y, x, r, g, b).

A stage takes a triple of columns and returns one; a plan is a fold of stages into projections, which Spark compiles as a whole.
Stages that need other pixels are window or grouped aggregates by image. Stages that change nothing are left out of a plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
Stage = Callable[[Triple], Triple]

# Fixed values of the stages.
LUMA = (0.2126, 0.7152, 0.0722)
CONTRAST_GAMMA, CONTRAST_GREY, CONTRAST_STRENGTH = 2.2, 0.18, 0.8
LOOK_LIFT, LOOK_SLOPE, LOOK_PIVOT = 2.3784142, 1.65, 0.55
SKIN_PROTECTION, SKIN_HUE, SKIN_WIDTH = 0.6, 20.0, 20.0
VIGNETTE_DARKEN, VIGNETTE_LIGHTEN, VIGNETTE_START, VIGNETTE_END = 1.5, 1.0, 0.3, 1.0
SHADOWS, HIGHLIGHTS, WHITES, BLACKS, FLOOR = 2.0, 1.5, 1.0, 1.5, 1e-6
GAMUT_THRESHOLD, GAMUT_LIMIT, GAMUT_POWER = 0.97, 1.3, 1.2
HUE_RANGE, SATURATION_RANGE = (0.25, 0.7, 0.35), (0.4, 0.35, 0.45)
OMEGA, LEAST_TRANSMISSION, AIRLIGHT_SHARE = 0.9, 0.2, 0.001
WHITE_SHARE, WHITE_LOW, WHITE_HIGH = 0.005, -4.0, 10.0


@dataclass(frozen=True)
class Steps:
    """A stage of several projections: values that it uses many times get columns of their own."""

    over: Callable[[DataFrame], DataFrame]


def rgb(df_prefix: str = "") -> Triple:
    return tuple(F.col(df_prefix + c) for c in "rgb")


def each(t: Triple, f: Callable[[Column], Column]) -> Triple:
    return tuple(f(c) for c in t)


def luma(t: Triple) -> Column:
    return t[0] * LUMA[0] + t[1] * LUMA[1] + t[2] * LUMA[2]


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def smoothstep(low: float, high: float, c: Column) -> Column:
    t = clamp((c - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def exposure(stops: float) -> Stage:
    return lambda t: each(t, lambda c: c * (2.0**stops))


def white_balance(gains: tuple[float, float, float]) -> Stage:
    return lambda t: tuple(c * g for c, g in zip(t, gains, strict=True))


def contrast(amount: float) -> Stage:
    gamma, m = 2.0 ** (amount / 100 * CONTRAST_STRENGTH), CONTRAST_GREY ** (1 / CONTRAST_GAMMA)

    def one(c: Column) -> Column:
        p = F.pow(c, F.lit(1 / CONTRAST_GAMMA))
        q = F.when(p <= m, m * F.pow(p / m, F.lit(gamma))).otherwise(1.0 - (1.0 - m) * F.pow((1.0 - p) / (1.0 - m), F.lit(gamma)))
        return F.when((c >= 0) & (c < 1), F.pow(q, F.lit(CONTRAST_GAMMA))).otherwise(F.greatest(c, F.lit(0.0)))

    return lambda t: each(t, one)


def base_curve() -> Stage:
    def logistic(c):
        return 1.0 / (1.0 + F.pow(LOOK_PIVOT / c, F.lit(LOOK_SLOPE)))

    top = 1.0 / (1.0 + (LOOK_PIVOT / LOOK_LIFT) ** LOOK_SLOPE)
    return lambda t: each(t, lambda c: F.when(c <= 0, 0.0).when(c >= 1, c).otherwise(logistic(c * LOOK_LIFT) / top))


def saturation(amount: float) -> Stage:
    factor = 1.0 + amount / 100

    def stage(t):
        y = luma(t)
        return each(t, lambda c: y + (c - y) * factor)

    return stage


def hue(t: Triple) -> Column:
    """HSV hue of linear values in degrees; null for greys."""
    r, g, b = t
    top, low = F.greatest(*t), F.least(*t)
    span = top - low
    sector = F.when(top == r, (g - b) / span).when(top == g, (b - r) / span + 2.0).otherwise((r - g) / span + 4.0)
    return F.when(span > 0, F.pmod(sector * 60.0, F.lit(360.0)))


def vibrance(amount: float) -> Stage:
    a = amount / 100

    def stage(t):
        top, low, y = F.greatest(*t), F.least(*t), luma(t)
        s = 1.0 - F.sqrt(F.greatest(low, F.lit(0.0)) / top)
        away = F.abs(F.pmod(hue(t) - SKIN_HUE + 180.0, F.lit(360.0)) - 180.0)
        skin = F.greatest(F.lit(0.0), 1.0 - away / SKIN_WIDTH)
        weight = (1.0 - s) * (1.0 - s) * (1.0 - SKIN_PROTECTION * skin) if a > 0 else 0.6 * (0.5 + 0.5 * s)
        return each(t, lambda c: F.when((top <= 0) | (top == low), c).otherwise(y + (c - y) * (1.0 + a * weight)))

    return stage


def vignette(amount: float, width: int, height: int) -> Stage:
    """Needs the columns x and y."""

    def square(c, n):
        t = (c + 0.5) / float(n) * 2.0 - 1.0
        return t * t

    d = F.sqrt((square(F.col("x"), width) + square(F.col("y"), height)) * 0.5)
    a = amount / 100
    stops = smoothstep(VIGNETTE_START, VIGNETTE_END, d) * (a * (VIGNETTE_DARKEN if a < 0 else VIGNETTE_LIGHTEN))
    return lambda t: each(t, lambda c: c * F.pow(F.lit(2.0), stops))


def tone_ends(whites: float, blacks: float, white_stops: float = 0.0) -> Stage:
    """The end points of the tone stage, by the pixel's own brightness."""

    def stage(t):
        d = -F.log2(F.greatest(luma(t), F.lit(FLOOR)))
        stops = (whites / 100 * WHITES) * (1.0 - smoothstep(white_stops, white_stops + 1.5, d)) + (blacks / 100 * BLACKS) * smoothstep(4.0, 8.0, d)
        return each(t, lambda c: c * F.pow(F.lit(2.0), stops))

    return stage


def tone_local(shadows: float, highlights: float, base: Column) -> Stage:
    """The local part, by the brightness of the surroundings in stops below white."""
    stops = (shadows / 100 * SHADOWS) * smoothstep(2.0, 5.5, base) + (highlights / 100 * HIGHLIGHTS) * (1.0 - smoothstep(0.25, 3.0, base))
    return lambda t: each(t, lambda c: c * F.pow(F.lit(2.0), stops))


def calibration(primaries: tuple[tuple[float, float], ...]) -> Stage:
    """Primaries moved by (hue, saturation) each, -100 to 100; greys stay, and so does each primary's luminance."""
    m = [[float(i == j) for j in range(3)] for i in range(3)]
    chroma = lambda i: [float(k == i) - LUMA[i] for k in range(3)]
    for i, (h, s) in enumerate(primaries):
        toward = chroma((i + 1) % 3 if h >= 0 else (i + 2) % 3)
        move = [abs(h) / 100 * HUE_RANGE[i] * a + s / 100 * SATURATION_RANGE[i] * b for a, b in zip(toward, chroma(i), strict=True)]
        for k in range(3):
            for j in range(3):
                m[k][j] += move[k] * (float(j == i) - 1 / 3)
    return lambda t: tuple(F.greatest(F.lit(0.0), t[0] * a + t[1] * b + t[2] * c) for a, b, c in m)


def gamut() -> Stage:
    """Channels far below the brightest are brought in smoothly."""
    low, p = GAMUT_THRESHOLD, GAMUT_POWER
    scale = (GAMUT_LIMIT - low) / (((1 - low) / (GAMUT_LIMIT - low)) ** -p - 1) ** (1 / p)

    def stage(t):
        top = F.greatest(*t)

        def one(c):
            d = (top - c) / top
            near = low + (d - low) / F.pow(1.0 + F.pow((d - low) / scale, F.lit(p)), F.lit(1 / p))
            return F.when((top <= 0) | (d < low), c).otherwise(top - near * top)

        return each(t, one)

    return stage


def encode(c: Column) -> Column:
    """The sRGB curve."""
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def decode(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def quantised(c: Column, bits: int = 8) -> Column:
    """The code of a linear value."""
    return F.floor(encode(clamp(c)) * float((1 << bits) - 1) + 0.5).cast("int")


def plan(stages: list[Stage | None], df: DataFrame) -> DataFrame:
    """df with r, g and b after all stages; None stands for a stage that changes nothing.

    Each stage is a projection of its own, so that a stage that uses a channel many times doesn't repeat the stages before it; Spark
    compiles them into one loop over the rows.
    """
    for stage in stages:
        if isinstance(stage, Steps):
            df = stage.over(df)
        elif stage:
            df = df.withColumns(dict(zip("rgb", stage(rgb()), strict=True)))
    return df


# Statistics of images.


def histogram(df: DataFrame) -> DataFrame:
    """image_id, channel (r, g, b, luma), bin and n of 8-bit images (r, g, b); partial counts are merged by Spark."""
    y = F.shiftright(54 * F.col("r") + 183 * F.col("g") + 19 * F.col("b") + 128, 8)
    long = df.select("image_id", "r", "g", "b", y.alias("luma")).unpivot(["image_id"], ["r", "g", "b", "luma"], "channel", "bin")
    return long.groupBy("image_id", "channel", "bin").agg(F.count("*").alias("n"))


def percentile(counts: DataFrame, share: float) -> DataFrame:
    """image_id, channel and the value below which `share` of an image's pixels fall, within a bin by proportion."""
    w = Window.partitionBy("image_id", "channel").orderBy("bin")
    held = counts.withColumn("seen", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy("image_id", "channel")))
    wanted = F.col("total") * share
    at = held.filter(F.col("seen") + F.col("n") >= wanted)
    value = (F.col("bin") + clamp((wanted - F.col("seen")) / F.col("n"))) / 256.0
    return at.groupBy("image_id", "channel").agg(F.min_by(value, F.col("bin")).alias("value"))


def white_point(df: DataFrame) -> DataFrame:
    """image_id and its white in stops below 1: an exact order statistic of the stops of all pixels."""
    w = Window.partitionBy("image_id").orderBy("d", "y", "x")
    d = -F.log2(F.greatest(luma(rgb()), F.lit(FLOOR)))
    ranked = df.select("image_id", "y", "x", d.alias("d")).withColumn("nth", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("image_id")))
    return ranked.filter(F.col("nth") == F.floor(F.col("n") * WHITE_SHARE) + 1).select("image_id", clamp(F.col("d"), WHITE_LOW, WHITE_HIGH).alias("white_stops"))


def halved(df: DataFrame, size: int) -> DataFrame:
    """The next level of a pyramid of 16-bit values: means of 2 by 2, rounded; an odd edge is dropped."""
    even = df.filter((F.col("x") < size // 2 * 2) & (F.col("y") < size // 2 * 2))
    cells = even.groupBy("image_id", F.expr("cast(y div 2 AS int)").alias("y"), F.expr("cast(x div 2 AS int)").alias("x"))
    return cells.agg(*(F.expr(f"(sum({c}) + 2) div 4").alias(c) for c in "rgb"))


def scene_map(df: DataFrame, size: int, cells: int) -> DataFrame:
    """Area means over a grid of cells by cells."""
    at = lambda c: F.expr(f"cast({c} * {cells} div {size} AS int)").alias(c)
    return df.groupBy("image_id", at("y"), at("x")).agg(*(F.avg(c).alias(c) for c in "rgb"))


def box(df: DataFrame, columns: list[str], radius: int) -> DataFrame:
    """Means (named box_...) over windows of 2 * radius + 1 squared; at borders over the pixels inside. Two passes, each by lines of an image."""
    for axis, line in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("image_id", line).orderBy(axis).rangeBetween(-radius, radius)
        first = axis == "x"
        df = df.withColumns({f"box_{c}": F.avg(c if first else f"box_{c}").over(w) for c in columns})
    return df


def lowest(df: DataFrame, column: str, radius: int) -> DataFrame:
    """The least value in the window around each pixel, as `low`."""
    for axis, line, of in (("x", "y", column), ("y", "x", "low")):
        w = Window.partitionBy("image_id", line).orderBy(axis).rangeBetween(-radius, radius)
        df = df.withColumn("low", F.min(of).over(w))
    return df


def guided(df: DataFrame, guide: Column, value: Column, radius: int, eps: float) -> DataFrame:
    """A guided filter's linear model of value by guide, smoothed: columns a and b."""
    df = df.withColumns({"_g": guide, "_i": value}).withColumns({"_gg": F.col("_g") * F.col("_g"), "_gi": F.col("_g") * F.col("_i")})
    df = box(df, ["_g", "_i", "_gg", "_gi"], radius)
    var = F.greatest(F.lit(0.0), F.col("box__gg") - F.col("box__g") * F.col("box__g"))
    a = (F.col("box__gi") - F.col("box__g") * F.col("box__i")) / (var + eps)
    df = df.withColumn("_a", a).withColumn("_b", F.col("box__i") - F.col("_a") * F.col("box__g"))
    df = box(df, ["_a", "_b"], radius)
    return df.select("image_id", "y", "x", F.col("box__a").alias("a"), F.col("box__b").alias("b"))


def airlight(df: DataFrame, radius: int) -> DataFrame:
    """image_id and the mean colour of its haziest pixels: the top share by the least channel around each."""
    dark = lowest(df.withColumn("dark", F.least("r", "g", "b")), "dark", radius)
    w = Window.partitionBy("image_id").orderBy(F.col("low").desc(), "y", "x")
    ranked = dark.withColumn("nth", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("image_id")))
    top = ranked.filter(F.col("nth") <= F.greatest(F.lit(1), F.ceil(F.col("n") * AIRLIGHT_SHARE)))
    return top.groupBy("image_id").agg(*(F.greatest(F.avg(c), F.lit(1e-4)).alias(f"air_{c}") for c in "rgb"))


def dehaze(amount: float, transmission: Column) -> Stage:
    """Needs the columns air_r, air_g and air_b."""
    a, t = amount / 100, clamp(transmission)

    def stage(v):
        out = []
        for c, name in zip(v, "rgb", strict=True):
            air = F.col(f"air_{name}")
            if a >= 0:
                scale = 1.0 / F.greatest(F.lit(LEAST_TRANSMISSION), 1.0 - a * (1.0 - t))
                out.append(F.greatest(F.lit(0.0), c * scale + air * (1.0 - scale)))
            else:
                haze = -a * (0.1 + 0.3 * (1.0 - t))
                out.append(F.greatest(F.lit(0.0), c * (1.0 - haze) + air * haze))
        return tuple(out)

    return stage


# Masks.


def linear_mask(start: tuple[float, float], end: tuple[float, float], x: Column, y: Column) -> Column:
    """1 at start, 0 at end, smooth between."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    n = dx * dx + dy * dy
    t = clamp((x - start[0]) * (dx / n) + (y - start[1]) * (dy / n))
    return 1.0 - t * t * (3.0 - 2.0 * t)


def radial_mask(centre: tuple[float, float], radius: tuple[float, float], feather: float, x: Column, y: Column) -> Column:
    u, v = (x - centre[0]) / radius[0], (y - centre[1]) / radius[1]
    d, inner = F.sqrt(u * u + v * v), 1 - feather / 100
    if inner >= 1:
        return F.when(d <= 1, 1.0).otherwise(0.0)
    t = clamp((d - inner) / (1 - inner))
    return 1.0 - t * t * (3.0 - 2.0 * t)


def combined(c: Column, p: Column, how: str) -> Column:
    """Coverage with a part added, subtracted or intersected."""
    return {"add": c + p - c * p, "subtract": c * (1.0 - p), "intersect": c * p}[how]


def oklab(t: Triple) -> Triple:
    # The published matrices of Oklab.
    m1 = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
    m2 = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
    lms = [F.cbrt(t[0] * a + t[1] * b + t[2] * c) for a, b, c in m1]
    return tuple(lms[0] * a + lms[1] * b + lms[2] * c for a, b, c in m2)


def luminance_mask(low: float, high: float, fade: float, t: Triple) -> Column:
    light = oklab(t)[0] * 100.0
    if fade <= 0:
        return F.when((light >= low) & (light <= high), 1.0).otherwise(0.0)
    return smoothstep(low - fade, low, light) * (1.0 - smoothstep(high, high + fade, light))


def local_exposure(coverage: Column, stops: float) -> Stage:
    return lambda t: each(t, lambda c: c * F.pow(F.lit(2.0), coverage * stops))


def resized(df: DataFrame, size: int, target: int) -> DataFrame:
    """Area means of square images over target by target cells, pixels on a border by their share."""
    s = size / target
    span = lambda c: F.sequence(F.floor(F.col(c) / s).cast("int"), F.least(F.lit(target - 1), F.floor((F.col(c) + (1 - 1e-9)) / s).cast("int")))
    part = lambda c, o: F.least(F.col(c) + 1.0, (F.col(o) + 1) * s) - F.greatest(F.col(c).cast("double"), F.col(o) * s)
    cells = df.withColumn("oy", F.explode(span("y"))).withColumn("ox", F.explode(span("x")))
    weight = part("y", "oy") * part("x", "ox")
    return cells.groupBy("image_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*((F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in "rgb"))


def fitted(width: int, height: int, long_edge: int) -> tuple[int, int]:
    """A size with the given long edge, never enlarged."""
    scale = min(1.0, long_edge / max(width, height))
    return max(1, math.floor(width * scale + 0.5)), max(1, math.floor(height * scale + 0.5))
