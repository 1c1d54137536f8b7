"""Stages that look at a pixel's surroundings: dehaze, local tone, texture, clarity, sharpening and noise, over images of a table.

Each is a chain of window aggregates over lines of an image and of projections between them; images are dealt out by image and line.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pixels as P
from .pixels import FLOOR, Triple, clamp, luma, rgb, smoothstep

# Fixed values of the stages. Output sharpening: sigma, amount and threshold by medium.
MEDIA = {"screen": (0.6, 0.45, 0.01), "matte": (1.1, 0.9, 0.008), "glossy": (0.9, 0.6, 0.008)}
MAP_EDGE, MAP_RADIUS, TONE_EPS, HAZE_EPS, HAZE_PATCH = 256, 13, 0.25, 1e-3, 7
TEXTURE, CLARITY, MOST_STOPS, RADIUS_SHARE = 1.0, 2.0, 1.5, 0.0015
SHARPEN, SHARPEN_STOPS = 1.5, 0.5
NOISE_AT_WHITE, MOST_NOISE, CHROMA_STOPS, NOISE_SHARE = 0.03, 0.6, 0.3, 0.0008


def log_luma(t: Triple) -> Column:
    return F.log2(F.greatest(luma(t), F.lit(FLOOR)))


def haze_map(scene: DataFrame, patch: int = HAZE_PATCH, radius: int = MAP_RADIUS) -> DataFrame:
    """image_id, y, x, the air's colour, and a and b of the transmission by luminance over the air's, from a map of means (scene_map).

    The dark channel over the air's colour tells how much haze there is; a guided filter smooths it along edges.
    """
    air = P.airlight(scene, patch)  # a row for each image
    held = scene.join(air, "image_id")
    over = F.least(*(F.col(c) / F.col(f"air_{c}") for c in "rgb"))
    dark = P.lowest(held.withColumn("dark", over), "dark", patch)
    thin = clamp(1.0 - P.OMEGA * F.col("low"))
    guide = luma(rgb()) / air_luma()
    model = P.guided(dark, guide, thin, radius, HAZE_EPS)
    return model.join(air, "image_id")


def air_luma() -> Column:
    return F.greatest(luma(tuple(F.col(f"air_{c}") for c in "rgb")), F.lit(1e-4))


def tone_map(scene: DataFrame, radius: int = MAP_RADIUS) -> DataFrame:
    """image_id, y, x, and a and b of the surroundings' log2 luminance by a pixel's own, from a map of means."""
    i = log_luma(rgb())
    return P.guided(scene, i, i, radius, TONE_EPS)


def with_map(df: DataFrame, model: DataFrame, size: int, cells: int, names: tuple[str, ...]) -> DataFrame:
    """df with columns of a map of cells by cells, between the four cells around each pixel by its distance from their centres.

    Beyond the last line or column of cells that an image has, which may be fewer than cells, the last one stands in.
    """
    w = Window.partitionBy("image_id")
    model = model.select("image_id", "y", "x", *names).withColumns({f"_m{c}": F.max(c).over(w) for c in "yx"})  # at most cells * cells rows of an image
    for c in "yx":
        again = F.when(F.col(c) == F.col(f"_m{c}"), F.array(F.col(c), F.col(c) + 1)).otherwise(F.array(F.col(c)))
        model = model.withColumn(c, F.explode(again))
    at = lambda c: (F.col(c) + 0.5) * cells / size - 0.5
    low = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(at(c)))).cast("int")
    high = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(at(c)) + 1)).cast("int")
    held = df.withColumns({"_y0": low("y"), "_y1": high("y"), "_x0": low("x"), "_x1": high("x")})
    for j in "01":
        for i in "01":
            part = model.select("image_id", F.col("y").alias(f"_y{j}"), F.col("x").alias(f"_x{i}"), *(F.col(n).alias(f"_{n}{j}{i}") for n in names))
            held = held.join(part, ["image_id", f"_y{j}", f"_x{i}"])
    tx, ty = clamp(at("x") - F.col("_x0")), clamp(at("y") - F.col("_y0"))
    line = lambda n, j: F.col(f"_{n}{j}0") + (F.col(f"_{n}{j}1") - F.col(f"_{n}{j}0")) * tx
    return held.select(*df.columns, *((line(n, 0) + (line(n, 1) - line(n, 0)) * ty).alias(n) for n in names))


def dehazed(df: DataFrame, size: int, cells: int, amount: float, patch: int = HAZE_PATCH, radius: int = MAP_RADIUS) -> DataFrame:
    """Images of size by size with their haze taken away, or more of it for a negative amount."""
    model = haze_map(P.scene_map(df, size, cells), patch, radius)
    air = model.select("image_id", *(f"air_{c}" for c in "rgb")).distinct()
    held = with_map(df, model.withColumnsRenamed({"a": "haze_a", "b": "haze_b"}), size, cells, ("haze_a", "haze_b"))
    held = held.join(air, "image_id")
    t = F.col("haze_a") * (luma(rgb()) / air_luma()) + F.col("haze_b")
    return P.plan([P.dehaze(amount, t)], held).drop("haze_a", "haze_b", *(f"air_{c}" for c in "rgb"))


def surroundings(df: DataFrame, size: int, cells: int, radius: int = MAP_RADIUS) -> DataFrame:
    """df with `base`, the log2 luminance of each pixel's wide surroundings along edges."""
    model = tone_map(P.scene_map(df, size, cells), radius).withColumnsRenamed({"a": "tone_a", "b": "tone_b"})
    held = with_map(df, model, size, cells, ("tone_a", "tone_b"))
    return held.withColumn("base", F.col("tone_a") * log_luma(rgb()) + F.col("tone_b")).drop("tone_a", "tone_b")


def toned(df: DataFrame, size: int, cells: int, shadows: float, highlights: float, radius: int = MAP_RADIUS) -> DataFrame:
    """Shadows and highlights by the brightness of a pixel's surroundings."""
    model = tone_map(P.scene_map(df, size, cells), radius).withColumnsRenamed({"a": "tone_a", "b": "tone_b"})
    held = with_map(df, model, size, cells, ("tone_a", "tone_b"))
    below = -(F.col("tone_a") * log_luma(rgb()) + F.col("tone_b"))
    return P.plan([P.tone_local(shadows, highlights, below)], held).drop("tone_a", "tone_b")


def radius_of(width: int, height: int, share: float = RADIUS_SHARE, most: int = 24) -> int:
    return max(1, min(most, int(max(width, height) * share + 0.5)))


def blurred(df: DataFrame, column: str, radius: int, passes: int = 2) -> DataFrame:
    """df with the box mean of a column, passes times over, as blur_<column>."""
    name = f"blur_{column}"
    df = df.withColumn(name, F.col(column))
    for _ in range(passes):
        df = P.box(df, [name], radius).drop(name).withColumnRenamed(f"box_{name}", name)
    return df


def binomial(df: DataFrame, column: str) -> DataFrame:
    """df with the 3 by 3 binomial mean of a column as sharp_<column>; a pixel stands in for its missing neighbours at the border."""
    value = F.col(column)
    for axis, line in (("y", "x"), ("x", "y")):
        w = Window.partitionBy("image_id", line).orderBy(axis)
        df = df.withColumn("_v", value)
        df = df.withColumn("_s", (F.coalesce(F.lag("_v").over(w), "_v") + F.col("_v") * 2.0 + F.coalesce(F.lead("_v").over(w), "_v")) / 4.0)
        df, value = df.drop("_v").withColumnRenamed("_s", f"_s{axis}"), F.col(f"_s{axis}")
    return df.withColumn(f"sharp_{column}", value).drop("_sy", "_sx")


def gain_stops(texture: float, clarity: Column | float, sharpening: float, log_y: Column, small: Column, base: Column, sharp: Column) -> Column:
    """The change at a pixel in stops, from its log2 luminance, that around it, its surroundings' and its sharpening blur's."""
    d = -log_y
    fade = 1.0 - smoothstep(6.0, 10.0, d)
    fine = fade * (texture / 100 * TEXTURE) * (log_y - small)
    clarity = clarity if isinstance(clarity, Column) else F.lit(float(clarity))
    medium = clarity / 100.0 * CLARITY * smoothstep(0.0, 1.5, d) * (1.0 - smoothstep(7.0, 11.0, d)) * (small - base)
    edge = clamp(fade * (sharpening / 100 * SHARPEN) * (log_y - sharp), -SHARPEN_STOPS, SHARPEN_STOPS)
    return clamp(fine + medium + edge, -MOST_STOPS, MOST_STOPS)


def noise_eps(amount: float, mean: Column) -> Column:
    """How much of the variance around a mean log2 luminance counts as noise: the square of twice what is expected there."""
    sigma = F.least(F.lit(MOST_NOISE), F.pow(F.lit(2.0), F.greatest(F.lit(0.0), -mean) * 0.5) * NOISE_AT_WHITE)
    e = sigma * (2 * min(1.0, max(0.0, amount / 100)))
    return e * e + 1e-8


def denoised(df: DataFrame, column: str, amount: float, radius: int) -> DataFrame:
    """df with a column smoothed by itself as guide, as quiet_<column>."""
    df = df.withColumn("_qq", F.col(column) * F.col(column))
    df = P.box(df, [column, "_qq"], radius)
    m = F.col(f"box_{column}")
    var = F.greatest(F.lit(0.0), F.col("box__qq") - m * m)
    df = df.withColumn("_a", var / (var + noise_eps(amount, m))).withColumn("_b", m - F.col("_a") * m)
    df = P.box(df.drop("box__qq", f"box_{column}", "_qq"), ["_a", "_b"], radius)
    return df.withColumn(f"quiet_{column}", F.col("box__a") * F.col(column) + F.col("box__b")).drop("_a", "_b", "box__a", "box__b")


def quiet_colour(df: DataFrame, amount: float, radius: int = 2) -> DataFrame:
    """df with red and blue over luminance smoothed along the luminance's edges, as ratio_r and ratio_b."""
    strength = min(1.0, max(0.0, amount / 100))
    eps = (CHROMA_STOPS * strength) ** 2 + 1e-6
    y = F.greatest(luma(rgb()), F.lit(FLOOR))
    df = df.withColumns({"_i": F.log2(y), "_r": F.col("r") / y, "_b": F.col("b") / y})
    df = df.withColumns({"_ii": F.col("_i") * F.col("_i"), "_ir": F.col("_i") * F.col("_r"), "_ib": F.col("_i") * F.col("_b")})
    names = ["_i", "_r", "_b", "_ii", "_ir", "_ib"]
    df = P.box(df, names, radius)
    m = F.col("box__i")
    var = F.greatest(F.lit(0.0), F.col("box__ii") - m * m)
    slopes = {f"_a{c}": (F.col(f"box__i{c}") - m * F.col(f"box__{c}")) / (var + eps) for c in "rb"}
    df = df.withColumns(slopes).withColumns({f"_o{c}": F.col(f"box__{c}") - F.col(f"_a{c}") * m for c in "rb"})
    df = P.box(df.drop(*(f"box_{n}" for n in names)), ["_ar", "_ab", "_or", "_ob"], radius)
    out = {f"ratio_{c}": F.col(f"box__a{c}") * F.col("_i") + F.col(f"box__o{c}") for c in "rb"}
    return df.withColumns(out).drop(*names, *(f"{p}{k}{c}" for p in ("_", "box__") for k in "ao" for c in "rb"))


def detailed(df: DataFrame, width: int, height: int, texture: float = 0, clarity: float | Column = 0, sharpening: float = 0, noise: float = 0, base: str | None = None) -> DataFrame:
    """Images after texture, clarity, sharpening and noise reduction of the luminance.

    Clarity works against the column base, the log2 luminance of a pixel's wide surroundings (surroundings()), and does nothing without one.
    """
    df = df.withColumn("_l", log_luma(rgb()))
    df = denoised(df, "_l", noise, radius_of(width, height, NOISE_SHARE, 16)) if noise else df.withColumn("quiet__l", F.col("_l"))
    df = binomial(blurred(df, "quiet__l", radius_of(width, height)), "quiet__l")
    small = F.col("blur_quiet__l")
    wide = small if base is None else F.col(base)
    stops = clamp(F.col("quiet__l") - F.col("_l") + gain_stops(texture, clarity, sharpening, F.col("quiet__l"), small, wide, F.col("sharp_quiet__l")), -MOST_STOPS, MOST_STOPS)
    df = df.withColumn("_gain", F.pow(F.lit(2.0), stops))
    return df.withColumns({c: F.col(c) * F.col("_gain") for c in "rgb"}).drop("_gain", "_l", "quiet__l", "blur_quiet__l", "sharp_quiet__l")


def _gaussian(df: DataFrame, column: str, axis: str, line: str, weights: list[float]) -> Column:
    """The weighted mean along a line; border pixels stand in for those beyond."""
    r = len(weights) // 2
    w = Window.partitionBy("image_id", line).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(whole), F.last(column).over(whole)
    parts = [F.coalesce(F.lag(column, r - k).over(w), first) * v if k < r else F.coalesce(F.lead(column, k - r).over(w), last) * v if k > r else F.col(column) * v for k, v in enumerate(weights)]
    return sum(parts[1:], parts[0])


def output_sharpened(df: DataFrame, medium: str) -> DataFrame:
    """Encoded images (0 to 1) sharpened for a medium: what a blur takes from the luma is added to all channels, faint detail left out."""
    sigma, amount, threshold = MEDIA[medium]
    r = math.ceil(sigma * 3)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    weights = [v / sum(raw) for v in raw]
    df = df.withColumn("_l", luma(rgb()))
    df = df.withColumn("_a", _gaussian(df, "_l", "x", "y", weights))
    df = df.withColumn("_d", F.col("_l") - _gaussian(df, "_a", "y", "x", weights))
    t = clamp((F.abs("_d") - threshold) / threshold)
    df = df.withColumn("_k", F.col("_d") * t * t * (3.0 - 2.0 * t) * amount)
    return df.withColumns({c: clamp(F.col(c) + F.col("_k")) for c in "rgb"}).drop("_l", "_a", "_d", "_k")
