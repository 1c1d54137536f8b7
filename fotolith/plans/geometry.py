"""Where pixels go: quarter turns, crop, straightening and perspective, resampling, sizes and levels."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# EXIF orientations as (quarter turns clockwise, mirrored first), the reach of perspective, and how export sizes grow.
EXIF = {2: (0, True), 3: (2, False), 4: (2, True), 5: (3, True), 6: (1, False), 7: (1, True), 8: (3, False)}
PERSPECTIVE_DEGREES = 20.0
SIZE_MODELS = {"jpeg": (0.903, 0.900), "png": (0.959, 0.937), "tiff": (0.994, 0.985)}
Map = Callable[[Column, Column], tuple[Column, Column]]


def from_exif(orientation: Column) -> tuple[Column, Column]:
    """Quarter turns and mirroring that show a file upright."""
    turns = F.create_map(*chain(*((F.lit(k), F.lit(t)) for k, (t, _) in EXIF.items())))
    return F.coalesce(F.try_element_at(turns, orientation), F.lit(0)), F.coalesce(orientation.isin([k for k, (_, f) in EXIF.items() if f]), F.lit(False))


def after(second: tuple[int, bool], first: tuple[int, bool]) -> tuple[int, bool]:
    """The one turn that does the first and then the second. Turns to the left of a mirror go the other way round."""
    turns = second[0] - first[0] if second[1] else second[0] + first[0]
    return turns % 4, second[1] != first[1]


def inverse(turn: tuple[int, bool]) -> tuple[int, bool]:
    """The turn that undoes it; a mirrored one undoes itself."""
    return turn if turn[1] else (-turn[0] % 4, False)


def turned_point(turn: tuple[int, bool], u: Column, v: Column) -> tuple[Column, Column]:
    """Where a point, in shares of the photo, is once it is turned."""
    x, y = (1.0 - u if turn[1] else u), v
    for _ in range(turn[0] % 4):
        x, y = 1.0 - y, x
    return x, y


def turned(df: DataFrame, turns: int, flip: bool, width: int, height: int) -> DataFrame:
    """Images mirrored left to right, then turned clockwise."""
    x, y = F.col("x"), F.col("y")
    if flip:
        x = F.lit(width - 1) - x
    for _ in range(turns % 4):
        x, y, width, height = F.lit(height - 1) - y, x, height, width
    return df.withColumns({"_x": x.cast("int"), "_y": y.cast("int")}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def mapping(width: int, height: int, crop: Sequence[float] = (0, 0, 1, 1), straighten: float = 0, vertical: float = 0, horizontal: float = 0, turns: int = 0, flip: bool = False) -> Map:
    """From shares (u, v) of the output to source pixels: crop, then straightening, perspective, quarter turns and mirroring undone.

    crop: x, y, width and height in shares of the turned photo; straighten in degrees; vertical and horizontal -100 to 100.
    """
    vw, vh = (height, width) if turns % 2 else (width, height)
    a, b = (math.radians(-v / 100 * PERSPECTIVE_DEGREES) for v in (vertical, horizontal))
    r = [[math.cos(b), 0, math.sin(b)], [math.sin(a) * math.sin(b), math.cos(a), -math.sin(a) * math.cos(b)], [-math.cos(a) * math.sin(b), math.sin(a), math.cos(a) * math.cos(b)]]
    focal, s, c = float(max(width, height)), math.sin(math.radians(straighten)), math.cos(math.radians(straighten))

    def source(u: Column, v: Column) -> tuple[Column, Column]:
        dx, dy = (u * crop[2] + crop[0] - 0.5) * vw, (v * crop[3] + crop[1] - 0.5) * vh
        if straighten:
            dx, dy = dx * c - dy * s, dx * s + dy * c
        if vertical or horizontal:
            x, y, z = (dx / focal * m[0] + dy / focal * m[1] + m[2] for m in r)
            z = F.greatest(z, F.lit(1e-3))
            dx, dy = (x / z - r[0][2] / r[2][2]) * focal, (y / z - r[1][2] / r[2][2]) * focal
        x, y, w, h = dx + vw / 2, dy + vh / 2, vw, vh
        for _ in range(turns % 4):
            x, y, w, h = y, F.lit(float(w)) - x, h, w
        return (F.lit(float(width)) - x if flip else x), y

    return source


def source_point(point: tuple[float, float], width: int, height: int, straighten: float = 0, vertical: float = 0, horizontal: float = 0) -> tuple[float, float]:
    """The same for one point, as numbers."""
    dx, dy = (point[0] - 0.5) * width, (point[1] - 0.5) * height
    s, c, f = math.sin(math.radians(straighten)), math.cos(math.radians(straighten)), max(width, height)
    dx, dy = dx * c - dy * s, dx * s + dy * c
    if vertical or horizontal:
        a, b = (math.radians(-v / 100 * PERSPECTIVE_DEGREES) for v in (vertical, horizontal))
        u, v = dx / f, dy / f
        x, y, z = math.cos(b) * u + math.sin(b), math.sin(a) * math.sin(b) * u + math.cos(a) * v - math.sin(a) * math.cos(b), max(1e-3, -math.cos(a) * math.sin(b) * u + math.sin(a) * v + math.cos(a) * math.cos(b))
        dx, dy = (x / z - math.tan(b) / math.cos(a)) * f, (y / z + math.tan(a)) * f
    return width / 2 + dx, height / 2 + dy


def effective_crop(crop: Sequence[float], width: int, height: int, straighten: float = 0, vertical: float = 0, horizontal: float = 0) -> tuple[float, float, float, float]:
    """The crop (x, y, width, height in shares), drawn to the centre just enough for its corners to lie inside the photo."""

    def at(share: float) -> tuple[float, float, float, float]:
        w, h = crop[2] * share, crop[3] * share
        return 0.5 + (crop[0] + crop[2] / 2 - 0.5) * share - w / 2, 0.5 + (crop[1] + crop[3] / 2 - 0.5) * share - h / 2, w, h

    def inside(c) -> bool:
        corners = [source_point((c[0] + c[2] * i, c[1] + c[3] * j), width, height, straighten, vertical, horizontal) for i in (0, 1) for j in (0, 1)]
        return all(-1e-3 <= x <= width + 1e-3 and -1e-3 <= y <= height + 1e-3 for x, y in corners)

    if inside(crop):
        return tuple(crop)
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if inside(at(mid)) else (low, mid)
    return at(low)


def filled(df: DataFrame, width: int, height: int) -> DataFrame:
    """Images of width by height: where one has fewer lines or columns, its last ones go on."""
    ends = df.groupBy("image_id").agg(F.max("y").alias("_my"), F.max("x").alias("_mx"))  # a row for each image
    held = df.join(ends, "image_id")
    for c, n in (("y", height), ("x", width)):
        on = F.when(F.col(c) == F.col(f"_m{c}"), F.sequence(F.col(c).cast("int"), F.greatest(F.col(c), F.lit(n - 1)).cast("int"))).otherwise(F.array(F.col(c).cast("int")))
        held = held.withColumn(c, F.explode(on))
    return held.select(df.columns)


def resampled(df: DataFrame, width: int, height: int, out_width: int, out_height: int, source: Map) -> DataFrame:
    """Images of out_width by out_height, each pixel between the four of the source around the place that it comes from.

    The source's images are dealt out by image_id, y and x, once for each of the four.
    """
    spark = df.sparkSession
    grid = spark.range(out_width * out_height).selectExpr(f"cast(id div {out_width} AS int) AS y", f"cast(id % {out_width} AS int) AS x")
    sx, sy = source((F.col("x") + 0.5) / out_width, (F.col("y") + 0.5) / out_height)
    grid = grid.withColumns({"_sx": sx - 0.5, "_sy": sy - 0.5})
    grid = grid.withColumns({"_x": F.floor("_sx"), "_y": F.floor("_sy")})
    held = lambda c, k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + k)).cast("int")
    # Each output place asks four source pixels; the sums of their shares are one aggregate.
    shares = F.array(*(F.struct(held("_x", i, width).alias("x"), held("_y", j, height).alias("y"), (_share("_sx", "_x", i) * _share("_sy", "_y", j)).alias("w")) for j in (0, 1) for i in (0, 1)))
    taps = grid.select(F.col("x").alias("_ox"), F.col("y").alias("_oy"), F.explode(shares).alias("t")).select("_ox", "_oy", "t.x", "t.y", "t.w").filter("w > 0")
    met = df.select("image_id", "y", "x", "r", "g", "b").join(taps, ["y", "x"])
    return met.groupBy("image_id", F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in "rgb"))


def _share(at: str, low: str, k: int) -> Column:
    t = F.col(at) - F.col(low)
    return t if k else 1.0 - t


def fitted(width: Column, height: Column, long_edge: Column) -> tuple[Column, Column]:
    """A size with a long edge of so many pixels at most, never enlarged; 0 stands for any."""
    same = (long_edge == 0) | (F.greatest(width, height) <= long_edge)
    short = lambda a, b: F.greatest(F.lit(1), F.floor(a * long_edge / b + 0.5)).cast("long")
    return F.when(same, width).when(width >= height, long_edge).otherwise(short(width, height)), F.when(same, height).when(width >= height, short(height, width)).otherwise(long_edge)


def fit(df: DataFrame, width: int, height: int, long_edge: int) -> DataFrame:
    """Images scaled down to a long edge: means of the areas that new pixels cover."""
    scale = min(1.0, long_edge / max(width, height)) if long_edge else 1.0
    w, h = (max(1, math.floor(n * scale + 0.5)) for n in (width, height))
    if (w, h) == (width, height):
        return df
    # How much of a pixel lies in each new one, by axis: a pixel touches two at most.
    for axis, n, m in (("x", width, w), ("y", height, h)):
        s = n / m
        first = F.floor((F.col(axis) + 1e-9) / s).cast("int")
        cut = F.least(F.col(axis) + 1.0, (first + 1) * s) - F.col(axis)
        parts = F.array(F.struct(first.alias("o"), cut.alias("w")), F.struct((first + 1).alias("o"), (1.0 - cut).alias("w")))
        df = df.withColumn("_p", F.explode(F.filter(parts, lambda p: (p["w"] > 1e-9) & (p["o"] < m)))).withColumns({f"_o{axis}": F.col("_p.o"), f"_w{axis}": F.col("_p.w")}).drop("_p")
    weight = F.col("_wx") * F.col("_wy")
    return df.groupBy("image_id", F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg(*((F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in "rgb"))


def level_for(width: Column, height: Column, wanted: Column, least: Column, most: int) -> Column:
    """The smallest level of a pyramid (0 is the photo, each is half the one before) whose long edge is at least wanted, of those no smaller than least."""
    edge = F.greatest(width, height)
    out = F.lit(0)
    for k in range(1, most + 1):
        size = F.shiftright(edge.cast("int"), k)
        out = F.when((size >= wanted) & (size >= least), k).otherwise(out)
    return out


def estimated(sample_bytes: Column, sample_pixels: Column, pixels: Column, format_: Column) -> Column:
    """The size of an export in bytes, from a sample's."""
    exponent, factor = (F.create_map(*chain(*((F.lit(k), F.lit(v[i])) for k, v in SIZE_MODELS.items())))[format_] for i in (0, 1))
    return F.when(sample_pixels == 0, F.lit(0).cast("long")).otherwise(F.floor(factor * sample_bytes * F.pow(pixels / sample_pixels, exponent) + 0.5).cast("long"))
