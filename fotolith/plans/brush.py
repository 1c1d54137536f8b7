"""Brush masks: strokes that are painted or erased one after the other, as coverage by pixel.

Segments of strokes are joined with the tiles that they reach, and each tile folds its strokes in order; no task sees an image, and tiles
that no stroke reaches cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import SIZE

# Brush radii in shares of the diagonal, sizes and feathers of strokes that state none, where points may lie, and the levels of a coverage.
SIZES, STANDARD, AREA, LEVELS = (0.0005, 0.5), {"size": 0.04, "feather": 50.0, "flow": 100.0}, (-2.0, 3.0), 65535
#: How far, in pixels, a point may lie off the line between its neighbours and be left out; the least radius.
TOLERANCE, LEAST_RADIUS = 0.25, 0.5


def _distance(ax, ay, bx, by, px, py):
    """From points to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / n, 0.0, 1.0) if n > 0 else 0.0
    return np.sqrt((ax + t * dx - px) ** 2 + (ay + t * dy - py) ** 2)


def simplified(points: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """The points (n by 2) of a path without those that lie on it anyway: the farthest of a span stays and parts it."""
    if len(points) < 3:
        return points
    keep, spans = {0, len(points) - 1}, [(0, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d = _distance(*points[a], *points[b], points[a + 1 : b, 0], points[a + 1 : b, 1])
        if d.max() > tolerance:
            far = a + 1 + int(d.argmax())
            keep.add(far)
            spans += [(a, far), (far, b)]
    return points[sorted(keep)]


def sanitised(strokes: DataFrame) -> DataFrame:
    """Strokes with their values in range, and without points that aren't numbers or strokes that paint nothing."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    value = lambda c, low, high: F.least(F.greatest(F.when(ok(F.col(c)), F.col(c)).otherwise(F.lit(STANDARD[c])), F.lit(low)), F.lit(high)).alias(c)

    def tidy(c: Column) -> Column:
        c = F.least(F.greatest(c, F.lit(AREA[0])), F.lit(AREA[1])) * 10000.0
        return F.signum(c) * F.floor(F.abs(c) + 0.5) / 10000.0 + 0.0

    kept = F.filter("points", lambda p: ok(p["x"]) & ok(p["y"]))
    points = F.transform(kept, lambda p: F.struct(tidy(p["x"]).alias("x"), tidy(p["y"]).alias("y")))
    out = strokes.select("image_id", "nth", F.coalesce("erase", F.lit(False)).alias("erase"), value("size", *SIZES), value("feather", 0.0, 100.0), value("flow", 0.0, 100.0), points.alias("points"))
    return out.filter("size(points) > 0 AND flow > 0")


def segments(strokes: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, nth, erase, flow (0 to 1), r, inner and a segment in pixels (ax, ay, bx, by) for each piece of a path; a lone point is a segment."""
    held = sanitised(strokes).join(frames.select("image_id", "width", "height"), "image_id")
    r = F.greatest(F.col("size") * F.sqrt(F.col("width") * F.col("width") + F.col("height") * F.col("height")), F.lit(LEAST_RADIUS))
    path = F.transform("points", lambda p: F.struct((p["x"] * F.col("width")).alias("x"), (p["y"] * F.col("height")).alias("y")))
    held = held.withColumns({"r": r, "path": path}).withColumn("inner", F.col("r") * (1.0 - F.col("feather") / 100.0))
    held = held.select("image_id", "nth", "erase", (F.col("flow") / 100.0).alias("flow"), "r", "inner", "width", "height", "path")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(8)
            flat = paths.flatten()
            xy = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1)
            ends = np.concatenate([[0], np.cumsum(np.asarray(paths.value_lengths()))])
            row, rows = [], []
            for i, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                p = simplified(xy[s:e])
                pairs = np.concatenate([p[:1], p[:1]], 1) if len(p) == 1 else np.concatenate([p[:-1], p[1:]], 1)
                row.append(np.full(len(pairs), i))
                rows.append(pairs)
            at = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            pairs = np.concatenate(rows) if rows else np.zeros((0, 4))
            cols = [b.column(k).take(at) for k in range(8)] + [pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(4)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:8], "ax", "ay", "bx", "by"])

    return held.mapInArrow(told, "image_id long, nth long, erase boolean, flow double, r double, inner double, width long, height long, ax double, ay double, bx double, by double")


def _folded(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Coverage above 0 of a tile, from the segments that reach it."""
    image, ty, tx = (k.as_py() for k in key)
    c = {n: table.column(n).to_numpy(zero_copy_only=False) for n in ("nth", "erase", "flow", "r", "inner", "ax", "ay", "bx", "by", "width", "height")}
    ys, xs = np.arange(ty * SIZE, min((ty + 1) * SIZE, c["height"][0])), np.arange(tx * SIZE, min((tx + 1) * SIZE, c["width"][0]))
    py, px = ys[:, None] + 0.5, xs[None, :] + 0.5
    cover = np.zeros((len(ys), len(xs)))
    order = np.argsort(c["nth"], kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(c["nth"][order])) + 1):
        v, (r, inner) = np.zeros_like(cover), (c[n][some[0]] for n in ("r", "inner"))
        for i in some:
            d = _distance(c["ax"][i], c["ay"][i], c["bx"][i], c["by"][i], px, py)
            t = np.clip((d - inner) / (r - inner), 0.0, 1.0) if r > inner else (d > inner) * 1.0
            np.maximum(v, np.where(d <= inner, 1.0, np.where(d >= r, 0.0, 1.0 - t * t * (3.0 - 2.0 * t))), out=v)
        a = c["flow"][some[0]] * v
        fresh = cover * (1.0 - a) if c["erase"][some[0]] else cover + (1.0 - cover) * a
        # Each stroke leaves levels of 16 bits.
        cover = np.where(v > 0, np.floor(np.clip(fresh, 0.0, 1.0) * LEVELS + 0.5) / LEVELS, cover)
    j, i = np.nonzero(cover)
    return pa.table({"image_id": pa.array(np.full(len(j), image, np.int64)), "y": pa.array(ys[j].astype(np.int32)), "x": pa.array(xs[i].astype(np.int32)), "coverage": pa.array(cover[j, i])})


def brush_coverage(strokes: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, y, x and coverage (0 to 1) of the pixels that strokes leave covered.

    strokes: image_id, nth (their order), erase, size (radius, in shares of the diagonal), feather, flow (percent) and points (x, y in shares of
    the frame); frames: image_id, width, height. Within a stroke the nearest part of its path counts; over earlier strokes it builds up as paint
    does, or takes away. Values that are missing or no numbers are standard ones. Strokes of one image with one nth count as one.
    """
    held = segments(strokes, frames)
    span = lambda a, b, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.least(a, b) - F.col("r")) / SIZE)), F.least(F.floor((F.col(n) - 1) / SIZE), F.floor((F.greatest(a, b) + F.col("r")) / SIZE))))
    inside = lambda a, b, n: (F.greatest(a, b) + F.col("r") >= 0) & (F.least(a, b) - F.col("r") < F.col(n))
    held = held.filter(inside("ax", "bx", "width") & inside("ay", "by", "height"))
    dealt = held.withColumn("_ty", span("ay", "by", "height")).withColumn("_tx", span("ax", "bx", "width"))
    return dealt.groupBy("image_id", "_ty", "_tx").applyInArrow(_folded, "image_id long, y int, x int, coverage double")
