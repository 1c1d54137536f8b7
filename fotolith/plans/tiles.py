"""Images in tiles: rows of pixels become arrays of bounded size, each with the pixels around it that its stage looks at.

A stage that looks at a pixel's surroundings costs one shuffle this way, whatever its radius, and no task ever holds an image.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 64


@dataclass(frozen=True)
class Tile:
    """planes: the pixels inside the image within reach of the tile, by column; y0, x0: the place of their first one; core: the tile's own; given: what is said of the image."""

    image_id: int
    y0: int
    x0: int
    core: tuple[slice, slice]
    planes: dict[str, np.ndarray]
    given: dict[str, float]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """y and x of the tile's own pixels."""
        ys, xs = np.arange(self.core[0].start, self.core[0].stop) + self.y0, np.arange(self.core[1].start, self.core[1].stop) + self.x0
        return np.repeat(ys, len(xs)), np.tile(xs, len(ys))

    def own(self, plane: np.ndarray) -> np.ndarray:
        """A plane's values at the tile's own pixels, as a row."""
        return plane[self.core].ravel()


def on_tiles(df: DataFrame, columns: list[str], f: Callable[[Tile], dict[str, np.ndarray]], schema: str, reach: int | Column = 0, size: int = SIZE, given: list[str] | None = None) -> DataFrame:
    """image_id and the columns of schema that f makes of each tile. Images are whole rectangles from 0, 0 on, of any sizes.

    reach and the columns in given may differ from image to image; tiles are as large as the reach at least.
    """
    reach = reach if isinstance(reach, Column) else F.lit(reach)
    given = given or []
    held = df.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in [*columns, *given]), reach.cast("int").alias("_r"))
    held = held.withColumn("_s", F.greatest(F.lit(size), F.col("_r")))
    near = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col("_r")) / F.col("_s"))), F.floor((F.col(c) + F.col("_r")) / F.col("_s"))))
    dealt = held.withColumn("_ty", near("y")).withColumn("_tx", near("x"))
    whole = "image_id long, " + schema
    kinds = {n.split()[0]: n.split()[1] for n in whole.split(", ")}
    arrow = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    made = lambda c, v: pa.array(list(v), pa.binary()) if kinds[c] == "binary" else pa.array(np.asarray(v)).cast(arrow[kinds[c]])

    def told(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        image, size, ty, tx = (k.as_py() for k in key)
        y, x = (table.column(c).to_numpy().astype(np.int64) for c in "yx")
        y0, x0, h, w = y.min(), x.min(), y.max() - y.min() + 1, x.max() - x.min() + 1
        core = tuple(slice(max(0, t * size - o), min(n, (t + 1) * size - o)) for t, o, n in ((ty, y0, h), (tx, x0, w)))
        out: dict[str, np.ndarray] = {n: np.zeros(0) for n in kinds if n != "image_id"}
        if core[0].stop > core[0].start and core[1].stop > core[1].start:
            planes = {}
            for c in columns:
                planes[c] = np.zeros((h, w))
                planes[c][y - y0, x - x0] = table.column(c).to_numpy()
            out = f(Tile(image, int(y0), int(x0), core, planes, {c: table.column(c)[0].as_py() for c in given}))
        n = len(next(iter(out.values())))
        return pa.table({"image_id": pa.array(np.full(n, image, np.int64)), **{c: made(c, v) for c, v in out.items()}})

    return dealt.groupBy("image_id", "_s", "_ty", "_tx").applyInArrow(told, whole)


def apart(df: DataFrame) -> DataFrame:
    """The same table with columns of its own, so that it can be grouped together with one that it was made of."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def frames(df: DataFrame) -> DataFrame:
    """image_id, width and height, a row for each image."""
    return df.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("width"), (F.max("y") + 1).cast("long").alias("height"))


def box(plane: np.ndarray, radius: int, passes: int = 1) -> np.ndarray:
    """Means over windows of 2 * radius + 1 squared, at the edges over what is inside, passes times over."""
    for axis in (0, 1):
        n = plane.shape[axis]
        low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        count = (high - low).reshape((-1, 1) if axis == 0 else (1, -1))
        for _ in range(passes):
            sums = np.concatenate([np.zeros_like(plane.take([0], axis)), np.cumsum(plane, axis)], axis)
            plane = (sums.take(high, axis) - sums.take(low, axis)) / count
    return plane


def box_held(plane: np.ndarray, radius: int, passes: int) -> np.ndarray:
    """Means over windows of 2 * radius + 1 squared, with the edge's pixel in place of those beyond it, passes times over."""
    for _ in range(passes):
        for axis in (1, 0):
            pad = [(radius + 1, radius) if a == axis else (0, 0) for a in (0, 1)]
            sums = np.cumsum(np.pad(plane, pad, mode="edge"), axis)
            n = plane.shape[axis]
            plane = (sums.take(range(2 * radius + 1, 2 * radius + 1 + n), axis) - sums.take(range(n), axis)) / (2 * radius + 1)
    return plane
