"""Values of images at any places: points meet the tiles that they lie in, and are sampled there between the four pixels around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tiles import SIZE, apart


def gathered(points: DataFrame, df: DataFrame, frames: DataFrame, columns: dict[str, str]) -> DataFrame:
    """points (image_id, sx, sy and others) with values of df's columns, by their new names, at the places sx, sy.

    A pixel's own value is at its x, y; places beyond the edge count as the edge. frames: image_id, width, height. One shuffle of each side.
    """
    edge = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(n) - 1.0))
    held = points.join(frames.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id").withColumns({"_sx": edge("sx", "_w"), "_sy": edge("sy", "_h")}).drop("_w", "_h")
    held = held.withColumns({"_ty": F.floor(F.col("_sy") / SIZE), "_tx": F.floor(F.col("_sx") / SIZE)})
    # The first line and column of a tile are the last neighbours of the one before it.
    tile = lambda c: F.explode(F.when((F.col(c) % SIZE == 0) & (F.col(c) > 0), F.array(F.floor(F.col(c) / SIZE) - 1, F.floor(F.col(c) / SIZE))).otherwise(F.array(F.floor(F.col(c) / SIZE))))
    dealt = df.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in columns)).withColumn("_ty", tile("y")).withColumn("_tx", tile("x"))
    schema = StructType([*points.schema.fields, *(StructField(n, DoubleType()) for n in columns.values())])

    def told(pixels: pa.Table, at: pa.Table) -> pa.Table:
        out = {c: at.column(c) for c in points_columns}
        if not at.num_rows or not pixels.num_rows:
            out = {c: v.slice(0, 0) for c, v in out.items()}
            return pa.table({**out, **{n: pa.array([], pa.float64()) for n in columns.values()}})
        y, x = (pixels.column(c).to_numpy().astype(np.int64) for c in "yx")
        y0, x0 = y.min(), x.min()
        h, w = y.max() - y0 + 1, x.max() - x0 + 1
        sy, sx = (at.column(c).to_numpy() for c in ("_sy", "_sx"))
        iy, ix = np.floor(sy).astype(np.int64), np.floor(sx).astype(np.int64)
        ty, tx = sy - iy, sx - ix
        ay, ax, by, bx = iy - y0, ix - x0, np.minimum(iy - y0 + 1, h - 1), np.minimum(ix - x0 + 1, w - 1)
        for c, name in columns.items():
            p = np.full((h, w), np.nan)
            p[y - y0, x - x0] = pixels.column(c).to_numpy()
            top = p[ay, ax] + (p[ay, bx] - p[ay, ax]) * tx
            low = p[by, ax] + (p[by, bx] - p[by, ax]) * tx
            out[name] = pa.array(top + (low - top) * ty)
        return pa.table(out)

    points_columns = points.columns
    key = ["image_id", "_ty", "_tx"]
    return dealt.groupBy(*key).cogroup(apart(held).groupBy(*key)).applyInArrow(told, schema)
