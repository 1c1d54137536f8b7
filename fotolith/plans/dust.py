"""Sensor dust: soft, round, slightly dark spots in smooth surroundings.

Each tile compares its pixels with a wide blur and labels the dark ones; labels that meet at tile borders are joined by rounds of the
least label, and the moments of a spot are sums over its pixels. Only spots of a spot's shape are then joined with the pixels around them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import LUMA
from .tiles import SIZE, Tile, box_held, frames, on_tiles
from .written import written

# Spots of an image at most, how dark one is against its background (natural logarithms), how even its surroundings, how neutral and how like its mirror image it is.
MOST, THRESHOLD, DEEPEST, UNEVEN, NEUTRAL, LOPSIDED, DARKEST, LEAST_EDGE = 40, 0.025, 0.8, 0.02, (0.2, 0.01), 0.35, 1e-4, 64
#: Rounds in which labels of tiles are joined. A spot reaches over two tiles by two; what isn't settled then is no spot.
ROUNDS = 4


def labels(mask: np.ndarray) -> np.ndarray:
    """For each pixel of a mask the least place (row by row) of those connected to it by sides; the size of the mask elsewhere."""
    out = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        before = out.copy()
        for turned in (out, out.T):
            flat, kind = turned.ravel(), (turned < mask.size)
            # Runs along a line: the least label of each.
            starts = kind & ~np.pad(kind, ((0, 0), (1, 0)))[:, :-1]
            run = np.cumsum(starts.ravel()) - 1
            inside = kind.ravel()
            if inside.any():
                least = np.full(run[-1] + 1, mask.size)
                np.minimum.at(least, run[inside], flat[inside])
                turned[kind] = least[run[inside]]
        if (before == out).all():
            return out


def _below(t: Tile) -> dict[str, np.ndarray]:
    """The tile's pixels that are darker than their background, and the dark ones' labels."""
    light = sum(t.planes[c] * k for c, k in zip("rgb", LUMA, strict=True))
    log = np.log(np.maximum(light, DARKEST))
    diff = box_held(log, int(t.given["_fine"]), 3) - box_held(log, int(t.given["_wide"]), 3)
    d, (y, x) = t.own(diff), t.places()
    shape = tuple(s.stop - s.start for s in t.core)
    local = labels((d <= -THRESHOLD).reshape(shape)).ravel()
    dark = local < len(d)
    at = np.where(dark, local, 0)
    last = (y == y.max()) | (x == x.max())
    some = np.flatnonzero(d < 0)
    out = {"y": y, "x": x, "diff": d, "label": np.where(dark, (y[at] << 32) + x[at], -1), "last": last, **{f"log_{c}": np.log(np.maximum(t.own(t.planes[c]), DARKEST)) for c in "rgb"}}
    return {n: v[some] for n, v in out.items()}


def _joined(spots: DataFrame) -> DataFrame:
    """image_id, label and root (the least label of a spot) of all labels that are settled."""
    near = []
    for dy, dx in ((0, 1), (1, 0)):
        a = spots.filter("last").select("image_id", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("label").alias("a"))
        near.append(a.join(spots.select("image_id", "y", "x", F.col("label").alias("b")), ["image_id", "y", "x"]).filter("a <> b").select("image_id", "a", "b"))
    pairs = written(near[0].unionByName(near[1]).distinct())
    roots = spots.select("image_id", "label").distinct().withColumn("root", F.col("label"))
    if pairs.isEmpty():
        return roots
    both = pairs.unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    told = both.select("image_id", F.col("a").alias("label")).distinct().withColumn("root", F.col("label"))
    for _ in range(ROUNDS):
        told = written(told)
        heard = both.join(told.select("image_id", F.col("label").alias("b"), "root"), ["image_id", "b"]).select("image_id", F.col("a").alias("label"), "root")
        told = told.unionByName(heard).groupBy("image_id", "label").agg(F.min("root").alias("root"))
    told = written(told)
    of = lambda c: told.select("image_id", F.col("label").alias(c), F.col("root").alias(f"root_{c}"))
    open_ = both.join(of("a"), ["image_id", "a"]).join(of("b"), ["image_id", "b"]).filter("root_a <> root_b").select("image_id", F.col("root_a").alias("root")).distinct()
    settled = told.join(open_, ["image_id", "root"], "left_anti").select("image_id", "label", "root")
    return roots.join(told.select("image_id", "label"), ["image_id", "label"], "left_anti").unionByName(settled)


def _around(spots: DataFrame, pixels: DataFrame, reach: Column) -> DataFrame:
    """Pixels (image_id, y, x and others) of the tiles within reach of each spot, with their spot's columns; `d` is the distance from its centre."""
    span = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.lit(0.0), F.col(c) - reach) / SIZE), F.floor((F.col(c) + reach) / SIZE)))
    dealt = spots.withColumn("_ty", span("cy")).withColumn("_tx", span("cx"))
    held = pixels.withColumns({"_ty": F.floor(F.col("y") / SIZE), "_tx": F.floor(F.col("x") / SIZE)})
    d = F.hypot(F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy"))
    return held.join(dealt, ["image_id", "_ty", "_tx"]).withColumn("d", d)


def find_dust(df: DataFrame) -> DataFrame:
    """image_id, x and y (shares of the width and height), radius (a share of the long edge), darkening and score: the best MOST spots of each image.

    Images (image_id, y, x, r, g, b) are linear, of any sizes; those under 64 pixels either way have none. Ties go to the higher, then the
    further left. Regions far too large for dust are left out whole.
    """
    long = F.greatest("width", "height")
    sized = frames(df).filter((F.col("width") >= LEAST_EDGE) & (F.col("height") >= LEAST_EDGE))
    sized = sized.withColumns({"_fine": F.greatest(F.lit(1), F.floor(long / 1000 + 0.5)), "_wide": F.greatest(F.lit(8), F.floor(long / 50 + 0.5)), "least": F.greatest(long * 0.0012, F.lit(1.2)), "most": long * 0.02})
    held = df.join(sized.select("image_id", "_fine", "_wide"), "image_id")
    schema = "y long, x long, diff double, label long, last boolean, log_r double, log_g double, log_b double"
    below = on_tiles(held, ["r", "g", "b"], _below, schema, F.col("_wide") * 3, given=["_fine", "_wide"])
    dark = written(below.filter("label >= 0"))
    weigh = lambda c: F.sum((F.col(c) + 0.5) * -F.col("diff"))
    spots = dark.join(_joined(dark), ["image_id", "label"]).groupBy("image_id", "root").agg(
        F.count("*").alias("area"), (weigh("x") / F.sum(-F.col("diff"))).alias("cx"), (weigh("y") / F.sum(-F.col("diff"))).alias("cy"), F.max(-F.col("diff")).alias("depth"),
        (F.max("x") - F.min("x") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), *(F.avg(f"log_{c}").alias(f"core_{c}") for c in "rgb"),
    )
    spots = spots.join(sized, "image_id").withColumn("core", F.sqrt(F.col("area") / np.pi)).withColumn("radius", F.greatest(F.greatest("bw", "bh") / 2.0, "core") * 1.6 + 1.0)
    spots = spots.filter("core >= least * 0.5 AND core <= most AND area / (bw * bh) >= 0.5 AND greatest(bw, bh) / least(bw, bh) <= 2.0").filter(F.col("depth") <= DEEPEST)
    spots = written(spots.filter("radius >= least AND radius <= most * 1.6 + 1.0"))
    # The surroundings: a ring of 1.5 to 2.5 radii.
    log = lambda c: F.log(F.greatest(c, F.lit(DARKEST)))
    light = sum((F.col(c) * k for c, k in zip("gb", LUMA[1:], strict=True)), F.col("r") * LUMA[0])
    near = _around(spots.select("image_id", "root", "cx", "cy", "radius"), df.select("image_id", "y", "x", log(light).alias("log"), *(log(F.col(c)).alias(f"log_{c}") for c in "rgb")), F.col("radius") * 2.5)
    ring = near.filter("d >= radius * 1.5 AND d <= radius * 2.5").groupBy("image_id", "root").agg(F.count("*").alias("n"), F.stddev_pop("log").alias("spread"), *(F.avg(f"log_{c}").alias(f"ring_{c}") for c in "rgb"))
    smooth = spots.join(ring, ["image_id", "root"]).filter("n >= 12").filter((F.col("spread") <= UNEVEN) & (F.col("depth") >= F.col("spread") * 3.0))
    drop = {c: F.col(f"core_{c}") - F.col(f"ring_{c}") for c in "rgb"}
    for c in "rb":
        smooth = smooth.filter(F.abs(drop[c] - drop["g"]) <= F.abs(drop["g"]) * NEUTRAL[0] + NEUTRAL[1])
    smooth = written(smooth.filter(drop["g"] < 0))
    # Each pixel within the radius against the one opposite it. A pixel stands for itself and for the opposite one; those that aren't below their background count as 0.
    inside = _around(smooth.select("image_id", "root", "cx", "cy", "radius", "width", "height"), below.select("image_id", "y", "x", "diff"), F.col("radius") + 2.0)
    inside = inside.withColumns({"my": F.floor(F.col("cy") * 2 - 0.5) - F.col("y"), "mx": F.floor(F.col("cx") * 2 - 0.5) - F.col("x")}).filter("my BETWEEN 0 AND height - 1 AND mx BETWEEN 0 AND width - 1")
    over = F.hypot(F.col("mx") + 0.5 - F.col("cx"), F.col("my") + 0.5 - F.col("cy"))
    key = ["image_id", "root"]
    one = inside.filter("d <= radius").select(*key, "y", "x", F.col("diff").alias("a"), F.lit(0.0).alias("b"))
    other = inside.filter(over <= F.col("radius")).select(*key, F.col("my").alias("y"), F.col("mx").alias("x"), F.lit(0.0).alias("a"), F.col("diff").alias("b"))
    each = one.unionByName(other).groupBy(*key, "y", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    even = each.groupBy(*key).agg((F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum(F.abs("a") + F.abs("b"))).alias("uneven")).filter(F.col("uneven") <= LOPSIDED)
    found = smooth.join(even, key).withColumn("score", F.col("depth") / (F.col("spread") + 0.005))
    best = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "cy", "cx")
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= MOST)
    return found.select("image_id", (F.col("cx") / F.col("width")).alias("x"), (F.col("cy") / F.col("height")).alias("y"), (F.col("radius") / F.greatest("width", "height")).alias("radius"), (1.0 - F.exp(-F.col("depth"))).alias("darkening"), "score")
