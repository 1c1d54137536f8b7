"""Statistics of images, by mergeable aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pixels as P

#: Bins of a stop in the histogram that a white point is looked up in.
BINS = 64


def decode_table(spark: SparkSession) -> DataFrame:
    """code and linear16: the 256 codes of 8-bit sRGB as 16-bit linear values."""
    return spark.range(256).select(F.col("id").cast("int").alias("code"), F.floor(P.decode(F.col("id") / 255.0) * 65535.0 + 0.5).alias("linear16"))


def tone_stats(df: DataFrame, above: float, below: float) -> DataFrame:
    """image_id, colourfulness (mean span of the channels), bright and dark (shares of pixels with luma above and below) of 8-bit images."""
    y = F.shiftright(F.col("r") * 54 + F.col("g") * 183 + F.col("b") * 19 + 128, 8)
    span = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    first, last = min(256, math.ceil(above * 256)), min(256, math.floor(below * 256))
    n = F.count("*")
    return df.groupBy("image_id").agg((F.sum(span) / (n * 255.0)).alias("colourfulness"), (F.count_if(y >= first) / n).alias("bright"), (F.count_if(y < last) / n).alias("dark"))


def white_point(df: DataFrame, gains: tuple[float, float, float] = (1.0, 1.0, 1.0), step: float = 1.0) -> DataFrame:
    """image_id and its white in stops below 1 after gains, on a grid of every step-th pixel.

    A histogram of the stops, which is merged, tells the bin of the wanted pixel; only the pixels of that bin are ranked.
    """
    on = lambda c: F.floor(F.ceil(F.col(c) / step) * step) == F.col(c)
    y = sum((F.col(c) * (w * g) for c, w, g in zip("gb", P.LUMA[1:], gains[1:], strict=True)), F.col("r") * (P.LUMA[0] * gains[0]))
    stops = df.filter(on("x") & on("y")).select("image_id", (-F.log2(F.greatest(y, F.lit(P.FLOOR)))).alias("d")).withColumn("bin", F.floor(F.col("d") * BINS))
    counts = stops.groupBy("image_id", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id")
    held = counts.withColumn("seen", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("nth", F.floor(F.sum("n").over(w) * P.WHITE_SHARE) + 1)
    at = held.filter("seen < nth AND nth <= seen + n").select("image_id", "bin", (F.col("nth") - F.col("seen")).alias("k"))
    ranked = stops.join(at, ["image_id", "bin"]).withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("d")))
    return ranked.filter("r = k").select("image_id", P.clamp(F.col("d"), P.WHITE_LOW, P.WHITE_HIGH).alias("white_stops"))


def share(coverage: DataFrame) -> DataFrame:
    """image_id and the share of it that a mask (coverage) covers, parts counted as parts."""
    return coverage.groupBy("image_id").agg(F.avg("coverage").alias("share"))


def pace(renders: DataFrame, weight: float = 0.3) -> DataFrame:
    """viewer and cost, milliseconds for each megapixel as a moving mean in which each render (viewer, nth, ms, megapixels) takes part by weight.

    Renders so long ago that what is left of them is less than doubles tell aren't held: a viewer's list is bounded by the weight.
    """
    most = 1 if weight >= 1 else math.ceil(math.log(1e-18) / math.log(1 - weight)) + 1
    kept = renders.filter((F.col("megapixels") > 0) & ~F.isnan("ms") & (F.abs("ms") != float("inf")))
    kept = kept.select("viewer", "nth", (F.col("ms") / F.col("megapixels")).alias("cost"))
    last = kept.withColumn("_n", F.row_number().over(Window.partitionBy("viewer").orderBy(F.col("nth").desc(), F.col("cost").desc()))).filter(F.col("_n") <= most)
    runs = last.groupBy("viewer").agg(F.array_sort(F.collect_list(F.struct("nth", "cost"))).alias("runs"))
    step = lambda s, r: F.coalesce(s + (r["cost"] - s) * weight, r["cost"])
    return runs.select("viewer", F.aggregate("runs", F.lit(None).cast("double"), step).alias("cost"))


def steps_down(cost: Column, steps: Column, normal: Column, below: Column, budget: float, share: float) -> Column:
    """0 or 1: whether the next render takes the smaller level, from megapixels of the normal level and of that below (null if there is none)."""
    over, fits = normal * cost > budget, normal * cost <= budget * share
    down = F.when(steps >= 1, F.when(fits, 0).otherwise(1)).otherwise(F.when(over & below.isNotNull() & ~fits, 1).otherwise(0))
    return F.when(cost.isNull() | below.isNull(), 0).otherwise(down)
