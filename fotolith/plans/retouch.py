"""Retouching: discs of a photo replaced by discs from elsewhere in it, copied or healed, and the search for such a source.

A healed disc gets its source's texture and its own surroundings' colour: what differs along the edge is spread over it as a smooth
membrane. Spots are applied in their order; those that don't touch one another are applied together, so the rounds are as many as the
longest chain of spots that lie over each other, whatever the number of images. Only the pixels of spots are carried from round to round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import gathered
from .tiles import SIZE, apart
from .written import written

# Standard values and ranges of spots; samples along the edge (each over three radii, smoothed around the ring) and of the membrane's grid.
STANDARD = {"x": (0.0, 1.0, 0.5), "y": (0.0, 1.0, 0.5), "source_x": (0.0, 1.0, 0.5), "source_y": (0.0, 1.0, 0.5), "radius": (0.001, 0.25, 0.02), "feather": (0.0, 100.0, 30.0), "opacity": (0.0, 100.0, 100.0)}
SAMPLES, RUN, GRID, NEAREST, LEVELS = (12, 128), (0.0, 1.0, 2.0), 24, 1e-3, 65535
# Fixed values of the search: distances and directions of candidates, radii of the rings around and the ring inside that are compared, the margin, and the cost of distance.
DISTANCES, DIRECTIONS, RINGS, RING, INSIDE, INNER, MARGIN, FARTHER = (2.5, 3.5, 5.0), 24, (1.2, 1.5), 24, 12, 0.6, 1.6, 0.05


def placed(spots: DataFrame, frames: DataFrame) -> DataFrame:
    """Spots in pixels: image_id, nth, heal, cx, cy, dx, dy (to the source), r, inner (share of the radius that is whole) and opacity (0 to 1)."""
    held = spots.join(frames.select("image_id", "width", "height"), "image_id")

    def value(c: str) -> Column:
        low, high, standard = STANDARD[c]
        ok = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(ok, F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))).otherwise(F.lit(standard))

    held = held.withColumns({c: value(c) for c in STANDARD})
    held = held.filter("opacity > 0 AND NOT (x = source_x AND y = source_y)")
    return held.select(
        "image_id", "nth", (F.coalesce("kind", F.lit("heal")) != "clone").alias("heal"), (F.col("x") * F.col("width")).alias("cx"), (F.col("y") * F.col("height")).alias("cy"), ((F.col("source_x") - F.col("x")) * F.col("width")).alias("dx"),
        ((F.col("source_y") - F.col("y")) * F.col("height")).alias("dy"), F.greatest(F.col("radius") * F.greatest("width", "height"), F.lit(1.0)).alias("r"), (1.0 - F.col("feather") / 100.0).alias("inner"), (F.col("opacity") / 100.0).alias("opacity"), "width", "height",
    )


def _rounds(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The spots of one image with their round: one more than that of any earlier spot whose disc lies where this one reads or writes, or the other way round."""
    order = np.argsort(table.column("nth").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    cx, cy, dx, dy, r = (table.column(c).to_numpy() for c in ("cx", "cy", "dx", "dy", "r"))
    reach, round_ = r + RUN[-1] + 2.0, np.zeros(len(r), np.int32)

    def over(i, j, k, m):  # the disc of i at its place or its source, against that of j
        return np.hypot(cx[i] + k * dx[i] - cx[j] - m * dx[j], cy[i] + k * dy[i] - cy[j] - m * dy[j]) < reach[i] + reach[j]

    for i in range(1, len(r)):
        j = np.arange(i)
        met = over(i, j, 0, 0) | over(i, j, 1, 0) | over(i, j, 0, 1)
        if met.any():
            round_[i] = round_[:i][met].max() + 1
    return table.append_column("round", pa.array(round_))


def _covered(d: Column) -> Column:
    t = (d - F.col("inner")) / (1.0 - F.col("inner"))
    return F.when(d >= 1.0, 0.0).when(d <= F.col("inner"), 1.0).otherwise(1.0 - t * t * (3.0 - 2.0 * t))


def _edges(now: DataFrame, pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, nth, k, count, bx, by and the difference (r, g, b) at each sample along the edges of spots that are healed."""
    count = F.greatest(F.lit(SAMPLES[0]), F.least(F.lit(SAMPLES[1]), F.ceil(F.col("r") * math.pi))).cast("int")
    each = now.filter("heal").withColumn("count", count).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    turn = F.col("k") / F.col("count") * (2 * math.pi)
    each = each.withColumns({"_c": F.cos(turn), "_s": F.sin(turn)}).withColumn("_out", F.explode(F.array(*map(F.lit, RUN)))).withColumn("_there", F.explode(F.array(F.lit(0), F.lit(1))))
    far = F.col("r") + F.col("_out")
    sx, sy = F.col("cx") + F.col("_c") * far + F.col("dx") * F.col("_there") - 0.5, F.col("cy") + F.col("_s") * far + F.col("dy") * F.col("_there") - 0.5
    points = each.select("image_id", "nth", "k", "count", (F.col("_c") * F.col("r")).alias("bx"), (F.col("_s") * F.col("r")).alias("by"), "_there", sx.alias("sx"), sy.alias("sy"))
    got = gathered(points, pixels, frames, {c: f"_{c}" for c in "rgb"})
    sign = 1.0 - 2.0 * F.col("_there")
    return got.groupBy("image_id", "nth", "k", "count", "bx", "by").agg(*((F.sum(F.col(f"_{c}") * sign) / len(RUN)).alias(c) for c in "rgb"))


def _membrane(ring: dict[str, np.ndarray], r: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What is added at the places x, y from the centre: the edge's differences, smoothed around it, weighed by nearness on a grid, and between the grid's places."""
    order = np.argsort(ring["k"])
    edge, diff = np.stack([ring["bx"], ring["by"]], 1)[order], np.stack([ring[c] for c in "rgb"], 1)[order]
    n = len(edge)
    width = max(1, n // 16)
    diff = np.mean([np.roll(diff, width - j, 0) for j in range(2 * width + 1)], 0)
    step = max(1.0, r / GRID)
    cells = math.ceil(2 * r / step) + 2
    start = -(cells - 1.0) * step / 2
    at = start + np.arange(cells) * step
    near = 1.0 / np.maximum((at[None, :, None] - edge[:, 0]) ** 2 + (at[:, None, None] - edge[:, 1]) ** 2, NEAREST)
    values = near @ diff / near.sum(2)[..., None]
    fx, fy = (np.clip((v - start) / step, 0, cells - 1.0) for v in (x, y))
    ix, iy = (np.minimum(v.astype(np.int64), cells - 2) for v in (fx, fy))
    tx, ty = (fx - ix)[:, None], (fy - iy)[:, None]
    top = values[iy, ix] + (values[iy, ix + 1] - values[iy, ix]) * tx
    low = values[iy + 1, ix] + (values[iy + 1, ix + 1] - values[iy + 1, ix]) * tx
    return top + (low - top) * ty


def _blended(discs: pa.Table, ring: pa.Table) -> pa.Table:
    """New values of a spot's pixels within one tile."""
    c = {n: discs.column(n).to_numpy() for n in ("y", "x", "cx", "cy", "r", "alpha", *(f"{p}{k}" for p in "hs" for k in "rgb"))}
    here, there = (np.stack([c[f"{p}{k}"] for k in "rgb"], 1) for p in "hs")
    if discs.num_rows and ring.num_rows:
        there = there + _membrane({n: ring.column(n).to_numpy() for n in ("k", "bx", "by", "r", "g", "b")}, c["r"][0], c["x"] + 0.5 - c["cx"], c["y"] + 0.5 - c["cy"])
    out = np.floor(np.clip(here + (there - here) * c["alpha"][:, None], 0.0, 1.0) * LEVELS + 0.5) / LEVELS
    return pa.table({"image_id": discs.column("image_id"), "y": discs.column("y"), "x": discs.column("x"), **{k: pa.array(np.ascontiguousarray(out[:, i])) for i, k in enumerate("rgb")}})


def retouched(df: DataFrame, frames: DataFrame, spots: DataFrame) -> DataFrame:
    """Images (image_id, y, x, r, g, b from 0 to 1) after spots (image_id, nth, kind, x, y, source_x, source_y, radius, feather, opacity).

    Places are shares of the width and height, the radius one of the long edge; kind is heal or clone. Missing values are standard ones; spots
    without opacity or at their own source do nothing. Changed pixels have 16 bits. Spots of an image with one nth go in any order.
    """
    base = df.select("image_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    known = placed(spots, frames)
    known = written(known.groupBy("image_id").applyInArrow(_rounds, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields) + ", round int"))
    last = known.agg(F.max("round")).first()[0]
    changed = None
    for k in range(0 if last is None else last + 1):
        pixels = _over(base, changed)
        now = known.filter(F.col("round") == k)
        span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - F.col("r"))), F.least(F.col(n), F.ceil(F.col(c) + F.col("r"))) - 1)
        hits = now.filter("cx + r > 0 AND cy + r > 0 AND cx - r < width AND cy - r < height")
        disc = hits.withColumn("y", F.explode(span("cy", "height"))).withColumn("x", F.explode(span("cx", "width")))
        d = F.hypot(F.col("x") + 0.5 - F.col("cx"), F.col("y") + 0.5 - F.col("cy")) / F.col("r")
        disc = disc.withColumn("alpha", F.col("opacity") * _covered(d)).filter("alpha > 0")
        disc = disc.withColumns({"sx": F.col("x") + F.col("dx"), "sy": F.col("y") + F.col("dy")}).select("image_id", "nth", "y", "x", "cx", "cy", "r", "alpha", "sx", "sy")
        disc = gathered(disc, pixels, frames, {c: f"s{c}" for c in "rgb"}).join(pixels.select("image_id", "y", "x", *(F.col(c).alias(f"h{c}") for c in "rgb")), ["image_id", "y", "x"])
        disc = disc.withColumns({"_ty": F.floor(F.col("y") / SIZE), "_tx": F.floor(F.col("x") / SIZE)})
        # The edge of a spot, 128 rows at most, goes to each tile that its disc lies in.
        tiles = disc.select("image_id", "nth", "_ty", "_tx").distinct()
        ring = _edges(now, pixels, frames).join(tiles, ["image_id", "nth"])
        key = ["image_id", "nth", "_ty", "_tx"]
        fresh = disc.groupBy(*key).cogroup(apart(ring).groupBy(*key)).applyInArrow(_blended, "image_id long, y long, x long, r double, g double, b double")
        changed = written(fresh if changed is None else fresh.unionByName(changed.join(fresh.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti")))
    return _over(base, changed)


def _over(base: DataFrame, changed: DataFrame | None) -> DataFrame:
    """base with the changed pixels in place of its own."""
    if changed is None:
        return base
    held = base.join(changed.select("image_id", "y", "x", *(F.col(c).alias(f"_{c}") for c in "rgb")), ["image_id", "y", "x"], "left")
    return held.select("image_id", "y", "x", *(F.coalesce(f"_{c}", c).alias(c) for c in "rgb"))


def find_sources(df: DataFrame, frames: DataFrame, wanted: DataFrame, avoid: DataFrame | None = None) -> DataFrame:
    """image_id, nth, source_x, source_y (shares of the frame) and cost: the best of 72 places around each wanted spot (image_id, nth, x, y, radius).

    Its surroundings must look like the spot's, and its inside like them too. Places near the frame's edge, and those that meet a spot of avoid
    (image_id, x, y, radius), are left out; a spot without any place left has no row. Ties go to the nearer place, then to the first direction.
    """
    whole = lambda s: s.select("image_id", *(["nth"] if "nth" in s.columns else [F.lit(0).alias("nth")]), F.lit("heal").alias("kind"), "x", "y", F.when(F.col("x") < 0.5, 1.0).otherwise(0.0).alias("source_x"), F.col("y").alias("source_y"), "radius", F.lit(0.0).alias("feather"), F.lit(100.0).alias("opacity"))
    spots = placed(whole(wanted), frames).select("image_id", "nth", "cx", "cy", "r", "width", "height")
    turn = lambda i, n: i / n * (2 * math.pi)
    ways = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(DIRECTIONS * j + i).alias("way"), F.lit(math.cos(turn(i, DIRECTIONS)) * d).alias("u"), F.lit(math.sin(turn(i, DIRECTIONS)) * d).alias("v")) for j, d in enumerate(DISTANCES) for i in range(DIRECTIONS)))
    places = spots.withColumn("_w", F.explode(ways)).select("*", "_w.way", "_w.d", (F.col("cx") + F.col("_w.u") * F.col("r")).alias("px"), (F.col("cy") + F.col("_w.v") * F.col("r")).alias("py"))
    m = F.col("r") * MARGIN
    places = places.filter((F.col("px") >= m) & (F.col("py") >= m) & (F.col("px") <= F.col("width") - m) & (F.col("py") <= F.col("height") - m))
    if avoid is not None:
        others = placed(whole(avoid), frames).select("image_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("r").alias("ar"))
        meets = (places["image_id"] == others["image_id"]) & (F.hypot(F.col("ax") - F.col("px"), F.col("ay") - F.col("py")) < F.col("ar") + F.col("r"))
        places = places.join(others, meets, "left_anti")
    own = spots.withColumns({"way": F.lit(-1), "d": F.lit(0.0), "px": F.col("cx"), "py": F.col("cy")})
    ring = [(k, kind, math.cos(turn(i, n)) * s, math.sin(turn(i, n)) * s) for k, (kind, i, n, s) in enumerate([("around", i, RING, s) for s in RINGS for i in range(RING)] + [("inside", i, INSIDE, INNER) for i in range(INSIDE)])] + [(10**6, "inside", 0.0, 0.0)]
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("part"), F.lit(u).alias("u"), F.lit(v).alias("v")) for k, kind, u, v in ring))
    points = places.select(own.columns).unionByName(own).withColumn("_t", F.explode(taps)).filter("way >= 0 OR _t.part = 'around'")
    points = points.select("image_id", "nth", "way", "d", "px", "py", "width", "height", "_t.k", "_t.part", (F.col("px") + F.col("_t.u") * F.col("r") - 0.5).alias("sx"), (F.col("py") + F.col("_t.v") * F.col("r") - 0.5).alias("sy"))
    # Compared on square roots, which is closer to how differences look.
    got = gathered(points, df, frames, {c: f"_{c}" for c in "rgb"}).withColumns({f"_{c}": F.sqrt(f"_{c}") for c in "rgb"})
    mine = got.filter("way < 0")
    at = mine.select("image_id", "nth", "k", *(F.col(f"_{c}").alias(f"o{c}") for c in "rgb"))
    mean = mine.groupBy("image_id", "nth").agg(*(F.avg(f"_{c}").alias(f"o{c}") for c in "rgb"))
    theirs = got.filter("way >= 0")
    keys = ["image_id", "nth", "way", "d", "px", "py", "width", "height"]
    square = sum((F.col(f"_{c}") - F.col(f"o{c}")) * (F.col(f"_{c}") - F.col(f"o{c}")) for c in "rgb")
    parts = theirs.filter("part = 'around'").join(at, ["image_id", "nth", "k"]).groupBy(*keys).agg(F.avg(square).alias("c"))
    parts = parts.unionByName(theirs.filter("part = 'inside'").join(mean, ["image_id", "nth"]).groupBy(*keys).agg(F.avg(square).alias("c")))
    costs = parts.groupBy(*keys).agg((F.sum("c") * (1.0 + F.col("d") * FARTHER)).alias("cost"))
    best = Window.partitionBy("image_id", "nth").orderBy("cost", "way")
    costs = costs.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return costs.select("image_id", "nth", (F.col("px") / F.col("width")).alias("source_x"), (F.col("py") / F.col("height")).alias("source_y"), "cost")
