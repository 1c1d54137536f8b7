"""Colour fringes: red and blue images that a lens makes larger or smaller than the green one, measured from photos and undone.

The scales are found by Gauss-Newton steps, for all images together: each tile gives its part of the normal equations, tiles that fit
badly weigh less, and the sums of an image are solved for its next step. A round is one join of the tiles with their image's scales.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import gathered
from .tiles import Tile, box, frames, on_tiles
from .written import written

# The largest coefficient, tiles and their least edges, what counts as clipped, and when a tile or a fit counts.
LARGEST, SIZE, OFFSET, CLIPPED, ENERGY, CORRELATION, CONTRAST, TILES, STEPS, ENOUGH, RIDGE = 0.005, 32, 1 / 64, 63000 / 65535, 0.002, 0.9, (0.5, 2.0), 16, 8, 0.01, 1e-3
#: A blur of one pixel twice less one of six twice.
REACH = 2 + 12
PLANES = ("r", "g", "b")
#: Tiles that blocks are read from, and what is said of a block: its half (0 or 1), its image's size, where the contrasts begin and how many they are, its own place, and the contrasts as bytes of doubles.
TILE = 4 * SIZE
BLOCKS = "half int, width long, height long, y0 long, x0 long, rows int, cols int, top int, left int, r binary, g binary, b binary"
#: Open fits that are sent to all blocks; more of them are joined.
FEW = 50_000
#: Blocks are some 40 KB each; so much of them is written and read at once.
GROUP = 8 << 20


def _half(width: Column, height: Column) -> Column:
    return F.sqrt(width * width + height * height) / 2.0


def reach_of(width: Column, height: Column) -> Column:
    """How far around a block the scales can reach: the corner moves by both coefficients at most."""
    return F.ceil(_half(width, height) * (2 * LARGEST)).cast("int") + 3


def _contrast(plane: np.ndarray) -> np.ndarray:
    """A channel's contrast around each pixel; unknown (nan) where a pixel in reach is."""
    gone = np.isnan(plane)
    fine = box(np.log2(np.where(gone, 0.0, plane) + OFFSET), 1, 2)
    out = fine - box(fine, 6, 2)
    if gone.any():
        out[box(gone.astype(float), REACH) > 1e-9] = np.nan
    return out


def blocks(t: Tile) -> dict[str, list]:
    """The rows of BLOCKS that a tile has: its usable blocks, with the red and blue contrasts that shifts can reach around them and the green ones one pixel around.

    Blocks begin at multiples of SIZE. The tile says width, height and reach of its image and has the pixels in REACH + reach around its own; where lines
    are missing at its edge, blocks that look at them are left out.
    """
    width, height, reach = (int(t.given[c]) for c in ("width", "height", "reach"))
    clipped = np.maximum.reduce([t.planes[c] for c in PLANES]) >= CLIPPED
    bands = {c: _contrast(t.planes[c]) for c in PLANES}
    out: dict[str, list] = {n.split()[0]: [] for n in BLOCKS.split(", ")}
    starts = []
    for s, first, n, size in zip(t.core, (t.y0, t.x0), bands["g"].shape, (height, width), strict=True):
        each = range(-(-(s.start + first) // SIZE) * SIZE, s.stop + first, SIZE)
        starts.append([k for k in each if 0 < k < size - 2 * SIZE and max(0, k - reach) >= first and min(size, k + SIZE + reach) <= first + n])
    for top in starts[0]:
        for left in starts[1]:
            part = lambda p, k, top=top, left=left: p[max(0, top - k) - t.y0 : top + SIZE + k - t.y0, max(0, left - k) - t.x0 : left + SIZE + k - t.x0]
            g = part(bands["g"], 0)
            if part(clipped, 0).any() or not (g**2).mean() >= ENERGY:
                continue
            around = {c: part(bands[c], reach) for c in ("r", "b")}
            said = (top // SIZE + left // SIZE) % 2, width, height, max(0, top - reach), max(0, left - reach), *around["r"].shape, top, left
            for n, v in zip(out, (*said, around["r"].tobytes(), part(bands["g"], 1).tobytes(), around["b"].tobytes()), strict=True):
                out[n].append(v)
    return out


def _blocks_of(df: DataFrame, sized: DataFrame) -> DataFrame:
    """image_id and BLOCKS of images (image_id, y, x, r, g, b)."""
    held = df.join(sized.withColumn("reach", reach_of(F.col("width"), F.col("height"))), "image_id")
    # Tiles are as large as what lies around them, and whole blocks.
    reach = F.col("reach") + REACH
    reach = F.when(reach > TILE, F.ceil(reach / SIZE) * SIZE).otherwise(reach)
    return on_tiles(held, list(PLANES), blocks, BLOCKS, reach, TILE, given=["width", "height", "reach"])


def _between(p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    y, x = np.clip(y, 0, p.shape[0] - 1.0), np.clip(x, 0, p.shape[1] - 1.0)
    iy, ix = y.astype(np.int64), x.astype(np.int64)
    jy, jx = np.minimum(iy + 1, p.shape[0] - 1), np.minimum(ix + 1, p.shape[1] - 1)
    top, low = p[iy, ix] + (p[iy, jx] - p[iy, ix]) * (x - ix), p[jy, ix] + (p[jy, jx] - p[jy, ix]) * (x - ix)
    return top + (low - top) * (y - iy)


def _step(c: np.ndarray, around: np.ndarray, top: int, left: int, y0: int, x0: int, width: int, height: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float, float]:
    """A block's part of the normal equations (4 by 4, and 4), and the sums of its squares."""
    y, x = (np.arange(t - 1, t + SIZE + 1, dtype=float) for t in (top, left))
    y, x = np.meshgrid(y, x, indexing="ij")
    r = np.hypot(width, height) / 2
    ux, uy = (x + 0.5 - width / 2) / r, (y + 0.5 - height / 2) / r
    rho = ux * ux + uy * uy
    s = theta[0] + theta[1] * rho
    warped = _between(c, y + s * uy + theta[3] - y0, x + s * ux + theta[2] - x0)
    cv, gv = warped[1:-1, 1:-1], around[1:-1, 1:-1]
    gg, cc, gc = (gv * gv).sum(), (cv * cv).sum(), (gv * cv).sum()
    k = gc / max(gg, 1e-12)  # an edge of another height mustn't read as a shifted one
    jx = 0.25 * (k * (around[1:-1, 2:] - around[1:-1, :-2]) + warped[1:-1, 2:] - warped[1:-1, :-2])
    jy = 0.25 * (k * (around[2:, 1:-1] - around[:-2, 1:-1]) + warped[2:, 1:-1] - warped[:-2, 1:-1])
    ux, uy, rho = ux[1:-1, 1:-1], uy[1:-1, 1:-1], rho[1:-1, 1:-1]
    radial = jx * ux + jy * uy
    phi = np.stack([radial, radial * rho, jx, jy]).reshape(4, -1)
    rest = (k * gv - cv).ravel()
    return phi @ phi.T, phi @ rest, gg, cc, gc, (rest * rest).sum()


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """image_id, fit, channel, error and the normal equations of blocks that match, from blocks with their image's open fits."""
    for b in batches:
        out: dict[str, list] = {c: [] for c in ("image_id", "fit", "channel", "error", "a", "v")}
        for row in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
            g = np.frombuffer(row["g"]).reshape(SIZE + 2, SIZE + 2)
            for f in row["fits"]:
                if f["fit"] not in (2, row["half"]):
                    continue
                c = np.frombuffer(row[f["channel"]]).reshape(row["rows"], row["cols"])
                a, v, gg, cc, gc, rr = _step(c, g, row["top"], row["left"], row["y0"], row["x0"], row["width"], row["height"], np.array(f["theta"]))
                if gc / max(np.sqrt(gg * cc), 1e-12) >= CORRELATION and CONTRAST[0] <= cc / max(gg, 1e-12) <= CONTRAST[1]:
                    for n, value in zip(out, (row["image_id"], f["fit"], f["channel"], float(np.sqrt(rr / max(cc, 1e-12))), a.ravel(), v), strict=True):
                        out[n].append(value)
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next scales of each fit; null where its equations have no solution."""
    for b in batches:
        theta, still = [], []
        for row in b.to_pylist():
            a, v = np.array(row["a"]).reshape(4, 4), np.array(row["v"])
            a[1, 1] += RIDGE * np.trace(a)  # without edges at many radii the second term stays near 0
            try:
                delta = np.linalg.solve(a, v)
            except np.linalg.LinAlgError:
                theta.append(None)
                still.append(False)
                continue
            theta.append(np.array(row["theta"]) + delta)
            still.append(bool(abs(delta[0]) + abs(delta[1]) >= ENOUGH))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(theta, pa.list_(pa.float64())), pa.array(still, pa.bool_())], ["image_id", "fit", "channel", "theta", "still"])


def _fitted(held: DataFrame, start: DataFrame, least: int) -> DataFrame:
    """image_id, fit, channel and theta after the steps; start has them, fit 0 and 1 for halves of the blocks and 2 for all. Fits with too few matching blocks are left out."""
    state = written(start.withColumn("still", F.lit(True)))
    for _ in range(STEPS):
        open_ = state.filter("still").drop("still")
        n = open_.count()
        if not n:
            break
        fits = open_.groupBy("image_id").agg(F.collect_list(F.struct("fit", "channel", "theta")).alias("fits"))  # four at most
        asked = held.join(F.broadcast(fits) if n <= FEW else fits, "image_id")
        parts = written(asked.mapInArrow(_steps, "image_id long, fit int, channel string, error double, a array<double>, v array<double>"))
        key = ["image_id", "fit", "channel"]
        w = Window.partitionBy(*key)
        ranked = parts.withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("error"))})
        middle = ranked.filter("nth = n div 2 + 1").filter(F.col("n") >= F.when(F.col("fit") == 2, 2 * least).otherwise(least)).select(*key, (F.col("error") * 2.0).alias("k"))
        weighed = parts.join(middle, key).withColumn("w", F.when(F.col("error") <= F.col("k"), 1.0).otherwise(F.col("k") / F.col("error")))
        sums = weighed.groupBy(*key).agg(F.array(*(F.sum(F.col("w") * F.get("a", F.lit(i))) for i in range(16))).alias("a"), F.array(*(F.sum(F.col("w") * F.get("v", F.lit(i))) for i in range(4))).alias("v"))
        fresh = sums.join(open_, key).select(*key, "a", "v", "theta").mapInArrow(_solved, "image_id long, fit int, channel string, theta array<double>, still boolean")
        kept = state.filter("NOT still")
        state = written(kept.unionByName(fresh.filter("theta IS NOT NULL")))
    return state.drop("still")


def measured(df: DataFrame) -> DataFrame:
    """image_id, red_a, red_b, blue_a, blue_b (scales 1 + a + b ρ² about the centre), and by channel the shift at the corner in pixels and how far two halves of the photo differ on it.

    Images (image_id, y, x, r, g, b from 0 to 1) under 128 pixels either way, or with too few blocks in which the channels match, have no row.
    """
    sized = frames(df).filter((F.col("width") >= 4 * SIZE) & (F.col("height") >= 4 * SIZE))
    return _measured(_blocks_of(df, sized))


def _measured(rows: DataFrame) -> DataFrame:
    """The same from image_id and BLOCKS."""
    held = written(rows, GROUP)
    ways = F.array(*(F.struct(F.lit(k).alias("fit"), F.lit(c).alias("channel")) for k in (0, 1) for c in "rb"))
    sized = held.select("image_id", "width", "height").distinct()
    start = sized.select("image_id").withColumn("_w", F.explode(ways)).select("image_id", "_w.*", F.array(*(F.lit(0.0) for _ in range(4))).alias("theta"))
    halves = _fitted(held, start, TILES)
    pair = halves.groupBy("image_id", "channel").agg(F.max(F.when(F.col("fit") == 0, F.col("theta"))).alias("p"), F.max(F.when(F.col("fit") == 1, F.col("theta"))).alias("q")).filter("p IS NOT NULL AND q IS NOT NULL")
    pair = written(pair)
    corner = lambda t: F.get(t, F.lit(0)) + F.get(t, F.lit(1))
    whole = _fitted(held, pair.select("image_id", F.lit(2).alias("fit"), "channel", F.transform(F.arrays_zip("p", "q"), lambda z: (z["p"] + z["q"]) / 2.0).alias("theta")), TILES)
    each = whole.join(pair, ["image_id", "channel"]).join(sized, "image_id")
    r = _half(F.col("width"), F.col("height"))
    tidy = lambda k: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.round(F.get("theta", F.lit(k)) / r, 6))) + 0.0
    each = each.select("image_id", "channel", tidy(0).alias("a"), tidy(1).alias("b"), corner("theta").alias("shift"), F.abs(corner("p") - corner("q")).alias("spread"))
    out = each.groupBy("image_id").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{name}_{v}") for c, name in (("r", "red"), ("b", "blue")) for v in ("a", "b", "shift", "spread")))
    return out.filter("_n = 2").drop("_n")


def estimated(df: DataFrame) -> DataFrame:
    """measured(), only where both halves agree well enough for the shift."""
    return _agreeing(measured(df))


def estimated_from(rows: DataFrame) -> DataFrame:
    """The same from image_id and BLOCKS, for images that tasks make or read by tiles."""
    return _agreeing(_measured(rows))


def _agreeing(found: DataFrame) -> DataFrame:
    sure = lambda c: F.col(f"{c}_spread") <= 0.2 + F.abs(f"{c}_shift") / 3.0
    return found.filter(sure("red") & sure("blue"))


def applied(df: DataFrame, sized: DataFrame, scales: DataFrame) -> DataFrame:
    """Images (image_id, y, x, r, g, b) with red and blue scaled to the green one; those without scales (image_id, red_a, red_b, blue_a, blue_b) stay as they are."""
    clean = lambda c: F.when(F.col(c).isNull() | F.isnan(c), 0.0).otherwise(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col(c)))).alias(c)
    known = scales.select("image_id", *map(clean, ("red_a", "red_b", "blue_a", "blue_b"))).join(sized, "image_id")
    points = df.join(known, "image_id")
    dx, dy = F.col("x") + 0.5 - F.col("width") / 2.0, F.col("y") + 0.5 - F.col("height") / 2.0
    rho = (dx * dx + dy * dy) / ((F.col("width") * F.col("width") + F.col("height") * F.col("height")) / 4.0)
    for c, name in (("r", "red"), ("b", "blue")):
        s = F.col(f"{name}_a") + F.col(f"{name}_b") * rho
        points = gathered(points.withColumns({"sx": F.col("x") + dx * s, "sy": F.col("y") + dy * s}), df, sized, {c: f"_{c}"}).drop("sx", "sy")
    out = points.select("image_id", "y", "x", F.col("_r").alias("r"), "g", F.col("_b").alias("b"))
    return out.unionByName(df.select("image_id", "y", "x", "r", "g", "b").join(known.select("image_id"), "image_id", "left_anti"))
