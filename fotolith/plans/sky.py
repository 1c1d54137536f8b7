"""Sky masks: the sky is found on a grid of cells by its look and its place, and its edges are moved onto the photo's.

Cells are aggregates over pixels. A photo's grid has about `grid_edge` cells along its long side (half as many again at most), whatever the photo's size, so that growing the
sky over it is bounded work for each photo; pixels are met again by a join with their own cell and refined tile by tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dust import labels
from .pixels import LUMA, decode, smoothstep
from .tiles import Tile, box, frames, on_tiles
from .written import written

# sky's least exposure value, or luminance where that isn't known; the least share; the largest hole; contrast and blue of twigs; steps in stops between cells and into twigs; steps in colour; blue skies and how bright others are; limits of colours; of smoothness; the filter's strength and radius; the ends of the final curve.
SKY_EV, SKY_LIGHT, MID_GREY, LEAST_SHARE, LARGEST_HOLE = 9.0, 0.3, 0.18, 0.015, 0.3
TWIG_CONTRAST, TWIG_BLUE, STEP, TWIG_STEP, COLOUR_STEP = 0.25, 0.1, 0.33, 0.6, 0.05
BLUE, GREY_BRIGHT, BRIGHTEST, GREEN, WARM, PINK, HOLE_GREEN, HOLE_WARM = 0.04, 0.55, 0.97, 0.02, 0.04, -0.04, 0.04, 0.1
SMOOTH, SMOOTH_BY_LUMA, TWIG_LOW, TWIG_SPAN, EPS, RADIUS_SHARE, LEAST_RADIUS, LOW, HIGH = 0.01, 0.03, 0.3, 0.5, 2e-3, 192, 2, 0.1, 0.9
DARKEST = 1e-6
NONE, OPEN, TWIGS = 0, 1, 2


def scene_ev(iso: Column, aperture: Column, shutter: Column) -> Column:
    """The exposure value at ISO 100 that a camera was set to; null where a setting is missing or not above 0."""
    known = (iso > 0) & (aperture > 0) & (shutter > 0)
    return F.when(known, F.log2(aperture * aperture / shutter) - F.log2(iso / 100.0))


def _luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def _fine(df: DataFrame, fine_edge: int, grid_edge: int) -> DataFrame:
    """Pixels averaged to about fine_edge along the long side, with their luma, their cell (cy, cx), its size and the grid's, and the filter's radius."""
    sizes = frames(df).withColumn("factor", F.greatest(F.lit(1), F.floor(F.greatest("width", "height") / F.lit(fine_edge) + 0.5)))
    sizes = sizes.withColumns({c: F.ceil(F.col(c) / F.col("factor")) for c in ("width", "height")}).withColumn("long", F.greatest("width", "height"))
    sizes = sizes.withColumn("cell", F.greatest(F.lit(1), F.floor(F.col("long") / F.lit(grid_edge) + 0.5)))
    held = df.join(sizes, "image_id").withColumns({c: F.floor(F.col(c) / F.col("factor")) for c in "yx"})
    held = held.groupBy("image_id", "y", "x", "width", "height", "long", "cell").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in "rgb"))
    within = {"cy": F.floor(F.col("y") / F.col("cell")), "cx": F.floor(F.col("x") / F.col("cell"))}
    grid = {"gh": F.ceil(F.col("height") / F.col("cell")), "gw": F.ceil(F.col("width") / F.col("cell"))}
    return held.withColumns({"luma": _luma(*map(F.col, "rgb")), "radius": F.greatest(F.floor(F.col("long") / RADIUS_SHARE), F.lit(LEAST_RADIUS)), **within, **grid})


def _cells(fine: DataFrame, exposures: DataFrame | None) -> DataFrame:
    """A row for each cell: what it could be (kind), its colour and light as such and as a whole, and the lumas of its dark and its bright quarter."""
    pixel = F.struct("luma", "y", "x", "r", "g", "b")
    # A cell holds cell * cell pixels at most, some 16.
    held = fine.groupBy("image_id", "cy", "cx").agg(F.sort_array(F.collect_list(pixel)).alias("p"), F.stddev_pop("luma").alias("texture"))
    quarter = F.ceil(F.size("p") / F.lit(4)).cast("int")
    parts = {"all": F.col("p"), "dark": F.slice("p", F.lit(1), quarter), "bright": F.slice("p", F.size("p") - quarter + 1, quarter)}
    mean = lambda part, c: F.aggregate(part, F.lit(0.0), lambda s, v: s + v[c]) / F.size(part)
    held = held.select("image_id", "cy", "cx", "texture", *(mean(part, c).alias(f"{c}_{k}") for k, part in parts.items() for c in ("r", "g", "b", "luma")))
    held = held.withColumns({f"light_{k}": _luma(*(decode(F.col(f"{c}_{k}")) for c in "rgb")) for k in parts})
    held = held.withColumn("ev", F.lit(None).cast("double")) if exposures is None else held.join(exposures.select("image_id", F.col("scene_ev").cast("double").alias("ev")), "image_id", "left")

    def like_sky(k: str) -> Column:
        r, g, b, light = (F.col(f"{c}_{k}") for c in ("r", "g", "b", "light"))
        stops = F.col("ev") + F.log2(F.greatest(light, F.lit(DARKEST)) / MID_GREY)
        bright = F.when(F.col("ev").isNull(), light >= SKY_LIGHT).otherwise(stops >= SKY_EV)
        return bright & (g - F.greatest(r, b) < GREEN) & (r - b < WARM) & (g - r > PINK)

    smooth = F.col("texture") <= SMOOTH + SMOOTH_BY_LUMA * F.col("luma_all")
    contrast = F.log2(F.greatest("light_bright", F.lit(DARKEST)) / F.greatest("light_dark", F.lit(DARKEST)))
    twigs = like_sky("bright") & (contrast >= TWIG_CONTRAST) & (F.col("b_dark") - F.col("r_dark") < TWIG_BLUE)
    held = held.withColumn("kind", F.when(smooth & like_sky("all"), OPEN).when(twigs, TWIGS).otherwise(NONE))
    tone = {f"{c}_sky": F.when(F.col("kind") == TWIGS, F.col(f"{c}_bright")).otherwise(F.col(f"{c}_all")) for c in ("r", "g", "b", "light")}
    return held.withColumns({**tone, "known": F.col("ev").isNotNull()})


def _spread(kind: np.ndarray, tone: dict[str, np.ndarray]) -> np.ndarray:
    """The cells that the sky reaches from the top edge, over steps between neighbours that are small in colour and brightness."""
    h, w = kind.shape
    stops = np.log2(np.maximum(tone["light"], DARKEST))
    warmth, green = tone["r"] - tone["b"], tone["g"] - (tone["r"] + tone["b"]) / 2
    darker = np.where(kind == TWIGS, TWIG_STEP, STEP)
    above, below, left, right = np.s_[:-1, :], np.s_[1:, :], np.s_[:, :-1], np.s_[:, 1:]
    ways = []
    for a, b, shift in ((above, below, w), (below, above, -w), (left, right, 1), (right, left, -1)):
        brighter = stops[b] - stops[a]
        near = np.abs(warmth[b] - warmth[a]) + np.abs(green[b] - green[a]) <= COLOUR_STEP
        free = np.zeros((h, w), bool)
        free[a] = (kind[b] != NONE) & near & (brighter <= STEP) & (brighter >= -darker[b])
        ways.append((free.ravel(), shift))
    sky, front = np.zeros(h * w, bool), np.flatnonzero(kind[0] != NONE)
    while len(front):
        sky[front] = True
        ahead = np.concatenate([front[free[front]] + shift for free, shift in ways])
        front = np.unique(ahead[~sky[ahead]])
    return sky.reshape(h, w)


def _quantile(values: np.ndarray, p: float) -> float:
    at = int(np.floor((len(values) - 1) * p + 0.5))
    return float(np.partition(values, at)[at])


def _believed(sky: np.ndarray, tone: dict[str, np.ndarray], light: np.ndarray, known: bool) -> bool:
    """Whether what was reached is large enough and blue, or, with a known exposure, among the brightest of the photo."""
    if not sky.any() or sky.sum() < LEAST_SHARE * sky.size:
        return False
    if (tone["b"][sky] - tone["r"][sky]).mean() >= BLUE:
        return True
    return known and _quantile(tone["light"][sky], 0.5) >= GREY_BRIGHT * _quantile(light.ravel(), BRIGHTEST)


def _holes(sky: np.ndarray, colour: dict[str, np.ndarray]) -> np.ndarray:
    """The cells of regions that the sky encloses: not too large, away from the bottom, neither green nor warm."""
    outside = ~sky
    if not outside.any():
        return outside
    names, region = np.unique(labels(outside)[outside], return_inverse=True)
    n = np.bincount(region)
    r, g, b = (np.bincount(region, colour[c][outside]) / n for c in "rgb")
    filled = (n <= int(LARGEST_HOLE * sky.size)) & (g - np.maximum(r, b) < HOLE_GREEN) & (r - b < HOLE_WARM)
    bottom = np.zeros(sky.shape, bool)
    bottom[-1] = True
    filled[region[bottom[outside]]] = False
    out = np.zeros(sky.shape, bool)
    out[outside] = filled[region]
    return out


def _grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The grid of a photo to its cells' kinds, with a bit for each of the nine cells around (and at) each that is open sky; no rows where there is no sky."""
    y, x = (table.column(c).to_numpy() for c in ("cy", "cx"))
    h, w = y.max() + 1, x.max() + 1

    def plane(c: str) -> np.ndarray:
        out = np.zeros((h, w))
        out[y, x] = table.column(c).to_numpy(zero_copy_only=False)
        return out

    kind = plane("kind").astype(int)
    tone, colour = ({c: plane(f"{c}_{k}") for c in ("r", "g", "b", "light")} for k in ("sky", "all"))
    sky = _spread(kind, tone)
    if not _believed(sky, tone, colour["light"], table.column("known")[0].as_py()):
        y, x = y[:0], x[:0]
    kind = np.where(sky, kind, np.where(_holes(sky, colour), OPEN, NONE))
    wide = np.pad(kind == OPEN, 1, mode="edge")
    bits = sum(wide[i : i + h, j : j + w].astype(np.int32) << (3 * i + j) for i in range(3) for j in range(3))
    return pa.table({"image_id": pa.array(np.full(len(y), key[0].as_py(), np.int64)), "cy": pa.array(y), "cx": pa.array(x), "kind": pa.array(kind[y, x].astype(np.int32)), "bits": pa.array(bits[y, x])})


def _prior(met: DataFrame) -> DataFrame:
    """Each pixel's share of sky by its cells: open sky blended between their centres, and among twigs by the pixel's brightness."""
    at = {c: F.greatest(F.lit(0.0), F.least(F.col(g) - 1.0, (F.col(c) + 0.5) / F.col("cell") - 0.5)) for c, g in (("y", "gh"), ("x", "gw"))}
    met = met.withColumns({f"_{c}": v for c, v in at.items()})
    met = met.withColumns({f"_{c}0": (F.floor(f"_{c}") - F.col(f"c{c}") + 1).cast("int") for c in "yx"} | {f"_t{c}": F.col(f"_{c}") - F.floor(f"_{c}") for c in "yx"})
    bit = lambda i, j: F.bit_get("bits", (F.col("_y0") + i) * 3 + F.col("_x0") + j).cast("double")
    line = lambda i: bit(i, 0) + (bit(i, 1) - bit(i, 0)) * F.col("_tx")
    blended = line(0) + (line(1) - line(0)) * F.col("_ty")
    lit = (F.col("luma") - F.col("luma_dark")) / F.greatest(F.col("luma_bright") - F.col("luma_dark"), F.lit(1e-3))
    return met.withColumn("prior", F.when(F.col("kind") == TWIGS, F.greatest(blended, smoothstep(TWIG_LOW, TWIG_LOW + TWIG_SPAN, lit))).otherwise(blended))


def _refined(t: Tile) -> dict[str, np.ndarray]:
    """The prior with its edges where the photo's luma has them, as codes of 8 bits."""
    r, guide, prior = int(t.given["radius"]), t.planes["luma"], t.planes["prior"]
    mean, share = box(guide, r), box(prior, r)
    a = (box(guide * prior, r) - mean * share) / (np.maximum(box(guide * guide, r) - mean * mean, 0) + EPS)
    v = t.own(box(a, r) * guide + box(share - a * mean, r))
    v = np.clip((v - LOW) / (HIGH - LOW), 0, 1)
    y, x = t.places()
    return {"y": y, "x": x, "coverage": np.floor(v * v * (3 - 2 * v) * 255 + 0.5).astype(np.int64)}


def sky_masks(df: DataFrame, exposures: DataFrame | None = None, fine_edge: int = 1536, grid_edge: int = 384) -> DataFrame:
    """image_id, y, x and coverage (0 to 255) of the sky; null at all pixels of photos without one.

    df holds whole photos (image_id, y, x, r, g, b as encoded for sRGB, from 0 to 1) of any sizes; other columns are ignored. exposures
    (image_id, scene_ev) tells how bright mid-grey was; without it, or where it is null, only bright blue skies are found. Photos
    longer than fine_edge get masks of about that size. No photos give no rows.
    """
    # Both are read more than once.
    fine = written(_fine(df.select("image_id", "y", "x", "r", "g", "b"), fine_edge, grid_edge))
    cells = written(_cells(fine, exposures).drop("texture", "ev"))
    of = ["image_id", "cy", "cx", "kind", "known", *(f"{c}_{k}" for k in ("sky", "all") for c in ("r", "g", "b", "light"))]
    grown = cells.select(*of).groupBy("image_id").applyInArrow(_grown, "image_id long, cy long, cx long, kind int, bits int")
    tones = cells.select(*(F.col(c).alias(c) for c in ("image_id", "cy", "cx", "luma_dark", "luma_bright")))
    met = fine.join(grown.join(tones, ["image_id", "cy", "cx"]), ["image_id", "cy", "cx"])
    masks = written(on_tiles(_prior(met), ["luma", "prior"], _refined, "y int, x int, coverage int", F.col("radius") * 2, given=["radius"]))
    found = masks.groupBy("image_id").agg(F.avg("coverage").alias("mean")).filter(F.col("mean") >= LEAST_SHARE * 255).select("image_id")
    bare = fine.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(None).cast("int").alias("coverage"))
    return masks.join(found, "image_id", "left_semi").unionByName(bare.join(found, "image_id", "left_anti"))
