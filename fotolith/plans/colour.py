"""Stages on colour by a pixel's own values: curves, mixer, grading, grain, white balance, range masks, colour spaces."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .pixels import LUMA, Stage, Steps, Triple, clamp, decode, each, encode, luma, oklab, rgb, smoothstep

# Fixed values of the stages.
MOST_POINTS, LEAST_GAP, REACH = 16, 0.01, 0.45
BAND_HUES = (0.0, 30.0, 60.0, 120.0, 180.0, 225.0, 270.0, 300.0)
HUE_DEGREES, NEUTRAL_FADE = 30.0, (0.04, 0.2)
GRADE_CHROMA, GRADE_LIGHTNESS, MIDDLE_GREY, GRADE_K, GRADE_GAIN = 0.10, 0.12, 0.5646, 3.0, 4.0
SHADOW_TINT_STRENGTH, SHADOW_TINT_BLENDING = 0.6, 25.0
GRAIN_CELLS, GRAIN_STOPS = 1500.0, 0.35
MIRED_PER_UNIT, DUV_PER_UNIT, LEAST_KELVIN, MOST_KELVIN, MOST_DUV = 1.2, 1 / 3000, 1667.0, 25000.0, 0.05
NEAREST, FURTHEST, CORE = 0.02, 0.26, 0.4
D65 = (0.3127, 0.3290)
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
REC2020_TO_RGB = ((1.660491, -0.587641, -0.07285), (-0.12455, 1.1329, -0.008349), (-0.018151, -0.100579, 1.11873))
OKLAB_TO_LMS = ((1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855))
LMS_TO_RGB = ((4.0767417, -3.3077116, 0.23096993), (-1.268438, 2.6097574, -0.3413194), (-0.0041960863, -0.7034186, 1.7076147))


def product(m: Sequence[Sequence[float]], v: Triple) -> Triple:
    """A matrix by a triple of columns."""
    return tuple(v[0] * a + v[1] * b + v[2] * c for a, b, c in m)


# Curves.


@dataclass(frozen=True)
class Curve:
    """A monotone cubic through points (input, output), as display tones; flat outside them."""

    points: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))

    @staticmethod
    def through(points: Sequence[Sequence[float]]) -> Curve:
        """Points in range, rounded, sorted and apart; the diagonal if fewer than two are left."""
        near = lambda v: math.floor(min(1.0, max(0.0, v)) * 10_000 + 0.5) / 10_000
        kept: list[tuple[float, float]] = []
        for x, y in sorted(((near(x), near(y)) for x, y in points if math.isfinite(x) and math.isfinite(y)), key=lambda p: p[0]):
            if len(kept) < MOST_POINTS and (not kept or x - kept[-1][0] >= LEAST_GAP - 1e-6):
                kept.append((x, y))
        return Curve(tuple(kept)) if len(kept) > 1 else Curve()

    @property
    def plain(self) -> bool:
        """Whether it changes nothing."""
        return self.points[0] == (0, 0) and self.points[-1] == (1, 1) and all(abs(x - y) < 1e-6 for x, y in self.points)

    def tangents(self) -> list[float]:
        """Slopes at the points: harmonic means of the slopes beside, weighted by the gaps; 0 where the curve turns."""
        gaps = [b[0] - a[0] for a, b in zip(self.points, self.points[1:])]
        slopes = [(b[1] - a[1]) / h for a, b, h in zip(self.points, self.points[1:], gaps)]
        inner = [0.0 if s * t <= 0 else 3 * (g + h) / ((2 * h + g) / s + (h + 2 * g) / t) for s, t, g, h in zip(slopes, slopes[1:], gaps, gaps[1:])]
        return [slopes[0], *inner, slopes[-1]]

    def at(self, x: Column) -> Column:
        m = self.tangents()
        out = F.lit(self.points[-1][1])
        for (x0, y0), (x1, y1), m0, m1 in reversed([*zip(self.points, self.points[1:], m, m[1:])]):
            h = x1 - x0
            t = (x - x0) / h
            # The cubic by its powers: y0 + h m0 t + c t^2 + d t^3.
            c, d = 3 * (y1 - y0) - h * (2 * m0 + m1), 2 * (y0 - y1) + h * (m0 + m1)
            out = F.when(x < x1, clamp(y0 + t * (h * m0 + t * (c + t * d)))).otherwise(out)
        return F.when(x <= self.points[0][0], self.points[0][1]).otherwise(out)


def parametric(shadows: float = 0, darks: float = 0, lights: float = 0, highlights: float = 0, splits: tuple[float, float, float] = (25, 50, 75)) -> Curve:
    """Regions of tones, each with its middle moved by a slider of -100 to 100."""
    s1 = min(85.0, max(5.0, splits[0]))
    s2 = min(90.0, max(s1 + 5, splits[1]))
    s3 = min(95.0, max(s2 + 5, splits[2]))
    edges = (0.0, s1 / 100, s2 / 100, s3 / 100, 1.0)
    middles = [((a + b) / 2, (a + b) / 2 + min(100.0, max(-100.0, v)) / 100 * REACH * (b - a)) for a, b, v in zip(edges, edges[1:], (shadows, darks, lights, highlights))]
    return Curve.through([(0, 0), *middles, (1, 1)])


def curves(whole: Curve = Curve(), regions: Curve = Curve(), channels: tuple[Curve, Curve, Curve] = (Curve(), Curve(), Curve())) -> Stage:
    """The regions' curve, then the one of all channels, then each channel's own, on display tones."""

    def stage(t: Triple) -> Triple:
        out = []
        for c, own in zip(t, channels, strict=True):
            v = encode(clamp(c))
            for curve in (regions, whole, own):
                v = v if curve.plain else curve.at(v)
            out.append(decode(v))
        return tuple(out)

    return stage


# Mixer and grading.


def mixer(bands: Sequence[tuple[float, float, float]]) -> Steps:
    """Hue, saturation and luminance (-100 to 100) of the colours around BAND_HUES, blended between neighbours."""

    def blended(hue: Column, k: int) -> Column:
        out = F.lit(0.0)
        for i, low in enumerate(BAND_HUES):
            a, b = bands[i][k], bands[(i + 1) % len(bands)][k]
            high = BAND_HUES[i + 1] if i + 1 < len(BAND_HUES) else 360.0
            out = F.when((hue >= low) & (hue < high), F.lit(float(a)) if a == b else a + (b - a) * smoothstep(low, high, hue)).otherwise(out)
        return out

    def over(df: DataFrame) -> DataFrame:
        t, p = rgb(), tuple(F.col(f"_p{i}") for i in range(3))
        top, span = F.col("_top"), F.col("_span")
        df = df.withColumns({f"_p{i}": F.sqrt(F.greatest(F.col(c), F.lit(0.0))) for i, c in enumerate("rgb")})
        df = df.withColumn("_top", F.greatest(*p)).withColumn("_span", top - F.least(*p))
        raw = F.when(top == p[0], (p[1] - p[2]) / span).when(top == p[1], (p[2] - p[0]) / span + 2.0).otherwise((p[0] - p[1]) / span + 4.0) * 60.0
        grey = (top <= 1e-6) | (span <= 0)
        df = df.withColumn("_raw", F.when(grey, 0.0).otherwise(raw)).withColumn("_hue", F.when(F.col("_raw") < 0, F.col("_raw") + 360.0).otherwise(F.col("_raw")))
        hue = F.col("_hue")
        moves = {"_turn": F.radians(blended(hue, 0) / 100.0 * HUE_DEGREES), "_chroma": 1.0 + blended(hue, 1) / 100.0, "_gain": F.pow(F.lit(2.0), blended(hue, 2) / 100.0)}
        df = df.withColumns({**moves, "_fade": F.when(grey, 0.0).otherwise(smoothstep(*NEUTRAL_FADE, span / top)), "_mean": (p[0] + p[1] + p[2]) / 3.0})
        k = 1 / math.sqrt(3)
        turned = {f"_o{i}": F.col("_mean") + ((p[i] - F.col("_mean")) * F.cos("_turn") + (p[(i + 2) % 3] - p[(i + 1) % 3]) * k * F.sin("_turn")) * F.col("_chroma") for i in range(3)}
        df = df.withColumns(turned).withColumns({f"_s{i}": F.col(f"_o{i}") * F.abs(f"_o{i}") for i in range(3)})
        df = df.withColumn("_y", luma(tuple(F.col(f"_s{i}") for i in range(3))))
        df = df.withColumn("_scale", F.when(F.col("_y") > 1e-9, luma(t) / F.col("_y")).otherwise(1.0) * F.col("_gain"))
        out = {c: F.col(c) + (F.col(f"_s{i}") * F.col("_scale") - F.col(c)) * F.col("_fade") for i, c in enumerate("rgb")}
        return df.withColumns(out).drop(*(f"_{n}{i}" for n in "pos" for i in range(3)), *moves, "_top", "_span", "_raw", "_hue", "_fade", "_mean", "_y", "_scale")

    return Steps(over)


def _toward(hue: float) -> tuple[float, float]:
    """The unit direction in Oklab of a hue in degrees, as of the full colour of that hue."""
    h = hue % 360 / 60
    x = 1 - abs(h % 2 - 1)
    full = [(1, x, 0), (x, 1, 0), (0, 1, x), (0, x, 1), (x, 0, 1), (1, 0, x)][min(5, int(h))]
    r, g, b = (v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4 for v in full)
    lms = [(m[0] * r + m[1] * g + m[2] * b) ** (1 / 3) for m in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    a, b = (sum(x * y for x, y in zip(m, lms, strict=True)) for m in ((1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)))
    n = max(1e-6, math.hypot(a, b))
    return a / n, b / n


def grading(shadows=(0, 0, 0), midtones=(0, 0, 0), highlights=(0, 0, 0), whole=(0, 0, 0), blending: float = 50.0, balance: float = 0.0) -> Steps:
    """Wheels of (hue in degrees, saturation 0 to 100, luminance -100 to 100) on ranges of lightness: what they do to a grey is done to each pixel."""
    wheels = (shadows, midtones, highlights, whole)
    moves = [(l / 100 * GRADE_LIGHTNESS, *(s / 100 * GRADE_CHROMA * d for d in _toward(h))) for h, s, l in wheels]
    bend = math.log(0.5) / math.log(MIDDLE_GREY - balance / 100 * 0.25)
    k = GRADE_K * 2 ** ((50 - blending) / 50)

    def over(df: DataFrame) -> DataFrame:
        df = df.withColumn("_l", clamp(F.cbrt(F.greatest(luma(rgb()), F.lit(0.0))))).withColumn("_x", F.pow("_l", F.lit(bend)))
        df = df.withColumn("_dark", F.pow(1.0 - F.col("_x"), F.lit(k))).withColumn("_bright", F.pow("_x", F.lit(k)))
        weights = (F.col("_dark"), F.greatest(F.lit(0.0), 1.0 - F.col("_dark") - F.col("_bright")), F.col("_bright"), F.lit(1.0))
        df = df.withColumns({f"_d{n}": sum((w * m[i] for w, m in zip(weights[1:], moves[1:], strict=True)), weights[0] * moves[0][i]) for i, n in enumerate("lab")})
        df = df.withColumn("_up", F.greatest(F.col("_l") + F.col("_dl"), F.lit(0.0))).withColumn("_grey", F.col("_l") * F.col("_l") * F.col("_l"))
        df = df.withColumn("_gain", F.when(F.col("_grey") > 0, F.least(F.col("_up") * F.col("_up") * F.col("_up") / F.col("_grey"), F.lit(GRADE_GAIN))).otherwise(1.0))
        df = df.withColumns({f"_m{i}": c for i, c in enumerate(product(OKLAB_TO_LMS, (F.col("_up"), F.col("_da"), F.col("_db"))))})
        graded = product(LMS_TO_RGB, tuple(F.col(f"_m{i}") * F.col(f"_m{i}") * F.col(f"_m{i}") for i in range(3)))
        out = {c: F.col(c) * F.col("_gain") + F.greatest(g, F.lit(0.0)) - F.col("_gain") * F.col("_grey") for c, g in zip("rgb", graded, strict=True)}
        return df.withColumns(out).drop("_l", "_x", "_dark", "_bright", "_dl", "_da", "_db", "_up", "_grey", "_gain", "_m0", "_m1", "_m2")

    return Steps(over)


def shadow_tint(amount: float) -> Steps:
    """The tint of shadows beside calibration, -100 (green) to 100 (magenta)."""
    return grading(shadows=(300.0 if amount > 0 else 120.0, abs(amount) * SHADOW_TINT_STRENGTH, 0), blending=SHADOW_TINT_BLENDING)


# Grain.


def _wrapped(a: Column, factor: int) -> Column:
    """a * factor modulo 2**32, for a in 0 to 2**32, without overflow."""
    return (((a * (factor >> 16)) % (1 << 16)) * (1 << 16) + a * (factor & 0xFFFF)) % (1 << 32)


def _lattices(df: DataFrame, points: dict[str, tuple[Column, Column]]) -> DataFrame:
    """df with noise from -1 to 1 for each named point of whole numbers, the same everywhere."""
    unsigned = lambda c: F.pmod(c.cast("long"), F.lit(1 << 32))
    first = {n: _wrapped(unsigned(x), 0x8DA6B343).bitwiseXOR(_wrapped(unsigned(y), 0xD8163841)) for n, (x, y) in points.items()}
    df = df.withColumns(first).withColumns({n: F.col(n).bitwiseXOR(F.shiftright(n, 13)) for n in points})
    df = df.withColumns({n: _wrapped(F.col(n), 0x5BD1E995) for n in points})
    return df.withColumns({n: F.col(n).bitwiseXOR(F.shiftright(n, 15)).bitwiseAND(F.lit(0xFFFFFF)) / 8_388_607.5 - 1.0 for n in points})


def grain(amount: float, width: int, height: int) -> Steps:
    """Film grain, strongest in the midtones: two layers of smooth noise, the second finer and turned. Needs the columns x and y."""
    scale = GRAIN_CELLS / max(width, height, 1)

    def over(df: DataFrame) -> DataFrame:
        names = df.columns
        df = df.withColumns({"_gx0": (F.col("x") + 0.5) * scale, "_gy0": (F.col("y") + 0.5) * scale})
        df = df.withColumns({"_gx1": (F.col("_gx0") * 0.8660254 - F.col("_gy0") * 0.5) * 1.7 + 17.3, "_gy1": (F.col("_gx0") * 0.5 + F.col("_gy0") * 0.8660254) * 1.7 + 5.1})
        layers = []
        for k, weight in enumerate((0.65, 0.55)):
            gx, gy = F.col(f"_gx{k}"), F.col(f"_gy{k}")
            df = _lattices(df, {f"_n{k}{j}{i}": (F.floor(gx) + i, F.floor(gy) + j) for j in (0, 1) for i in (0, 1)})
            tx, ty = gx - F.floor(gx), gy - F.floor(gy)
            df = df.withColumns({f"_sx{k}": tx * tx * (3.0 - 2.0 * tx), f"_sy{k}": ty * ty * (3.0 - 2.0 * ty)})
            rows = [F.col(f"_n{k}{j}0") + (F.col(f"_n{k}{j}1") - F.col(f"_n{k}{j}0")) * F.col(f"_sx{k}") for j in (0, 1)]
            layers.append((rows[0] + (rows[1] - rows[0]) * F.col(f"_sy{k}")) * weight)
        df = df.withColumns({"_noise": clamp(layers[0] + layers[1], -1.0, 1.0), "_y": clamp(luma(rgb()))})
        df = df.withColumn("_gain", F.pow(F.lit(2.0), F.col("_noise") * (amount / 100 * GRAIN_STOPS) * 4.0 * F.col("_y") * (1.0 - F.col("_y"))))
        return df.withColumns({c: F.col(c) * F.col("_gain") for c in "rgb"}).select(*names)

    return Steps(over)


# White balance. Lights are worked out for whole batches of photos with numpy: sixty steps of a search don't fit into one expression.


def _uv(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = -2.0 * x + 12.0 * y + 3.0
    return 4.0 * x / d, 6.0 * y / d


def locus(kelvin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Planckian locus in CIE 1960 uv, by the published cubic approximation."""
    t = np.clip(kelvin, LEAST_KELVIN, MOST_KELVIN)
    low = -0.2661239e9 / t**3 - 0.2343589e6 / t**2 + 0.8776956e3 / t + 0.179910
    high = -3.0258469e9 / t**3 + 2.1070379e6 / t**2 + 0.2226347e3 / t + 0.240390
    x = np.where(t <= 4000, low, high)
    y = np.select(
        [t <= 2222, t <= 4000],
        [np.polyval([-1.1063814, -1.34811020, 2.18555832, -0.20219683], x), np.polyval([-0.9549476, -1.37418593, 2.09137015, -0.16748867], x)],
        np.polyval([3.0817580, -5.87338670, 3.75112997, -0.37001483], x),
    )
    return _uv(x, y)


def _normal(kelvin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit normal of the locus, to the green side."""
    m = 1e6 / kelvin
    (ua, va), (ub, vb) = locus(1e6 / (m + 0.5)), locus(1e6 / (m - 0.5))
    n = np.hypot(ub - ua, vb - va) * np.where(ub < ua, -1.0, 1.0)
    return (va - vb) / n, (ub - ua) / n


def light_at(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kelvin and duv of chromaticities: the nearest light of the locus, by golden section over mireds, and the distance from it."""
    u, v = _uv(x, y)
    low, high = np.full(len(u), 1e6 / MOST_KELVIN), np.full(len(u), 1e6 / LEAST_KELVIN)
    g = (math.sqrt(5) - 1) / 2

    def far(m):
        a, b = locus(1e6 / m)
        return (u - a) ** 2 + (v - b) ** 2

    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        less = far(a) < far(b)
        low, high = np.where(less, low, a), np.where(less, b, high)
    kelvin = 2e6 / (low + high)
    (a, b), n = locus(kelvin), _normal(kelvin)
    return kelvin, (u - a) * n[0] + (v - b) * n[1]


def chromaticity_at(kelvin: np.ndarray, duv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of lights."""
    t, d = np.clip(kelvin, LEAST_KELVIN, MOST_KELVIN), np.clip(duv, -MOST_DUV, MOST_DUV)
    (u, v), n = locus(t), _normal(t)
    u, v = u + d * n[0], v + d * n[1]
    w = 2.0 * u - 8.0 * v + 4.0
    return 3.0 * u / w, 2.0 * v / w


def gains_at(kelvin: np.ndarray, duv: np.ndarray, to_kelvin: np.ndarray, to_duv: np.ndarray) -> np.ndarray:
    """Gains of the three channels from one light to another; greys keep their luminance."""
    rgb_ = []
    for k, d in ((kelvin, duv), (to_kelvin, to_duv)):
        x, y = chromaticity_at(k, d)
        rgb_.append(np.array(XYZ_TO_RGB) @ np.stack([x / y, np.ones(len(x)), (1.0 - x - y) / y]))
    g = rgb_[0] / rgb_[1]
    return g / (np.array(LUMA) @ g)


@pandas_udf(StructType([StructField("kelvin", DoubleType()), StructField("duv", DoubleType())]))
def light_of(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("kelvin", "duv"), light_at(x.to_numpy(), y.to_numpy()), strict=True)))


@pandas_udf(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))
def chromaticity(kelvin: pd.Series, duv: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip("xy", chromaticity_at(kelvin.to_numpy(), duv.to_numpy()), strict=True)))


@pandas_udf(StructType([StructField(c, DoubleType()) for c in "rgb"]))
def white_gains(kelvin: pd.Series, duv: pd.Series, to_kelvin: pd.Series, to_duv: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(gains_at(*(c.to_numpy() for c in (kelvin, duv, to_kelvin, to_duv))).T, columns=list("rgb"))


def adjusted(kelvin: Column, duv: Column, temperature: Column, tint: Column) -> tuple[Column, Column]:
    """The light that sliders of -100 to 100 assume, from that of the shot."""
    mired = 1e6 / kelvin - temperature * MIRED_PER_UNIT
    return clamp(1e6 / F.greatest(mired, F.lit(1.0)), LEAST_KELVIN, MOST_KELVIN), clamp(duv + tint * DUV_PER_UNIT, -MOST_DUV, MOST_DUV)


def chromaticity_of(t: Triple) -> tuple[Column, Column]:
    """x and y of a linear colour; null for black and for colours without one."""
    xyz = product(RGB_TO_XYZ, t)
    total = xyz[0] + xyz[1] + xyz[2]
    x, y = xyz[0] / total, xyz[1] / total
    ok = (total > 1e-6) & (xyz[1] > 0) & (x > 0) & (y > 0) & (x + y < 1)
    return F.when(ok, x), F.when(ok, y)


# Colour spaces and range masks.


def from_rec2020() -> Stage:
    """Linear Rec. 2020 to linear sRGB, with what lies outside brought in smoothly."""
    low, limit, p = 0.97, 1.2, 1.2
    scale = (limit - low) / (((1 - low) / (limit - low)) ** -p - 1) ** (1 / p)

    def stage(t: Triple) -> Triple:
        s = product(REC2020_TO_RGB, t)
        top = F.greatest(*s)

        def one(c):
            d = (top - c) / top
            near = low + (d - low) / F.pow(1.0 + F.pow((d - low) / scale, F.lit(p)), F.lit(1 / p))
            return F.when((top <= 0) | (d < low), c).otherwise(top - near * top)

        return each(s, one)

    return stage


def colour_mask(colours: Sequence[tuple[float, float, float]], reach: float, t: Triple) -> Column:
    """Coverage of colours near any of those picked (Oklab); reach 0 to 100."""
    outer = NEAREST + (FURTHEST - NEAREST) * reach / 100
    lab = oklab(t)
    near = [1.0 - smoothstep(outer * CORE, outer, F.sqrt((lab[0] - l) * (lab[0] - l) * 0.25 + (lab[1] - a) * (lab[1] - a) + (lab[2] - b) * (lab[2] - b))) for l, a, b in colours]
    return F.greatest(*near, F.lit(0.0)) if near else F.lit(0.0)


def radial_mask(centre: tuple[float, float], radius: tuple[float, float], angle: float, feather: float, width: int, height: int) -> Column:
    """A turned ellipse: centre in shares of the frame, radius in shares of its diagonal, angle clockwise in degrees; needs the columns x and y."""
    d, a = math.hypot(width, height), math.radians(angle)
    dx, dy = F.col("x") + 0.5 - centre[0] * width, F.col("y") + 0.5 - centre[1] * height
    u = (dx * math.cos(a) + dy * math.sin(a)) / (radius[0] * d)
    v = (dy * math.cos(a) - dx * math.sin(a)) / (radius[1] * d)
    inner, r = 1 - feather / 100, F.sqrt(u * u + v * v)
    return F.when(r <= 1, 1.0).otherwise(0.0) if inner >= 1 else 1.0 - smoothstep(inner, 1.0, r)


def scaled(coverage: Column, invert: bool = False, density: float = 1.0) -> Column:
    """A mask's coverage, turned round and thinned."""
    return (1.0 - coverage if invert else coverage) * density


def local(masks: Sequence[tuple[Column, float, tuple[float, float, float]]]) -> Stage:
    """Masks of (coverage, stops, warmth as stops of each channel): their stops are added up."""

    def stage(t: Triple) -> Triple:
        return tuple(c * F.pow(F.lit(2.0), sum((m * (s + w[i]) for m, s, w in masks), F.lit(0.0))) for i, c in enumerate(t))

    return stage
