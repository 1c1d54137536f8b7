"""Auto tone: a starting point for a photo's light, found by rendering a sample of it.

Settings are found one after the other, each for all images at once: a table of (image, low, high) is narrowed by the tones of rendered
samples. A round renders sixteenths of every open range, which four bisections ask for at most, so a setting takes three rounds, however many images there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels as P
from .detail import log_luma
from .written import written

INF = math.inf
# What counts as reaching a band, and the least change that a setting is moved for (a share of the measure, a tenth of 1 at least).
REACHED, LEAST_EFFECT, LEAST_MEASURE = 0.005, 0.02, 0.1
#: Parts of a range that one round renders: two rounds make the seven bisections.
PARTS, DEPTHS = 16, (4, 3)
Measure = Callable[["Tones"], Column]


@dataclass(frozen=True)
class Tones:
    """Columns of a sample's histogram of luma: bins (code, n, seen before), by code, and the number of pixels."""

    bins: Column
    total: Column

    def percentile(self, p: float) -> Column:
        """The luma below which p of the pixels fall, within its bin by proportion."""
        wanted = self.total * p
        at = F.get(F.filter(self.bins, lambda b: b["seen"] + b["n"] >= wanted), F.lit(0))
        return (at["code"] + P.clamp((wanted - at["seen"]) / at["n"])) / 256.0

    def share(self, keep: Callable[[Column], Column]) -> Column:
        return F.aggregate(self.bins, F.lit(0).cast("long"), lambda s, b: s + F.when(keep(b["code"]), b["n"]).otherwise(0)) / self.total

    def above(self, t: float) -> Column:
        return self.share(lambda code: code >= min(256, math.ceil(t * 256)))

    def below(self, t: float) -> Column:
        return self.share(lambda code: code < min(256, math.floor(t * 256)))


@dataclass(frozen=True)
class Setting:
    """How a setting is found: its range, the band that a measure, which rises with it, is brought into, the step that it is rounded to; and range and band where it alone is asked for."""

    name: str
    low: float
    high: float
    band: tuple[float, float]
    measure: Measure
    alone: tuple[float, float]
    step: float = 1.0
    alone_low: float | None = None


# Ranges, bands and targets on the rendered luma.
BRIGHT, DARK = 0.92, 0.06
SETTINGS = (
    Setting("exposure", -2.0, 2.5, (0.40, 0.52), lambda t: t.percentile(0.5), (0.46, 0.46), 0.05),
    Setting("contrast", 0.0, 30.0, (0.26, INF), lambda t: t.percentile(0.75) - t.percentile(0.25), (0.36, 0.36), alone_low=-15.0),
    Setting("highlights", -70.0, 0.0, (-INF, 0.03), lambda t: t.above(BRIGHT), (-INF, 0.01)),
    Setting("shadows", 0.0, 60.0, (-0.06, INF), lambda t: -t.below(DARK), (-0.02, INF)),
    Setting("whites", -40.0, 40.0, (0.90, 0.985), lambda t: t.percentile(0.995), (0.975, 0.975)),
    Setting("blacks", -40.0, 30.0, (0.012, 0.06), lambda t: t.percentile(0.005), (0.02, 0.02)),
)
COLOURFUL, MOST_VIBRANCE, VIBRANCE_STEP = 0.30, 20.0, 5.0
NAMES = tuple(s.name for s in SETTINGS)


def contrasted(c: Column, amount: Column) -> Column:
    """The contrast stage for an amount that is a column."""
    gamma, m = F.pow(F.lit(2.0), amount / 100.0 * P.CONTRAST_STRENGTH), P.CONTRAST_GREY ** (1 / P.CONTRAST_GAMMA)
    p = F.pow(c, F.lit(1 / P.CONTRAST_GAMMA))
    q = F.when(p <= m, m * F.pow(p / m, gamma)).otherwise(1.0 - (1.0 - m) * F.pow((1.0 - p) / (1.0 - m), gamma))
    return F.when((c >= 0) & (c < 1), F.pow(q, F.lit(P.CONTRAST_GAMMA))).otherwise(F.greatest(c, F.lit(0.0)))


def rendered(df: DataFrame) -> DataFrame:
    """df (r, g, b, base and the settings NAMES as columns) with its 8-bit codes in r, g, b: exposure, tone, contrast and the base curve, gamut and encoding."""
    t = P.plan([lambda v: P.each(v, lambda c: c * F.pow(F.lit(2.0), F.col("exposure")))], df)
    below, d = -(F.col("base") + F.col("exposure")), -log_luma(P.rgb())
    local = F.col("shadows") / 100 * P.SHADOWS * P.smoothstep(2.0, 5.5, below) + F.col("highlights") / 100 * P.HIGHLIGHTS * (1.0 - P.smoothstep(0.25, 3.0, below))
    ends = F.col("whites") / 100 * P.WHITES * (1.0 - P.smoothstep(0.0, 1.5, d)) + F.col("blacks") / 100 * P.BLACKS * P.smoothstep(4.0, 8.0, d)
    t = t.withColumn("_gain", F.pow(F.lit(2.0), local + ends))
    stages = [lambda v: P.each(v, lambda c: c * F.col("_gain")), lambda v: P.each(v, lambda c: contrasted(c, F.col("contrast"))), P.base_curve(), P.gamut(), lambda v: P.each(v, P.quantised)]
    return P.plan(stages, t).drop("_gain")


def _tones(sample: DataFrame, candidates: DataFrame) -> DataFrame:
    """image_id, k, bins (code, n, seen), total and colour (the sum of the channels' spans) of the sample rendered for each candidate (image_id, k and NAMES)."""
    codes = rendered(sample.join(candidates, "image_id"))
    y = F.shiftright(F.col("r") * 54 + F.col("g") * 183 + F.col("b") * 19 + 128, 8)
    counts = codes.groupBy("image_id", "k", y.alias("code")).agg(F.count("*").alias("n"), F.sum(F.greatest("r", "g", "b") - F.least("r", "g", "b")).alias("colour"))
    # At most 256 bins for each image and candidate.
    held = counts.groupBy("image_id", "k").agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("bins"), F.sum("n").alias("total"), F.sum("colour").alias("colour"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.array().cast("array<struct<code: int, n: long, seen: long>>").alias("out"))
    step = lambda s, b: F.struct((s["seen"] + b["n"]).alias("seen"), F.array_append(s["out"], F.struct(b["code"].alias("code"), b["n"].alias("n"), s["seen"].alias("seen"))).alias("out"))
    return held.withColumn("bins", F.aggregate("bins", start, step, lambda s: s["out"]))


def _measured(sample: DataFrame, state: DataFrame, setting: Setting, at: dict[int, Column]) -> DataFrame:
    """state with `f`, a map from k to the measure where the setting is at[k]."""
    each = state.select("image_id", *(n for n in NAMES if n != setting.name), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("double").alias("v")) for k, v in at.items()))).alias("_c"))
    tones = _tones(sample, each.select("image_id", *(n for n in NAMES if n != setting.name), F.col("_c.k").alias("k"), F.col("_c.v").alias(setting.name)))
    told = tones.select("image_id", "k", setting.measure(Tones(F.col("bins"), F.col("total"))).alias("m"))
    return state.join(told.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("f")), "image_id")


def _found(sample: DataFrame, state: DataFrame, setting: Setting, alone: bool) -> DataFrame:
    """state (image_id and NAMES, a written table) with the setting found."""
    low_end, high_end = (setting.alone_low if alone and setting.alone_low is not None else setting.low), setting.high
    low, high = setting.alone if alone else setting.band
    now, first, last = (F.element_at("f", k) for k in (0, 1, 2))
    begun = _measured(sample, state, setting, {0: F.lit(0.0), 1: F.lit(low_end), 2: F.lit(high_end)}).withColumn("now", now)
    up, down = F.col("now") < low, F.col("now") > high
    # v and its measure where no search is needed: in the band, or not even the end of the range reaches it.
    v = F.when(~up & ~down, 0.0).when(up & (last <= low), high_end).when(down & (first >= high), low_end)
    reached = F.when(up, last).otherwise(first)
    begun = begun.withColumns({"v": v, "reached": reached, "target": F.when(up, low).otherwise(high), "a": F.when(up, 0.0).otherwise(low_end), "b": F.when(up, high_end).otherwise(0.0)}).drop("f")
    begun = written(begun)
    done, searched = begun.filter("v IS NOT NULL"), begun.filter("v IS NULL")
    if not searched.isEmpty():
        for depth in DEPTHS:
            part = (F.col("b") - F.col("a")) / PARTS
            held = written(_measured(sample, searched.drop(setting.name).withColumn(setting.name, F.lit(0.0)), setting, {k: F.col("a") + part * k for k in range(1, PARTS)}))
            held = held.withColumns({"_p": F.lit(0), "_q": F.lit(PARTS)})
            for _ in range(depth):
                mid = ((F.col("_p") + F.col("_q")) / 2).cast("int")
                less = F.element_at("f", mid) < F.col("target")
                held = held.withColumn("_less", less).withColumns({"_p": F.when(F.col("_less"), mid).otherwise(F.col("_p")), "_q": F.when(F.col("_less"), F.col("_q")).otherwise(mid)})
            mid = ((F.col("_p") + F.col("_q")) / 2).cast("int")
            value = {"v": F.col("a") + part * mid, "reached": F.element_at("f", mid)} if depth == DEPTHS[-1] else {}
            searched = held.withColumns({**value, "a": F.col("a") + part * F.col("_p"), "b": F.col("a") + part * F.col("_q")}).drop("f", "_p", "_q", "_less")
    out = done.unionByName(searched) if "v" in searched.columns else done
    short = (F.col("reached") < low - REACHED) | (F.col("reached") > high + REACHED)
    idle = short & (F.abs(F.col("reached") - F.col("now")) < F.greatest(F.abs("now"), F.lit(LEAST_MEASURE)) * LEAST_EFFECT)
    steps = F.col("v") / setting.step
    nearest = F.signum(steps) * F.floor(F.abs(steps) + 0.5) * setting.step + 0.0
    return written(out.withColumn(setting.name, F.when((F.col("v") != 0) & idle, 0.0).otherwise(nearest)).select("image_id", *NAMES))


def vibrance(sample: DataFrame, state: DataFrame) -> DataFrame:
    """state with vibrance: muted photos gain colour, colourful ones hardly any."""
    tones = _tones(sample, state.withColumn("k", F.lit(0)))
    colourful = F.col("colour") / (F.col("total") * 255.0)
    steps = P.clamp((COLOURFUL - colourful) * 100.0, 0.0, MOST_VIBRANCE) / VIBRANCE_STEP
    return state.join(tones.select("image_id", (F.floor(steps + 0.5) * VIBRANCE_STEP).alias("vibrance")), "image_id")


def auto_tone(sample: DataFrame) -> DataFrame:
    """image_id, NAMES and vibrance for each image of the sample (image_id, r, g, b, linear; base, the log2 luminance of a pixel's surroundings).

    A setting stays at zero while the photo is within its band, and moves to the band's nearer edge otherwise, each with those before it set.
    """
    state = written(sample.select("image_id").distinct().select("image_id", *(F.lit(0.0).alias(n) for n in NAMES)))
    for setting in SETTINGS:
        state = _found(sample, state, setting, alone=False)
    return vibrance(sample, state)


def auto_setting(sample: DataFrame, name: str, recipes: DataFrame | None = None) -> DataFrame:
    """image_id and the value of one setting, aimed at its target, where the others are as recipes (image_id and NAMES) say, or zero."""
    if recipes is None:
        recipes = sample.select("image_id").distinct().select("image_id", *(F.lit(0.0).alias(n) for n in NAMES))
    state = written(recipes.select("image_id", *(F.col(n).cast("double").alias(n) for n in NAMES)))
    if name == "vibrance":
        return vibrance(sample, state).select("image_id", "vibrance")
    (setting,) = (s for s in SETTINGS if s.name == name)
    return _found(sample, state, setting, alone=True).select("image_id", name)
