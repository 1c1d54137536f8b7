"""Queries that find settings for photos, and masks that are painted: each over all images at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .adapters import Library
from .plans import auto_tone as A
from .plans import brush as B
from .plans import detail as D
from .plans import dust as U
from .plans import level as L
from .plans import pixels as P
from .plans import sky as S
from .plans import tiles as T
from .plans.written import written
from .queries_pixels import _CM, _E8, _G3, _GS, _LU, _P22, _SM, _TM, _TOP, _Y, _win
from .registry import query

# Brush: four strokes for each image, of three points each, the third one erasing.

_P = [f"round(0.5::DOUBLE + 1.5 * embedding[{k}]::DOUBLE, 4)" for k in range(1, 7)]
_STROKES = ("st AS (SELECT vec_id // 64 AS image_id, (vec_id % 64 // 16)::INT AS nth, " + ", ".join(f"{p} * 64 AS p{k}" for k, p in enumerate(_P))
            + ", greatest(0.5::DOUBLE, least(0.5, greatest(0.0005, 0.05 + abs(embedding[7]::DOUBLE) / 4)) * sqrt(8192::DOUBLE)) AS rad FROM embeddings WHERE vec_id % 16 = 0)")
_DIST = "sqrt(pow({ax} + {t} * ({bx} - {ax}) - {px}, 2) + pow({ay} + {t} * ({by} - {ay}) - {py}, 2))"


def _distance_sql(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    n = f"(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))"
    t = f"(CASE WHEN {n} > 0 THEN greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {n})) ELSE 0 END)"
    return _DIST.format(ax=ax, ay=ay, bx=bx, by=by, px=px, py=py, t=t)


_SEGMENTS = (f"sk AS (SELECT *, {_distance_sql('p0', 'p1', 'p4', 'p5', 'p2', 'p3')} > 0.25 AS bent FROM st), sg AS (SELECT image_id, nth, rad, p0 AS ax, p1 AS ay, CASE WHEN bent THEN p2 ELSE p4 END AS ex, CASE WHEN bent THEN p3 ELSE p5 END AS ey FROM sk "
             "UNION ALL SELECT image_id, nth, rad, p2, p3, p4, p5 FROM sk WHERE bent)")
_PROFILE = (f"sd AS (SELECT sg.image_id, nth, rad, rad * 0.5 AS inn, y, x, min({_distance_sql('ax', 'ay', 'ex', 'ey', '(x + 0.5)', '(y + 0.5)')}) AS d FROM sg JOIN pixels USING (image_id) GROUP BY ALL), "
            "sv AS (SELECT image_id, y, x, nth, CASE WHEN d <= inn THEN 1 WHEN d >= rad THEN 0 ELSE 1 - pow((d - inn) / (rad - inn), 2) * (3 - 2 * (d - inn) / (rad - inn)) END::DOUBLE AS v FROM sd), "
            "s4 AS (SELECT image_id, y, x, " + ", ".join(f"coalesce(max(v) FILTER (nth = {k}), 0) AS v{k}" for k in range(4)) + " FROM sv GROUP BY ALL)")
_FOLD = "f0 AS (SELECT *, 0::DOUBLE AS c FROM s4), " + ", ".join(
    f"f{k + 1} AS (SELECT * EXCLUDE (a, c), CASE WHEN v{k} = 0 THEN c ELSE floor((" + ("c * (1 - a)" if k == 2 else "c + (1 - c) * a") + f") * 65535 + 0.5) / 65535 END AS c FROM (SELECT *, {0.4 + 0.2 * k:.1f}::DOUBLE * v{k} AS a FROM f{k}))" for k in range(4))


@query("mask_brush", O.with_tables(O.PIXELS, _STROKES, _SEGMENTS, _PROFILE, _FOLD, body="SELECT p.image_id, p.y, p.x, round(coalesce(c, 0), 6) AS coverage FROM pixels p LEFT JOIN f4 USING (image_id, y, x)"))
def mask_brush(s, d):
    lib = Library(s, d)
    e = lambda k: F.element_at("embedding", k).cast("double")
    place = lambda k: F.round(0.5 + 1.5 * e(k), 4)
    points = F.array(*(F.struct(place(k).alias("x"), place(k + 1).alias("y")) for k in (1, 3, 5)))
    rows = lib._read("embeddings").filter("vec_id % 16 = 0").select(F.expr("vec_id div 64").alias("image_id"), F.expr("vec_id % 64 div 16").alias("nth"), points.alias("points"), (0.05 + F.abs(e(7)) / 4).alias("size"))
    strokes = rows.select("image_id", "nth", (F.col("nth") == 2).alias("erase"), "size", F.lit(50.0).alias("feather"), (40.0 + 20.0 * F.col("nth")).alias("flow"), "points")
    pixels = lib.pixels().select("image_id", "y", "x")
    frames = pixels.select("image_id").distinct().withColumns({"width": F.lit(64).cast("long"), "height": F.lit(64).cast("long")})
    cover = B.brush_coverage(strokes, frames)
    return pixels.join(cover, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))


# Level: horizons of known tilts over the test images, a thirtieth as strong.

_TILT = "tan(radians(image_id % 9 * 3.0::DOUBLE - 12))"
_HORIZON = f"hz AS (SELECT image_id, y, x, log2(greatest(0.0001, 0.2 + 0.5 / (1 + exp(-(y - 31.5 - {_TILT} * (x - 31.5)))) + 0.02 * g))::DOUBLE AS l FROM pixels)"
_BLUR = _win(["l"], "hz", "l1", 1) + ", l2 AS (SELECT image_id, y, x, l_m AS k FROM l1), " + _win(["k"], "l2", "l3", 1)
_EDGES = ("e0 AS (SELECT *, lead(k_m) OVER w - lag(k_m) OVER w AS dx FROM l3 WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), e1 AS (SELECT *, lead(k_m) OVER w - lag(k_m) OVER w AS dy, 3 * lag(dx) OVER w + 10 * dx + 3 * lead(dx) OVER w AS gx FROM e0 WINDOW w AS (PARTITION BY image_id, x ORDER BY y)), "
          "e2 AS (SELECT *, 3 * lag(dy) OVER w + 10 * dy + 3 * lead(dy) OVER w AS gy FROM e1 WINDOW w AS (PARTITION BY image_id, y ORDER BY x)), "
          "e3 AS (SELECT image_id, y, x, CASE WHEN gx IS NULL OR gy IS NULL THEN 0 ELSE gx * gx END AS a, CASE WHEN gx IS NULL OR gy IS NULL THEN 0 ELSE gy * gy END AS b, CASE WHEN gx IS NULL OR gy IS NULL THEN 0 ELSE gx * gy END AS c FROM e2), ") + _win(["a", "b", "c"], "e3", "e4", 3)
_VOTES = ("v0 AS (SELECT image_id, a_m + b_m AS tr, sqrt(pow(a_m - b_m, 2) + 4 * c_m * c_m) AS sp, degrees(0.5 * atan2(2 * c_m, a_m - b_m)) + 90 AS raw FROM e4 WHERE a_m + b_m >= 0.01), v1 AS (SELECT *, CASE WHEN raw > 90 THEN raw - 180 ELSE raw END AS ln FROM v0), "
          "v2 AS (SELECT *, CASE WHEN abs(ln) <= 15 THEN ln WHEN abs(ln) >= 75 THEN ln - 90 * sign(ln) END AS turn FROM v1), "
          "h AS (SELECT image_id, floor((turn + 15) * 10 + 0.5)::INT AS bin, sum(sqrt(tr) * pow(sp / tr, 4)) AS n FROM v2 WHERE turn IS NOT NULL GROUP BY ALL), "
          "sm AS (SELECT image_id, b::INT AS b, sum(n * exp(-pow(bin - b, 2) / 18.0::DOUBLE)) AS s FROM h JOIN range(0, 301) t(b) ON abs(bin - b) <= 9 GROUP BY ALL), "
          "pk AS (SELECT image_id, arg_max(b, struct_pack(s := s, b := b)) AS p, max(s) AS top FROM sm GROUP BY image_id), "
          "nb AS (SELECT pk.image_id, p, top, coalesce(max(s) FILTER (b = p - 1), 0) AS lo, coalesce(max(s) FILTER (b = p + 1), 0) AS hi FROM pk JOIN sm USING (image_id) GROUP BY ALL), "
          "cf AS (SELECT image_id, sum(n) FILTER (abs(bin - p) <= 5) / sum(n) AS conf, any_value(p) AS p, any_value(lo) AS lo, any_value(hi) AS hi, any_value(top) AS top FROM nb JOIN h USING (image_id) GROUP BY image_id)")


@query("px_level", O.with_tables(O.PIXELS, _HORIZON, _BLUR, _EDGES, _VOTES, body="SELECT image_id, CASE WHEN conf >= 0.075 THEN round(p + CASE WHEN p > 0 AND p < 300 AND abs(lo - 2 * top + hi) > 1e-12 THEN greatest(-0.5, least(0.5, (lo - hi) / 2 / (lo - 2 * top + hi))) ELSE 0 END - 150) / 10 + 0.0 END AS angle, round(conf, 5) AS confidence FROM cf"))
def px_level(s, d):
    tilt = F.tan(F.radians(F.col("image_id") % 9 * 3.0 - 12.0))
    v = 0.2 + 0.5 / (1.0 + F.exp(-(F.col("y") - 31.5 - tilt * (F.col("x") - 31.5)))) + 0.02 * F.col("g")
    horizons = Library(s, d).pixels().withColumn("v", v).select("image_id", "y", "x", *(F.col("v").alias(c) for c in "rgb"))
    return L.auto_level(horizons).select("image_id", "angle", F.round("confidence", 5).alias("confidence"))


# Auto tone: a search for each setting in turn, as a recursive table for each.

_SET = ("exposure", "contrast", "highlights", "shadows", "whites", "blacks")
_SAMPLE = "smp AS MATERIALIZED (SELECT image_id, " + ", ".join(f"pow({c}, 1 + image_id % 4) * pow(2::DOUBLE, 1 - image_id % 3) AS {c}" for c in "rgb") + ", -below * (1 + image_id % 4) + 1 - image_id % 3 AS base FROM tn WHERE x % 2 = 0 AND y % 2 = 0)"


def _rendered_sql(source: str, keys: str) -> str:
    """A subquery of keys and code (the luma of 8 bits) and span from source, with keys, r, g, b, base and the settings."""
    chain = f"SELECT * EXCLUDE (r, g, b), {', '.join(f'{c} * pow(2::DOUBLE, exposure) AS {c}' for c in 'rgb')} FROM ({source})"
    below, d = "(-(base + exposure))", f"(-log2(greatest({_Y}, 0.000001)))"
    gain = f"pow(2::DOUBLE, shadows / 100 * 2 * {_SM('2.0', '5.5', below)} + highlights / 100 * 1.5 * (1 - {_SM('0.25', '3.0', below)}) + whites / 100 * (1 - {_SM('0.0', '1.5', d)}) + blacks / 100 * 1.5 * {_SM('4.0', '8.0', d)})"
    chain = f"SELECT * EXCLUDE (r, g, b), pow(2::DOUBLE, contrast / 100 * 0.8) AS gam, {', '.join(f'{c} * {gain} AS {c}' for c in 'rgb')} FROM ({chain})"
    p, m = _P22, _CM
    bent = "CASE WHEN {c} >= 0 AND {c} < 1 THEN pow(CASE WHEN {p} <= {m} THEN {m} * pow({p} / {m}, gam) ELSE 1 - (1 - {m}) * pow((1 - {p}) / (1 - {m}), gam) END, 2.2::DOUBLE) ELSE greatest({c}, 0) END AS {c}"
    chain = f"SELECT * EXCLUDE (r, g, b), {', '.join(bent.format(c=c, p=p.format(c=c), m=m) for c in 'rgb')} FROM ({chain})"
    chain = f"SELECT * EXCLUDE (r, g, b), {', '.join(f'CASE WHEN {c} <= 0 THEN 0 WHEN {c} >= 1 THEN {c} ELSE 1 / (1 + pow(0.55 / ({c} * 2.3784142), 1.65::DOUBLE)) / {_TOP} END AS {c}' for c in 'rgb')} FROM ({chain})"
    near = "CASE WHEN {t} <= 0 OR ({t} - {c}) / {t} < 0.97 THEN {c} ELSE {t} - (0.97 + (({t} - {c}) / {t} - 0.97) / pow(1 + pow((({t} - {c}) / {t} - 0.97) / {s}, 1.2::DOUBLE), 1 / 1.2::DOUBLE)) * {t} END AS {c}"
    chain = f"SELECT * EXCLUDE (r, g, b), {', '.join(near.format(c=c, t=_G3, s=_GS) for c in 'rgb')} FROM ({chain})"
    code = lambda c: _E8.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))")
    chain = f"SELECT * EXCLUDE (r, g, b), {', '.join(f'{code(c)} AS {c}' for c in 'rgb')} FROM ({chain})"
    return f"(SELECT {keys}, {_LU} AS code, greatest(r, g, b) - least(r, g, b) AS span FROM ({chain}))"


def _pct_sql(p: float) -> str:
    """Over rows of code, n, cum (n so far) and tot."""
    return f"(min((code + greatest(0, least(1, ({p}::DOUBLE * tot - cum + n) / n))) / 256.0::DOUBLE) FILTER (cum >= {p}::DOUBLE * tot))"


#: By setting: its range, its band, its measure over a histogram, its step, and the range and target where it alone is asked for.
_AUTO = {
    "exposure": (-2.0, 2.5, 0.40, 0.52, _pct_sql(0.5), 0.05, -2.0, 0.46, 0.46),
    "contrast": (0.0, 30.0, 0.26, 9.0, f"({_pct_sql(0.75)} - {_pct_sql(0.25)})", 1.0, -15.0, 0.36, 0.36),
    "highlights": (-70.0, 0.0, -9.0, 0.03, "(coalesce(sum(n) FILTER (code >= 236), 0) / max(tot)::DOUBLE)", 1.0, -70.0, -9.0, 0.01),
    "shadows": (0.0, 60.0, -0.06, 9.0, "(-coalesce(sum(n) FILTER (code < 15), 0) / max(tot)::DOUBLE)", 1.0, 0.0, -0.02, 9.0),
    "whites": (-40.0, 40.0, 0.90, 0.985, _pct_sql(0.995), 1.0, -40.0, 0.975, 0.975),
    "blacks": (-40.0, 30.0, 0.012, 0.06, _pct_sql(0.005), 1.0, -40.0, 0.02, 0.02),
}


def _search_sql(name: str, state: str, out: str, alone: bool = False) -> str:
    """CTEs that bring one setting of the table state into its band, as the table out."""
    low, high, least, most, measure, step, alone_low, alone_least, alone_most = _AUTO[name]
    if alone:
        low, least, most = alone_low, alone_least, alone_most
    rest = ", ".join(n for n in _SET if n != name)
    with_value = lambda t, v, more: f"SELECT t.image_id, {', '.join(f't.{n}' for n in _SET if n != name)}, {v} AS {name}, {more}, r, g, b, base FROM {t} t JOIN smp USING (image_id)"
    counts = lambda t, v, keys: f"(WITH codes AS MATERIALIZED {_rendered_sql(with_value(t, v, keys), f'image_id, {rest}, {keys}')} SELECT image_id, {rest}, {keys}, code, count(*) AS n FROM codes GROUP BY image_id, {rest}, {keys}, code)"
    sums = lambda t, v, keys: f"(SELECT *, sum(n) OVER (PARTITION BY image_id, {keys} ORDER BY code) AS cum, sum(n) OVER (PARTITION BY image_id, {keys}) AS tot FROM {counts(t, v, keys)})"
    at = lambda t, v, keys: f"(SELECT image_id, {rest}, {keys}, {measure} AS f FROM {sums(t, v, keys)} GROUP BY image_id, {rest}, {keys})"
    three = f"(SELECT {state}.*, k, CASE k WHEN 0 THEN 0 WHEN 1 THEN {low} ELSE {high} END::DOUBLE AS val FROM {state}, range(0, 3) t(k))"
    first = f"{out}a AS MATERIALIZED (SELECT image_id, {rest}, max(f) FILTER (k = 0) AS now, max(f) FILTER (k = 1) AS lowest, max(f) FILTER (k = 2) AS highest FROM {at(three, 'val', 'k, val')} GROUP BY ALL)"
    told = (f"{out}b AS MATERIALIZED (SELECT *, CASE WHEN now >= {least} AND now <= {most} THEN 0 WHEN now < {least} AND highest <= {least} THEN {high} WHEN now > {most} AND lowest >= {most} THEN {low} END::DOUBLE AS v, CASE WHEN now < {least} THEN highest ELSE lowest END AS reached, "
            f"CASE WHEN now < {least} THEN {least} ELSE {most} END::DOUBLE AS tgt, CASE WHEN now < {least} THEN 0 ELSE {low} END::DOUBLE AS lo, CASE WHEN now < {least} THEN {high} ELSE 0 END::DOUBLE AS hi FROM {out}a)")
    walk = (f"{out}c AS (SELECT image_id, {rest}, now, tgt, lo, hi, 0 AS step FROM {out}b WHERE v IS NULL UNION ALL SELECT image_id, {rest}, now, tgt, CASE WHEN f < tgt THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < tgt THEN hi ELSE (lo + hi) / 2 END, step + 1 "
            f"FROM {at(f'(SELECT * FROM {out}c WHERE step < 7)', '(lo + hi) / 2', 'now, tgt, lo, hi, step')})")
    last = f"{out}d AS (SELECT image_id, {rest}, now, (lo + hi) / 2 AS v, f AS reached FROM {at(f'(SELECT * FROM {out}c WHERE step = 7)', '(lo + hi) / 2', 'now, lo, hi')} UNION ALL SELECT image_id, {rest}, now, v, reached FROM {out}b WHERE v IS NOT NULL)"
    idle = f"v <> 0 AND (reached < {least} - 0.005 OR reached > {most} + 0.005) AND abs(reached - now) < 0.02 * greatest(abs(now), 0.1)"
    done = f"{out} AS MATERIALIZED (SELECT image_id, {rest}, CASE WHEN {idle} THEN 0 ELSE round(v / {step}) * {step} END + 0.0 AS {name} FROM {out}d)"
    return ", ".join((first, told, walk, last, done))


_START = "t0 AS (SELECT DISTINCT image_id, " + ", ".join(f"0::DOUBLE AS {n}" for n in _SET) + " FROM pixels)"
_VIBRANCE = "vc AS MATERIALIZED " + _rendered_sql("SELECT * FROM t6 JOIN smp USING (image_id)", "image_id") + ", vb AS (SELECT image_id, floor(greatest(0, least(20, (0.30 - sum(span) / (255.0::DOUBLE * count(*))) * 100)) / 5 + 0.5) * 5 AS vibrance FROM vc GROUP BY image_id)"


def _recursive(*tables: str, body: str) -> str:
    return O.with_tables(*tables, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _sample(lib: Library):
    """Every fourth pixel of the test images, made harsher and darker by image, with the brightness of its surroundings."""
    pixels = lib.pixels()
    model = D.tone_map(P.scene_map(pixels, 64, 16), 3)
    held = D.with_map(pixels, model.withColumnsRenamed({"a": "_a", "b": "_b"}), 64, 16, ("_a", "_b"))
    power, stops = 1 + F.col("image_id") % 4, 1 - F.col("image_id") % 3
    held = held.filter("x % 2 = 0 AND y % 2 = 0").withColumn("base", (F.col("_a") * D.log_luma(P.rgb()) + F.col("_b")) * power + stops)
    return held.select("image_id", *((F.pow(F.col(c), power) * F.pow(F.lit(2.0), stops)).alias(c) for c in "rgb"), "base")


@query("px_auto_tone", _recursive(O.PIXELS, *_TM, _SAMPLE, _START, *(_search_sql(n, f"t{k}", f"t{k + 1}") for k, n in enumerate(_SET)), _VIBRANCE, body="SELECT image_id, " + ", ".join(f"round({n}, 4) + 0.0 AS {n}" for n in (*_SET, "vibrance")) + " FROM t6 JOIN vb USING (image_id)"))
def px_auto_tone(s, d):
    found = A.auto_tone(written(_sample(Library(s, d))))
    return found.select("image_id", *((F.round(n, 4) + 0.0).alias(n) for n in (*A.NAMES, "vibrance")))


@query("px_auto_setting", _recursive(O.PIXELS, *_TM, _SAMPLE, _START, *(_search_sql(n, "t0", f"s{k}", True) for k, n in enumerate(("exposure", "contrast"))), body="SELECT s0.image_id, round(s0.exposure, 4) + 0.0 AS exposure, round(s1.contrast, 4) + 0.0 AS contrast FROM s0 JOIN s1 USING (image_id)"))
def px_auto_setting(s, d):
    """Exposure and contrast, each alone."""
    sample = written(_sample(Library(s, d)))
    found = A.auto_setting(sample, "exposure").join(A.auto_setting(sample, "contrast"), "image_id")
    return found.select("image_id", *((F.round(n, 4) + 0.0).alias(n) for n in ("exposure", "contrast")))


# Dust: skies of three by two test images each, with five spots.


def _skies(lib: Library):
    """Smooth gradients with the test images' own noise, a two-hundredth as strong, and spots of dust at places by image."""
    pixels = lib.pixels()
    sizes = T.frames(pixels)
    wide = pixels.join(sizes, "image_id").withColumn("_i", F.explode(F.array(*map(F.lit, range(3))))).withColumn("_j", F.explode(F.array(*map(F.lit, range(2)))))
    wide = wide.withColumns({"x": (F.col("x") + F.col("_i") * F.col("width")).cast("int"), "y": (F.col("y") + F.col("_j") * F.col("height")).cast("int")})
    base = 0.3 + 0.02 * (1.0 - F.col("y") / 128.0) + 0.01 * F.col("x") / 192.0
    dark = F.lit(1.0)
    for k in range(5):
        cx, cy = 20.5 + (F.col("image_id") * 37 + k * 53) % 150, 20.5 + (F.col("image_id") * 29 + k * 31) % 70
        far = (F.col("x") + 0.5 - cx) * (F.col("x") + 0.5 - cx) + (F.col("y") + 0.5 - cy) * (F.col("y") + 0.5 - cy)
        dark = dark * (1.0 - (0.08 + 0.03 * k) * F.exp(-far / (2 * (1.4 + 0.15 * k) ** 2)))
    wide = wide.withColumn("_v", base * (1.0 + (F.col("g") - 0.4) * 0.005) * dark)
    return wide.select("image_id", "y", "x", (F.col("_v") * 0.7).alias("r"), (F.col("_v") * 0.85).alias("g"), (F.col("_v") * 1.1).alias("b"))


@query("px_dust")
def px_dust(s, d):
    found = U.find_dust(_skies(Library(s, d)))
    return found.select("image_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "radius", "darkening", "score")))


# Sky: the test images as ground under a sky, with twigs and a cloud; every third is a grey room.


def _views(lib: Library):
    """Photos as encoded for sRGB, and the exposure values of those whose camera tells them."""
    wide = lib.pixels()
    noise = (F.col("g") - 0.4) * 0.02
    horizon = 34 + F.col("image_id") % 5 * 3 + F.floor(F.col("x") / 16) % 2 * 4
    cloud = (F.pow(F.col("x") - 44.0, 2) + F.pow(F.col("y") - 16.0, 2) < 60)
    twig = (F.col("x") % 4 == 1) & (F.col("x") < 24) & (F.col("y") > 20)
    look = {"r": (0.45, 0.85, 0.1, 0.3, 0.5), "g": (0.65, 0.86, 0.1, 0.32, 0.5), "b": (0.9, 0.87, 0.1, 0.15, 0.5)}
    told = lambda sky, white, dark, ground, room: F.when(F.col("image_id") % 3 == 2, room).when(F.col("y") >= horizon, ground + noise * 8).when(twig, dark).when(cloud, white).otherwise(sky + 0.0005 * F.col("y")) + noise
    photos = wide.select("image_id", "y", "x", *(told(*v).alias(c) for c, v in look.items()))
    shutter = F.when(F.col("image_id") % 2 == 0, F.when(F.col("image_id") % 3 == 2, 1.0 / 4).otherwise(1.0 / 125))
    return photos, wide.select("image_id").distinct().select("image_id", S.scene_ev(F.lit(100.0), F.lit(8.0), shutter).alias("scene_ev"))


@query("mask_sky")
def mask_sky(s, d):
    """Coverage of the sky; null throughout photos without one."""
    return S.sky_masks(*_views(Library(s, d)), grid_edge=16)
