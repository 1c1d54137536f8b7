"""Queries over pixels: colour stages, stages by surroundings, geometry and statistics, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as O
from .adapters import Library
from .plans import colour as C
from .plans import detail as D
from .plans import geometry as G
from .plans import pixels as P
from .plans import statistics as S
from .registry import query

_Y = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"
_DEC = "CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4::DOUBLE) END"
_ENC = "CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * pow({v}, 1 / 2.4::DOUBLE) - 0.055 END"


def _rounded(df, digits=6):
    return df.select("image_id", "y", "x", *((F.round(c, digits) + 0.0).alias(c) for c in "rgb"))


def _channels(source: str, digits: int = 6, **exprs: str) -> str:
    return "SELECT image_id, y, x, " + ", ".join(f"round(({exprs[c]})::DOUBLE, {digits}) + 0.0 AS {c}" for c in "rgb") + f" FROM {source}"


def _point(name: str, stage, tables: list[str], source: str, digits: int = 6, **exprs: str):
    query(name, O.with_tables(O.PIXELS, *tables, body=_channels(source, digits, **exprs)))(lambda s, d: _rounded(P.plan([stage], Library(s, d).pixels()), digits))


# Curves.


def _cubic_sql(points: list[tuple[float, float]], x: str) -> str:
    """A monotone cubic through the points, in Hermite's form, with tangents as SQL."""
    gap = [f"({b[0]} - {a[0]})" for a, b in zip(points, points[1:])]
    slope = [f"(({b[1]} - {a[1]})::DOUBLE / {h})" for a, b, h in zip(points, points[1:], gap)]
    inner = [f"(CASE WHEN {s} * {t} <= 0 THEN 0 ELSE 3 * ({g} + {h}) / ((2 * {h} + {g}) / {s} + ({h} + 2 * {g}) / {t}) END)" for s, t, g, h in zip(slope, slope[1:], gap, gap[1:])]
    m = [slope[0], *inner, slope[-1]]
    out = f"CASE WHEN {x} <= {points[0][0]} THEN {points[0][1]}"
    for (x0, y0), (x1, y1), h, m0, m1 in zip(points, points[1:], gap, m, m[1:]):
        t = f"(({x} - {x0}) / {h})"
        out += f" WHEN {x} < {x1} THEN greatest(0, least(1, (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {y0} + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {h} * {m0} + (-2 * pow({t}, 3) + 3 * pow({t}, 2)) * {y1} + (pow({t}, 3) - pow({t}, 2)) * {h} * {m1}))"
    return out + f" ELSE {points[-1][1]} END"


_BENT = [(0.0, 0.0), (0.25, 0.2), (0.75, 0.85), (1.0, 1.0)]
_RED = [(0.0, 0.1), (0.5, 0.5), (1.0, 0.9)]
_LIFTED = [(0.0, 0.0), (0.125, 0.17), (0.375, 0.375), (0.625, 0.625), (0.875, 0.8525), (1.0, 1.0)]
_TONES = "v AS (SELECT image_id, y, x, " + ", ".join(_ENC.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))") + f" AS {c}" for c in "rgb") + " FROM pixels)"
_BENT_V = "w AS (SELECT image_id, y, x, " + ", ".join(f"{_cubic_sql(_BENT, c)} AS {c}" for c in "rgb") + " FROM v)"
_RED_V = f"u AS (SELECT image_id, y, x, {_cubic_sql(_RED, 'r')} AS r, g, b FROM w)"
_LIFT_V = "w AS (SELECT image_id, y, x, " + ", ".join(f"{_cubic_sql(_LIFTED, c)} AS {c}" for c in "rgb") + " FROM v)"
_decoded = {c: _DEC.format(v=c) for c in "rgb"}
_point("px_point_curve", C.curves(C.Curve.through(_BENT)), [_TONES, _BENT_V], "w", 6, **_decoded)
_point("px_channel_curves", C.curves(C.Curve.through(_BENT), channels=(C.Curve.through(_RED), C.Curve(), C.Curve())), [_TONES, _BENT_V, _RED_V], "u", 6, **_decoded)
_point("px_parametric_curve", C.curves(regions=C.parametric(shadows=40, highlights=-20)), [_TONES, _LIFT_V], "w", 6, **_decoded)

# Mixer: greens and blues moved.

_SQ = "q AS (SELECT *, sqrt(r) AS p0, sqrt(g) AS p1, sqrt(b) AS p2 FROM pixels), q1 AS (SELECT *, greatest(p0, p1, p2) AS top, greatest(p0, p1, p2) - least(p0, p1, p2) AS span FROM q)"
_HUE = "h AS (SELECT *, CASE WHEN raw < 0 THEN raw + 360 ELSE raw END AS hue FROM (SELECT *, 60 * CASE WHEN top = p0 THEN (p1 - p2) / span WHEN top = p1 THEN (p2 - p0) / span + 2 ELSE (p0 - p1) / span + 4 END AS raw FROM q1))"
_S = lambda t: f"({t}) * ({t}) * (3 - 2 * ({t}))"
_GREEN, _BLUE = (40.0, -50.0, 20.0), (-30.0, 60.0, -40.0)


def _band_sql(k: int) -> str:
    g, b = _GREEN[k], _BLUE[k]
    return (f"CASE WHEN hue >= 60 AND hue < 120 THEN {g} * {_S('(hue - 60) / 60')} WHEN hue >= 120 AND hue < 180 THEN {g} * (1 - {_S('(hue - 120) / 60')}) WHEN hue >= 180 AND hue < 225 THEN {b} * {_S('(hue - 180) / 45')} "
            f"WHEN hue >= 225 AND hue < 270 THEN {b} * (1 - {_S('(hue - 225) / 45')}) ELSE 0 END::DOUBLE")


_MIX = f"m AS (SELECT *, radians({_band_sql(0)} * 0.3) AS turn, 1 + {_band_sql(1)} / 100 AS chroma, pow(2::DOUBLE, {_band_sql(2)} / 100) AS gain, {_S('greatest(0, least(1, (span / top - 0.04) / 0.16))')} AS fade, (p0 + p1 + p2) / 3 AS mean FROM h)"
_TURN = "t AS (SELECT *, " + ", ".join(f"mean + ((p{i} - mean) * cos(turn) + (p{(i + 2) % 3} - p{(i + 1) % 3}) / sqrt(3) * sin(turn)) * chroma AS o{i}" for i in range(3)) + " FROM m)"
_LAST = "z AS (SELECT *, o0 * abs(o0) AS s0, o1 * abs(o1) AS s1, o2 * abs(o2) AS s2 FROM t), zz AS (SELECT *, 0.2126 * s0 + 0.7152 * s1 + 0.0722 * s2 AS yy FROM z)"
_SC = f"(CASE WHEN yy > 0.000000001 THEN {_Y} / yy ELSE 1 END * gain)"
_point("px_colour_mixer", C.mixer([(0, 0, 0), (0, 0, 0), (0, 0, 0), _GREEN, (0, 0, 0), _BLUE, (0, 0, 0), (0, 0, 0)]), [_SQ, _HUE, _MIX, _TURN, _LAST], "zz", 6,
       **{c: f"CASE WHEN top <= 0.000001 OR span <= 0 THEN {c} ELSE {c} + (s{i} * {_SC} - {c}) * fade END" for i, c in enumerate("rgb")})

# Grading: shadows to blue, highlights to red and darker. Fixed directions in Oklab of the full colours.


def _direction_sql(rgb: tuple[int, int, int]) -> tuple[str, str]:
    l, m, s = (f"cbrt({a} * {rgb[0]} + {b} * {rgb[1]} + {c} * {rgb[2]})" for a, b, c in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)))
    a, b = f"(1.9779984951 * {l} - 2.4285922050 * {m} + 0.4505937099 * {s})", f"(0.0259040371 * {l} + 0.7827717662 * {m} - 0.8086757660 * {s})"
    n = f"sqrt(pow({a}, 2) + pow({b}, 2))"
    return f"({a} / {n})", f"({b} / {n})"


_DS, _DH = _direction_sql((0, 0, 1)), _direction_sql((1, 0, 0))
_GR = [f"l AS (SELECT *, greatest(0, least(1, cbrt(greatest(0, {_Y})))) AS l FROM pixels)", "xq AS (SELECT *, pow(l, ln(0.5::DOUBLE) / ln(0.5646::DOUBLE)) AS xx FROM l)",
       "d AS (SELECT *, pow(xx, 3) * -0.5 * 0.12 AS dl, " + ", ".join(f"pow(1 - xx, 3) * 0.4 * 0.1 * {_DS[i]} + pow(xx, 3) * 0.6 * 0.1 * {_DH[i]} AS d{n}" for i, n in enumerate("ab")) + " FROM xq)",
       "e AS (SELECT *, greatest(0, l + dl) AS up, CASE WHEN l > 0 THEN least(4, pow(greatest(0, l + dl), 3) / pow(l, 3)) ELSE 1 END AS gain FROM d)",
       "f AS (SELECT *, pow(up + 0.39633778 * da + 0.21580376 * db, 3) AS u, pow(up - 0.105561346 * da - 0.06385417 * db, 3) AS v, pow(up - 0.08948418 * da - 1.2914855 * db, 3) AS w FROM e)"]
_TO = {"r": "4.0767417 * u - 3.3077116 * v + 0.23096993 * w", "g": "-1.268438 * u + 2.6097574 * v - 0.3413194 * w", "b": "-0.0041960863 * u - 0.7034186 * v + 1.7076147 * w"}
_point("px_colour_grading", C.grading(shadows=(240, 40, 0), highlights=(0, 60, -50)), _GR, "f", 6, **{c: f"{c} * gain + greatest(0, {_TO[c]}) - gain * pow(l, 3)" for c in "rgb"})
_DT = _direction_sql((0, 1, 0))
_TK = repr(3 * 2 ** 0.5)
_TINT = [_GR[0], _GR[1], "d AS (SELECT *, 0 AS dl, " + ", ".join(f"pow(1 - xx, {_TK}::DOUBLE) * 0.3 * 0.1 * {_DT[i]} AS d{n}" for i, n in enumerate("ab")) + " FROM xq)", _GR[3], _GR[4]]
_point("px_shadow_tint", C.shadow_tint(-50), _TINT, "f", 6, **{c: f"{c} * gain + greatest(0, {_TO[c]}) - gain * pow(l, 3)" for c in "rgb"})

# Grain.


def _lattice_sql(x: str, y: str) -> str:
    w = "4294967296::HUGEINT"
    h0 = f"xor((((({x}) % {w} + {w}) % {w}) * 2376512323::HUGEINT) % {w}, (((({y}) % {w} + {w}) % {w}) * 3625334849::HUGEINT) % {w})"
    return f"(SELECT (h3 & 16777215) / 8388607.5::DOUBLE - 1 FROM (SELECT xor(h2, h2 >> 15) AS h3 FROM (SELECT ((xor(h, h >> 13)::HUGEINT * 1540483477::HUGEINT) % {w})::BIGINT AS h2 FROM (SELECT ({h0})::BIGINT AS h))))"


def _noise_sql(k: str) -> str:
    cell = lambda i, j: _lattice_sql(f"floor(gx{k})::HUGEINT + {i}", f"floor(gy{k})::HUGEINT + {j}")
    sx, sy = (_S(f"g{a}{k} - floor(g{a}{k})") for a in "xy")
    row = lambda j: f"({cell(0, j)} + ({cell(1, j)} - {cell(0, j)}) * ({sx}))"
    return f"({row(0)} + ({row(1)} - {row(0)}) * ({sy}))"


_CELLS = "c1 AS (SELECT *, (x + 0.5) * (1500::DOUBLE / 64) AS gx1, (y + 0.5) * (1500::DOUBLE / 64) AS gy1 FROM (SELECT DISTINCT x, y FROM pixels)), c2 AS (SELECT *, 1.7 * (0.8660254 * gx1 - 0.5 * gy1) + 17.3 AS gx2, 1.7 * (0.5 * gx1 + 0.8660254 * gy1) + 5.1 AS gy2 FROM c1)"
_GRAIN = f"n AS (SELECT x, y, greatest(-1, least(1, 0.65 * {_noise_sql('1')} + 0.55 * {_noise_sql('2')})) AS noise FROM c2), gp AS (SELECT p.*, noise, greatest(0, least(1, {_Y})) AS yy FROM pixels p JOIN n USING (x, y))"
_point("px_grain", C.grain(60, 64, 64), [_CELLS, _GRAIN], "gp", 6, **{c: f"{c} * pow(2::DOUBLE, 0.6 * 0.35 * noise * 4 * yy * (1 - yy))" for c in "rgb"})

# White balance.


def _locus_sql(t: str, name: str, source: str) -> str:
    """CTEs name_x, name: columns u, v of the locus at kelvin t."""
    x = f"CASE WHEN {t} <= 4000 THEN -0.2661239e9 / pow({t}, 3) - 0.2343589e6 / pow({t}, 2) + 0.8776956e3 / {t} + 0.179910 ELSE -3.0258469e9 / pow({t}, 3) + 2.1070379e6 / pow({t}, 2) + 0.2226347e3 / {t} + 0.240390 END"
    y = f"CASE WHEN {t} <= 2222 THEN -1.1063814 * pow(lx, 3) - 1.34811020 * pow(lx, 2) + 2.18555832 * lx - 0.20219683 WHEN {t} <= 4000 THEN -0.9549476 * pow(lx, 3) - 1.37418593 * pow(lx, 2) + 2.09137015 * lx - 0.16748867 ELSE 3.0817580 * pow(lx, 3) - 5.87338670 * pow(lx, 2) + 3.75112997 * lx - 0.37001483 END"
    return f"{name}x AS (SELECT *, {x} AS lx FROM {source}), {name} AS (SELECT * EXCLUDE (lx), lx AS x_{name}, {y} AS y_{name} FROM {name}x)"


def _rgb_sql(n: str) -> list[str]:
    return [f"({a} * x_{n} / y_{n} + {b} + {c} * (1 - x_{n} - y_{n}) / y_{n})" for a, b, c in C.XYZ_TO_RGB]


_LIGHTS = "k AS (SELECT o_orderkey AS id, 2500.0::DOUBLE + o_orderkey % 50 * 150 AS shot, (o_orderkey % 21 - 10) * 10.0::DOUBLE AS t FROM orders), a AS (SELECT *, greatest(1667, least(25000, 1e6::DOUBLE / greatest(1, 1e6::DOUBLE / shot - t * 1.2))) AS assumed FROM k)"
_GAINS = "g AS (SELECT id, " + ", ".join(f"{x} / {y} AS g{i}" for i, (x, y) in enumerate(zip(_rgb_sql("p"), _rgb_sql("q")))) + " FROM q)"


@query("white_balance_gains", f"WITH {_LIGHTS}, {_locus_sql('shot', 'p', 'a')}, {_locus_sql('assumed', 'q', 'p')}, {_GAINS} SELECT id, " + ", ".join(f"round(g{i} / (0.2126 * g0 + 0.7152 * g1 + 0.0722 * g2), 6) AS gain_{c}" for i, c in enumerate("rgb")) + " FROM g")
def white_balance_gains(s, d):
    rows = Library(s, d)._read("orders").selectExpr("o_orderkey AS id", "2500.0D + o_orderkey % 50 * 150 AS shot", "(o_orderkey % 21 - 10) * 10.0D AS t")
    shot = (F.col("shot"), F.lit(0.0))
    g = rows.select("id", C.white_gains(*shot, *C.adjusted(*shot, F.col("t"), F.lit(0.0))).alias("g"))
    return g.select("id", *(F.round(f"g.{c}", 6).alias(f"gain_{c}") for c in "rgb"))


@query("white_point_of_light", "SELECT n AS id, (1700 + n * 230)::BIGINT AS kelvin, n % 5 - 2 AS duv_thousandths FROM range(0, 100) t(n)")
def white_point_of_light(s, d):
    """Lights along and beside the locus, told from their chromaticity alone."""
    rows = s.range(100).selectExpr("id", "1700.0D + id * 230 AS kelvin", "(id % 5 - 2) / 1000.0D AS duv")
    held = rows.select("id", C.chromaticity("kelvin", "duv").alias("c")).select("id", C.light_of("c.x", "c.y").alias("l"))
    return held.select("id", (F.round(F.col("l.kelvin") / 10) * 10).cast("long").alias("kelvin"), F.round(F.col("l.duv") * 1000).cast("long").alias("duv_thousandths"))


_XYZ = [f"({a} * r + {b} * g + {c} * b)" for a, b, c in C.RGB_TO_XYZ]


@query("px_chromaticity", O.with_tables(O.PIXELS, body=f"SELECT image_id, y AS row, x AS col, CASE WHEN t > 0.000001 THEN round(cx / t, 6) END AS cx, CASE WHEN t > 0.000001 THEN round(cy / t, 6) END AS cy FROM (SELECT *, {_XYZ[0]} AS cx, {_XYZ[1]} AS cy, {' + '.join(_XYZ)} AS t FROM pixels)"))
def px_chromaticity(s, d):
    x, y = C.chromaticity_of(P.rgb())
    return Library(s, d).pixels().select("image_id", F.col("y").alias("row"), F.col("x").alias("col"), F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"))


_RC = "v AS (SELECT image_id, y, x, " + ", ".join(f"{m[0]}::DOUBLE * r + ({m[1]})::DOUBLE * g + ({m[2]})::DOUBLE * b AS {c}" for m, c in zip(C.REC2020_TO_RGB, "rgb")) + " FROM pixels)"
_RS = repr((1.2 - 0.97) / (((1 - 0.97) / (1.2 - 0.97)) ** -1.2 - 1) ** (1 / 1.2))
_RT = "greatest(r, g, b)"
_point("px_from_rec2020", C.from_rec2020(), [_RC], "v", 6, **{c: f"CASE WHEN {_RT} <= 0 OR ({_RT} - {c}) / {_RT} < 0.97 THEN {c} ELSE {_RT} - (0.97 + (({_RT} - {c}) / {_RT} - 0.97) / pow(1 + pow((({_RT} - {c}) / {_RT} - 0.97) / {_RS}, 1.2::DOUBLE), {1 / 1.2!r}::DOUBLE)) * {_RT} END" for c in "rgb"})


@query("px_decode8_table", "SELECT v::INT AS code, floor(CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END * 65535 + 0.5)::BIGINT AS linear16 FROM range(0, 256) t(v)")
def px_decode8_table(s, d):
    return S.decode_table(s)


_E16 = "CAST(floor((" + _ENC + ") * 65535 + 0.5) AS INT)"


@query("px_encode16", O.with_tables(O.PIXELS, body="SELECT image_id, y, x, " + ", ".join(_E16.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))") + f" AS {c}" for c in "rgb") + " FROM pixels"))
def px_encode16(s, d):
    return Library(s, d).pixels().select("image_id", "y", "x", *(P.quantised(F.col(c), 16).alias(c) for c in "rgb"))


# Masks.

_OK = ["lms AS (SELECT *, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l_, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m_, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s_ FROM pixels)",
       "lab AS (SELECT *, 0.2104542553 * l_ + 0.7936177850 * m_ - 0.0040720468 * s_ AS ll, 1.9779984951 * l_ - 2.4285922050 * m_ + 0.4505937099 * s_ AS aa, 0.0259040371 * l_ + 0.7827717662 * m_ - 0.8086757660 * s_ AS bb FROM lms)"]
_PICKED = ((0.6, 0.05, -0.05), (0.7, -0.08, 0.06))
_SM = lambda lo, hi, x: _S(f"greatest(0, least(1, (({x}) - {lo}) / ({hi} - {lo})))")
_OUT = 0.02 + 0.24 * 0.5
_NEAR = ", ".join(f"1 - {_SM(repr(_OUT * 0.4), repr(_OUT), f'sqrt(pow(0.5 * (ll - {l}), 2) + pow(aa - ({a}), 2) + pow(bb - ({b}), 2))')}" for l, a, b in _PICKED)


@query("mask_colour_range", O.with_tables(O.PIXELS, *_OK, body=f"SELECT image_id, y, x, round(greatest(0, {_NEAR})::DOUBLE, 6) AS coverage FROM lab"))
def mask_colour_range(s, d):
    return Library(s, d).pixels().select("image_id", "y", "x", F.round(C.colour_mask(_PICKED, 50, P.rgb()), 6).alias("coverage"))


query("mask_luminance_range", O.with_tables(O.PIXELS, *_OK, body=f"SELECT image_id, y, x, round(({_SM('30', '40', 'll * 100')} * (1 - {_SM('70', '80', 'll * 100')}))::DOUBLE, 6) AS coverage FROM lab"))(
    lambda s, d: Library(s, d).pixels().select("image_id", "y", "x", F.round(P.luminance_mask(40.0, 70.0, 10.0, P.rgb()), 6).alias("coverage")))

_DIAG = "sqrt(2::DOUBLE) * 64"
_EL = f"sqrt(pow(((x + 0.5 - 25.6) * cos(radians(30)) + (y + 0.5 - 38.4) * sin(radians(30))) / (0.3 * {_DIAG}), 2) + pow(((y + 0.5 - 38.4) * cos(radians(30)) - (x + 0.5 - 25.6) * sin(radians(30))) / (0.2 * {_DIAG}), 2))"
_MR = f"(1 - (1 - {_SM('0.6', '1.0', _EL)})) * 0.8"
_WARM = (0.2, 0.0, -0.2)
_point("mask_local_warmth", lambda t: C.local([(C.scaled(C.radial_mask((0.4, 0.6), (0.3, 0.2), 30, 40, 64, 64), True, 0.8), -0.5, _WARM)])(t), [], "pixels", 6, **{c: f"{c} * pow(2::DOUBLE, {_MR} * ({-0.5 + w}))" for c, w in zip("rgb", _WARM)})

# Surroundings.


def _win(cols: list[str], src: str, name: str, r: int) -> str:
    w = "(PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN " + f"{r} PRECEDING AND {r} FOLLOWING)"
    return (f"{name}_h AS (SELECT *, " + ", ".join(f"avg({c}) OVER {w.format('y', 'x')} AS {c}_h" for c in cols) + f" FROM {src}), {name} AS (SELECT * EXCLUDE ({', '.join(c + '_h' for c in cols)}), "
            + ", ".join(f"avg({c}_h) OVER {w.format('x', 'y')} AS {c}_m" for c in cols) + f" FROM {name}_h)")


def _low(col: str, src: str, name: str, r: int) -> str:
    w = "(PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN " + f"{r} PRECEDING AND {r} FOLLOWING)"
    return f"{name}_h AS (SELECT *, min({col}) OVER {w.format('y', 'x')} AS lo_h FROM {src}), {name} AS (SELECT * EXCLUDE (lo_h), min(lo_h) OVER {w.format('x', 'y')} AS low_{name} FROM {name}_h)"


_CELL = "sc AS (SELECT image_id, y // 4 AS y, x // 4 AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY image_id, y // 4, x // 4)"
_AIR = [_low("d0", "(SELECT *, least(r, g, b) AS d0 FROM sc)", "k1", 2), "ar AS (SELECT image_id, greatest(0.0001, avg(r)) AS ar, greatest(0.0001, avg(g)) AS ag, greatest(0.0001, avg(b)) AS ab FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY low_k1 DESC, y, x) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM k1) WHERE nth <= greatest(1, ceil(n * 0.001)) GROUP BY image_id)",
        "ay AS (SELECT *, greatest(0.0001, 0.2126 * ar + 0.7152 * ag + 0.0722 * ab) AS ay FROM ar)"]


def _guided_sql(src: str, eps: str, r: int, p: str) -> str:
    """CTEs from columns gu and iv of src; the last one, p, has ga and gb."""
    one = f"{p}0 AS (SELECT *, gu * gu AS gg, gu * iv AS gi FROM {src}), " + _win(["gu", "iv", "gg", "gi"], f"{p}0", f"{p}1", r)
    two = f", {p}2 AS (SELECT * EXCLUDE (gu_m, iv_m, gg_m, gi_m), (gi_m - gu_m * iv_m) / (greatest(0, gg_m - gu_m * gu_m) + {eps}) AS sa, iv_m - (gi_m - gu_m * iv_m) / (greatest(0, gg_m - gu_m * gu_m) + {eps}) * gu_m AS sb FROM {p}1), "
    return one + two + _win(["sa", "sb"], f"{p}2", f"{p}3", r) + f", {p} AS (SELECT image_id, y, x, sa_m AS ga, sb_m AS gb FROM {p}3)"


def _between_sql(model: str, name: str) -> str:
    """Pixels of 64 by 64 with ga and gb between the cells of a map of 16 by 16."""
    at = lambda c: f"(({c} + 0.5) / 4 - 0.5)"
    cells = ", ".join(f"greatest(0, least(m{c}, floor({at(f'p.{c}')}) + {k}))::INT AS {c}{k}" for c in "yx" for k in (0, 1))
    held = f"{name}e AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM {model} GROUP BY image_id), {name}c AS MATERIALIZED (SELECT p.*, {cells} FROM pixels p JOIN {name}e USING (image_id)), {name}m AS MATERIALIZED (SELECT * FROM {model})"
    joins = " ".join(f"JOIN {name}m m{j}{i} ON m{j}{i}.image_id = p.image_id AND m{j}{i}.y = p.y{j} AND m{j}{i}.x = p.x{i}" for j in (0, 1) for i in (0, 1))
    tx, ty = (f"greatest(0, least(1, {at(f'p.{c}')} - p.{c}0))" for c in "xy")
    mid = lambda n: f"(m00.{n} + (m01.{n} - m00.{n}) * {tx}) + ((m10.{n} + (m11.{n} - m10.{n}) * {tx}) - (m00.{n} + (m01.{n} - m00.{n}) * {tx})) * {ty} AS {n}"
    return f"{held}, {name} AS MATERIALIZED (SELECT p.* EXCLUDE (y0, y1, x0, x1), {mid('ga')}, {mid('gb')} FROM {name}c p {joins})"


_HAZE = [_CELL, *_AIR, _low("d1", "(SELECT sc.*, ay.ar, ay.ag, ay.ab, ay.ay, least(r / ar, g / ag, b / ab) AS d1 FROM sc JOIN ay USING (image_id))", "k2", 2),
         f"hz AS (SELECT image_id, y, x, {_Y} / ay AS gu, greatest(0, least(1, 1 - 0.9 * low_k2)) AS iv FROM k2)", _guided_sql("hz", "0.001::DOUBLE", 3, "gm"), _between_sql("gm", "pm"), f"dz AS (SELECT pm.*, ay.ar, ay.ag, ay.ab, greatest(0, least(1, ga * {_Y} / ay.ay + gb)) AS t FROM pm JOIN ay USING (image_id))"]
_TE = "greatest(0.2, 1 - 0.6 * (1 - t))"


@query("px_dehaze", O.with_tables(O.PIXELS, *_HAZE, body=_channels("dz", 5, **{c: f"greatest(0, {c} / {_TE} + a{c} * (1 - 1 / {_TE}))" for c in "rgb"})))
def px_dehaze(s, d):
    return _rounded(D.dehazed(Library(s, d).pixels(), 64, 16, 60, patch=2, radius=3), 5)


_LG = f"log2(greatest({_Y}, 0.000001))"
_TM = [_CELL, f"tl AS (SELECT image_id, y, x, {_LG} AS gu, {_LG} AS iv FROM sc)", _guided_sql("tl", "0.25::DOUBLE", 3, "gm"), _between_sql("gm", "pm"), f"tn AS (SELECT *, -(ga * {_LG} + gb) AS below FROM pm)"]


@query("px_tone_local", O.with_tables(O.PIXELS, *_TM, body=_channels("tn", 5, **{c: f"{c} * pow(2::DOUBLE, 0.5 * 2.0 * {_SM('2.0', '5.5', 'below')} - 0.4 * 1.5 * (1 - {_SM('0.25', '3.0', 'below')}))" for c in "rgb"})))
def px_tone_local(s, d):
    return _rounded(D.toned(Library(s, d).pixels(), 64, 16, 50, -40, radius=3), 5)


_LY = f"ly AS (SELECT *, {_LG} AS l FROM pixels)"
_B2 = _win(["l"], "ly", "b1", 1) + ", b1r AS (SELECT * EXCLUDE (l_m), l_m AS s1 FROM b1), " + _win(["s1"], "b1r", "b2", 1)
_BIN = ("bv AS (SELECT *, (coalesce(lag(l) OVER w, l) + 2 * l + coalesce(lead(l) OVER w, l)) / 4 AS v FROM b2 WINDOW w AS (PARTITION BY image_id, x ORDER BY y)), "
        "bh AS (SELECT *, (coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v)) / 4 AS sharp FROM bv WINDOW w AS (PARTITION BY image_id, y ORDER BY x))")
_FADE = f"(1 - {_SM('6.0', '10.0', '-l')})"


@query("px_texture", O.with_tables(O.PIXELS, _LY, _B2, body=_channels("b2", 5, **{c: f"{c} * pow(2::DOUBLE, greatest(-1.5, least(1.5, {_FADE} * 0.6 * (l - s1_m))))" for c in "rgb"})))
def px_texture(s, d):
    return _rounded(D.detailed(Library(s, d).pixels(), 64, 64, texture=60), 5)


_CL = "cl AS MATERIALIZED (SELECT b2.*, -tn.below AS base FROM b2 JOIN tn USING (image_id, y, x))"
_MEDIUM = f"({_SM('0.0', '1.5', '-l')} * (1 - {_SM('7.0', '11.0', '-l')}) * (s1_m - base))"


@query("px_clarity", O.with_tables(O.PIXELS, _LY, _B2, *_TM, _CL, body=_channels("cl", 5, **{c: f"{c} * pow(2::DOUBLE, greatest(-1.5, least(1.5, 0.7 * 2.0 * {_MEDIUM})))" for c in "rgb"})))
def px_clarity(s, d):
    held = D.surroundings(Library(s, d).pixels(), 64, 16, radius=3)
    return _rounded(D.detailed(held, 64, 64, clarity=70, base="base"), 5)


# A clarity of its own within an ellipse, as a mask's adjustment.


@query("mask_local_clarity", O.with_tables(O.PIXELS, _LY, _B2, *_TM, _CL, body=_channels("cl", 5, **{c: f"{c} * pow(2::DOUBLE, greatest(-1.5, least(1.5, (0.2 + 0.6 * (1 - {_SM('0.6', '1.0', _EL)})) * 2.0 * {_MEDIUM})))" for c in "rgb"})))
def mask_local_clarity(s, d):
    inside = C.radial_mask((0.4, 0.6), (0.3, 0.2), 30, 40, 64, 64)
    held = D.surroundings(Library(s, d).pixels(), 64, 16, radius=3)
    return _rounded(D.detailed(held, 64, 64, clarity=20.0 + inside * 60.0, base="base"), 5)


@query("px_sharpening", O.with_tables(O.PIXELS, _LY, _B2, _BIN, body=_channels("bh", 5, **{c: f"{c} * pow(2::DOUBLE, greatest(-0.5, least(0.5, {_FADE} * 0.8 * 1.5 * (l - sharp))))" for c in "rgb"})))
def px_sharpening(s, d):
    return _rounded(D.detailed(Library(s, d).pixels(), 64, 64, sharpening=80), 5)


_NB = "CASE WHEN {m} < 0 THEN -{m} ELSE 0 END"
_EPS = "(pow(2 * 0.5 * least(0.6, 0.03 * pow(2::DOUBLE, 0.5 * greatest(0, -l_m))), 2) + 0.00000001)"
_DN = ["dn0 AS (SELECT *, l * l AS ll FROM ly)", _win(["l", "ll"], "dn0", "dn1", 1), f"dn2 AS (SELECT * EXCLUDE (l_m, ll_m), greatest(0, ll_m - l_m * l_m) / (greatest(0, ll_m - l_m * l_m) + {_EPS}) AS sa, l_m - greatest(0, ll_m - l_m * l_m) / (greatest(0, ll_m - l_m * l_m) + {_EPS}) * l_m AS sb FROM dn1)", _win(["sa", "sb"], "dn2", "dn3", 1)]


@query("px_denoise_luma", O.with_tables(O.PIXELS, _LY, *_DN, body=_channels("dn3", 5, **{c: f"{c} * pow(2::DOUBLE, greatest(-1.5, least(1.5, sa_m * l + sb_m - l)))" for c in "rgb"})))
def px_denoise_luma(s, d):
    return _rounded(D.detailed(Library(s, d).pixels(), 64, 64, noise=50), 5)


_CE = repr((0.3 * 0.5) ** 2 + 1e-6)
_CN = [f"cn AS (SELECT image_id, y, x, {_LG} AS i, r / greatest({_Y}, 0.000001) AS q, b / greatest({_Y}, 0.000001) AS z FROM pixels)", "cn0 AS (SELECT *, i * i AS ii, i * q AS iq, i * z AS iz FROM cn)", _win(["i", "q", "z", "ii", "iq", "iz"], "cn0", "cn1", 2),
       f"cn2 AS (SELECT image_id, y, x, i, (iq_m - i_m * q_m) / (greatest(0, ii_m - i_m * i_m) + {_CE}) AS aq, (iz_m - i_m * z_m) / (greatest(0, ii_m - i_m * i_m) + {_CE}) AS az, i_m, q_m, z_m FROM cn1)", "cn3 AS (SELECT image_id, y, x, i, aq, az, q_m - aq * i_m AS oq, z_m - az * i_m AS oz FROM cn2)", _win(["aq", "az", "oq", "oz"], "cn3", "cn4", 2)]


@query("px_denoise_colour", O.with_tables(O.PIXELS, *_CN, body="SELECT image_id, y, x, round(aq_m * i + oq_m, 5) AS ratio_r, round(az_m * i + oz_m, 5) AS ratio_b FROM cn4"))
def px_denoise_colour(s, d):
    return D.quiet_colour(Library(s, d).pixels(), 50, 2).select("image_id", "y", "x", F.round("ratio_r", 5).alias("ratio_r"), F.round("ratio_b", 5).alias("ratio_b"))


# Geometry and sizes.


@query("px_quarter_turn", O.with_tables(O.PIXELS, body="SELECT image_id, CAST(x AS INT) AS y, CAST(63 - y AS INT) AS x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pixels"))
def px_quarter_turn(s, d):
    return _rounded(G.turned(Library(s, d).pixels(), 1, False, 64, 64))


@query("px_flip_half_turn", O.with_tables(O.PIXELS, body="SELECT image_id, CAST(63 - y AS INT) AS y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pixels"))
def px_flip_half_turn(s, d):
    return _rounded(G.turned(Library(s, d).pixels(), 2, True, 64, 64))


_OR = "(VALUES (1, 0, 0), (2, 0, 1), (3, 2, 0), (4, 2, 1), (5, 3, 1), (6, 1, 0), (7, 1, 1), (8, 3, 0)) t(o, turns, flip)"


@query("exif_orientations", f"SELECT (o_orderkey % 10)::INT AS orientation, coalesce(turns, 0)::INT AS turns, coalesce(flip, 0) = 1 AS flipped, count(*) AS n FROM orders LEFT JOIN {_OR} ON o = o_orderkey % 10 GROUP BY ALL")
def exif_orientations(s, d):
    rows = Library(s, d)._read("orders").select((F.col("o_orderkey") % 10).cast("int").alias("orientation"))
    turns, flipped = G.from_exif(F.col("orientation"))
    return rows.groupBy("orientation", turns.alias("turns"), flipped.alias("flipped")).agg(F.count("*").alias("n"))


_SRC = "s AS (SELECT image_id, j AS y, i AS x, 8 + (i + 0.5) * 1.5 - 0.5 AS sx, 4 + (j + 0.5) * 1.75 - 0.5 AS sy FROM (SELECT DISTINCT image_id FROM pixels), range(0, 32) t(i), range(0, 32) u(j))"
_TAPS = "tp AS MATERIALIZED (SELECT s.*, " + ", ".join(f"greatest(0, least(m{c}, floor(s{c}) + {k}))::INT AS {c}{k}" for c in "yx" for k in (0, 1)) + " FROM s JOIN n USING (image_id)), px AS MATERIALIZED (SELECT * FROM pixels)"
_BI = " ".join(f"JOIN px p{j}{i} ON p{j}{i}.image_id = tp.image_id AND p{j}{i}.y = tp.y{j} AND p{j}{i}.x = tp.x{i}" for j in (0, 1) for i in (0, 1))
_MID = lambda c: f"round((p00.{c} + (p01.{c} - p00.{c}) * (sx - floor(sx))) + ((p10.{c} + (p11.{c} - p10.{c}) * (sx - floor(sx))) - (p00.{c} + (p01.{c} - p00.{c}) * (sx - floor(sx)))) * (sy - floor(sy)), 12) + 0.0 AS {c}"


_ENDS = "n AS (SELECT image_id, max(y) AS my, max(x) AS mx FROM pixels GROUP BY image_id)"


@query("px_crop", O.with_tables(O.PIXELS, _SRC, _ENDS, _TAPS, body=f"SELECT tp.image_id, tp.y::INT AS y, tp.x::INT AS x, {', '.join(map(_MID, 'rgb'))} FROM tp {_BI}"))
def px_crop(s, d):
    """Every image cut alike; where one ends before its frame does, its last line or column goes on."""
    crop = (8 / 64, 4 / 64, 48 / 64, 56 / 64)
    return _rounded(G.resampled(G.filled(Library(s, d).pixels(), 64, 64), 64, 64, 32, 32, G.mapping(64, 64, crop)), 12)


def _parts_sql(axis: str, n: int, m: int) -> str:
    """Rows (o, i, w): how much of pixel i lies in cell o."""
    return f"p{axis} AS (SELECT o, i, least((o + 1) * {n}::DOUBLE / {m}, i + 1) - greatest(o * {n}::DOUBLE / {m}, i) AS w FROM range(0, {m}) a(o), range(0, {n}) b(i) WHERE least((o + 1) * {n}::DOUBLE / {m}, i + 1) - greatest(o * {n}::DOUBLE / {m}, i) > 0.000000001)"


@query("px_resize_wide", O.with_tables(O.PIXELS, "wide AS (SELECT * FROM pixels WHERE y < 48)", _parts_sql("x", 64, 20), _parts_sql("y", 48, 15), body="SELECT image_id, py.o::INT AS y, px.o::INT AS x, " + ", ".join(f"round(sum({c} * px.w * py.w) / sum(px.w * py.w), 8) + 0.0 AS {c}" for c in "rgb") + " FROM wide JOIN px ON px.i = x JOIN py ON py.i = y GROUP BY image_id, py.o, px.o"))
def px_resize_wide(s, d):
    """Images of 64 by 48 with a long edge of 20."""
    return _rounded(G.fit(Library(s, d).pixels().filter("y < 48"), 64, 48, 20), 8)


query("px_resize", O.with_tables(O.PIXELS, _parts_sql("x", 64, 20), _parts_sql("y", 64, 20), body="SELECT image_id, py.o::INT AS y, px.o::INT AS x, " + ", ".join(f"round(sum({c} * px.w * py.w) / sum(px.w * py.w), 8) AS {c}" for c in "rgb") + " FROM pixels JOIN px ON px.i = x JOIN py ON py.i = y GROUP BY image_id, py.o, px.o"))(
    lambda s, d: P.resized(Library(s, d).pixels(), 64, 20).select("image_id", "y", "x", *(F.round(c, 8).alias(c) for c in "rgb")))


@query("fitted_sizes", "SELECT o_orderkey AS id, CASE WHEN l = 0 OR greatest(w, h) <= l THEN w WHEN w >= h THEN l ELSE greatest(1, round(w * l::DOUBLE / h))::BIGINT END AS width, CASE WHEN l = 0 OR greatest(w, h) <= l THEN h WHEN w >= h THEN greatest(1, round(h * l::DOUBLE / w))::BIGINT ELSE l END AS height FROM (SELECT o_orderkey, 100 + o_orderkey % 997 * 7 AS w, 90 + o_orderkey % 463 * 11 AS h, o_orderkey % 5 * 512 AS l FROM orders)")
def fitted_sizes(s, d):
    rows = Library(s, d)._read("orders").selectExpr("o_orderkey AS id", "100 + o_orderkey % 997 * 7 AS w", "90 + o_orderkey % 463 * 11 AS h", "o_orderkey % 5 * 512 AS l")
    w, h = G.fitted(F.col("w"), F.col("h"), F.col("l"))
    return rows.select("id", w.alias("width"), h.alias("height"))


@query("pyramid_levels", "SELECT o_orderkey AS id, (SELECT max(l) FROM range(0, 6) t(l) WHERE l = 0 OR 6000 >> l >= 1 + o_orderkey % 6500)::INT AS level FROM orders")
def pyramid_levels(s, d):
    rows = Library(s, d)._read("orders").selectExpr("o_orderkey AS id", "cast(1 + o_orderkey % 6500 AS int) AS wanted")
    return rows.select("id", G.level_for(F.lit(6000), F.lit(4000), F.col("wanted"), F.lit(1), 5).alias("level"))


@query("export_estimates", "SELECT o_orderkey AS id, round(f * (100000 + o_orderkey % 5000) * pow((1000000 + o_orderkey % 20 * 1000000) / 700000.0::DOUBLE, e))::BIGINT AS bytes FROM orders JOIN (VALUES (0, 0.903::DOUBLE, 0.9::DOUBLE), (1, 0.959, 0.937), (2, 0.994, 0.985)) t(k, e, f) ON k = o_orderkey % 3")
def export_estimates(s, d):
    rows = Library(s, d)._read("orders").selectExpr("o_orderkey AS id", "element_at(array('jpeg', 'png', 'tiff'), cast(o_orderkey % 3 + 1 AS int)) AS format", "100000 + o_orderkey % 5000 AS bytes", "1000000 + o_orderkey % 20 * 1000000 AS pixels")
    return rows.select("id", G.estimated(F.col("bytes"), F.lit(700000), F.col("pixels"), F.col("format")).alias("bytes"))


# Statistics.

_E8 = "CAST(floor((" + _ENC + ") * 255 + 0.5) AS INT)"
_EIGHT = "e AS (SELECT image_id, y, x, " + ", ".join(_E8.format(v=f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))") + f" AS {c}" for c in "rgb") + " FROM pixels)"
_LU = "((54 * r + 183 * g + 19 * b + 128) >> 8)"


@query("px_tone_stats", O.with_tables(O.PIXELS, _EIGHT, body=f"SELECT image_id, round(sum(greatest(r, g, b) - least(r, g, b)) / (255.0::DOUBLE * count(*)), 6) AS colourfulness, round(count(*) FILTER ({_LU} >= 205) / count(*)::DOUBLE, 6) AS bright, round(count(*) FILTER ({_LU} < 76) / count(*)::DOUBLE, 6) AS dark FROM e GROUP BY image_id"))
def px_tone_stats(s, d):
    eight = Library(s, d).pixels().select("image_id", *(P.quantised(F.col(c)).alias(c) for c in "rgb"))
    return S.tone_stats(eight, 0.8, 0.3).select("image_id", *(F.round(c, 6).alias(c) for c in ("colourfulness", "bright", "dark")))


@query("px_white_point_gains", O.with_tables(O.PIXELS, body="SELECT image_id, round(greatest(-4, least(10, v)), 6) AS white_stops FROM (SELECT image_id, -log2(greatest(0.2126 * r * 1.2 + 0.7152 * g + 0.0722 * b * 0.8, 0.000001)) AS v, row_number() OVER (PARTITION BY image_id ORDER BY -log2(greatest(0.2126 * r * 1.2 + 0.7152 * g + 0.0722 * b * 0.8, 0.000001))) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM pixels WHERE y % 2 = 0 AND x % 2 = 0) WHERE nth = floor(n * 0.005) + 1"))
def px_white_point_gains(s, d):
    return S.white_point(Library(s, d).pixels(), (1.2, 1.0, 0.8), 2.0).withColumn("white_stops", F.round("white_stops", 6))


@query("coverage_share", O.with_tables(O.PIXELS, body="SELECT image_id, round(avg(CASE WHEN r > 0.5 THEN 1.0 ELSE r END), 6) AS share FROM pixels GROUP BY image_id"))
def coverage_share(s, d):
    cover = Library(s, d).pixels().select("image_id", F.when(F.col("r") > 0.5, 1.0).otherwise(F.col("r")).alias("coverage"))
    return S.share(cover).withColumn("share", F.round("share", 6))


# One recipe end to end.

_WB = "a1 AS (SELECT image_id, y, x, r * 1.05 * pow(2, 0.3::DOUBLE) AS r, g * pow(2, 0.3::DOUBLE) AS g, b * 0.95 * pow(2, 0.3::DOUBLE) AS b FROM pixels)"
_DD = f"(-log2(greatest({_Y}, 0.000001)))"
_T2 = f"a2 AS (SELECT image_id, y, x, " + ", ".join(f"{c} * pow(2::DOUBLE, 0.1 * (1 - {_SM('0.0', '1.5', _DD)}) - 0.2 * 1.5 * {_SM('4.0', '8.0', _DD)}) AS {c}" for c in "rgb") + " FROM a1)"
_VG = f"a3 AS (SELECT image_id, y, x, " + ", ".join(f"{c} * pow(2::DOUBLE, -0.4 * 1.5 * {_SM('0.3', '1.0', 'sqrt((pow((x + 0.5) / 32 - 1, 2) + pow((y + 0.5) / 32 - 1, 2)) * 0.5)')}) AS {c}" for c in "rgb") + " FROM a2)"
_CG, _CM = repr(2.0 ** (0.15 * 0.8)), repr(0.18 ** (1 / 2.2))
_P22 = "pow({c}, 1 / 2.2::DOUBLE)"
_CT = "a4 AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN {c} >= 0 AND {c} < 1 THEN pow(CASE WHEN {_P22.format(c=c)} <= {_CM} THEN {_CM} * pow({_P22.format(c=c)} / {_CM}, {_CG}) ELSE 1 - (1 - {_CM}) * pow((1 - {_P22.format(c=c)}) / (1 - {_CM}), {_CG}) END, 2.2::DOUBLE) ELSE greatest({c}, 0) END AS {c}" for c in "rgb") + " FROM a3)"
_TOP = repr(1.0 / (1.0 + (0.55 / 2.3784142) ** 1.65))
_BC = "a5 AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN {c} <= 0 THEN 0 WHEN {c} >= 1 THEN {c} ELSE 1 / (1 + pow(0.55 / ({c} * 2.3784142), 1.65::DOUBLE)) / {_TOP} END AS {c}" for c in "rgb") + " FROM a4)"
_G3, _L3 = "greatest(r, g, b)", "least(r, g, b)"
_SEC = f"(60 * CASE WHEN {_G3} = r THEN (g - b) / ({_G3} - {_L3}) WHEN {_G3} = g THEN (b - r) / ({_G3} - {_L3}) + 2 ELSE (r - g) / ({_G3} - {_L3}) + 4 END)"
_HU = f"({_SEC} - 360 * floor({_SEC} / 360))"
_SK = f"greatest(0, 1 - abs(({_HU} + 160) - 360 * floor(({_HU} + 160) / 360) - 180) / 20)"
_ST = f"sqrt(greatest({_L3}, 0) / {_G3})"
_VB = "a6 AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN {_G3} <= 0 OR {_G3} = {_L3} THEN {c} ELSE {_Y} + ({c} - {_Y}) * (1 + 0.25 * {_ST} * {_ST} * (1 - 0.6 * {_SK})) END AS {c}" for c in "rgb") + " FROM a5)"
_SA = "a7 AS (SELECT image_id, y, x, " + ", ".join(f"{_Y} + ({c} - {_Y}) * 1.05 AS {c}" for c in "rgb") + " FROM a6)"
_GS = repr((1.3 - 0.97) / (((1 - 0.97) / (1.3 - 0.97)) ** -1.2 - 1) ** (1 / 1.2))
_GA = "a8 AS (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN {_G3} <= 0 OR ({_G3} - {c}) / {_G3} < 0.97 THEN {c} ELSE {_G3} - (0.97 + (({_G3} - {c}) / {_G3} - 0.97) / pow(1 + pow((({_G3} - {c}) / {_G3} - 0.97) / {_GS}, 1.2::DOUBLE), 1 / 1.2::DOUBLE)) * {_G3} END AS {c}" for c in "rgb") + " FROM a7)"


@query("px_recipe_linear", O.with_tables(O.PIXELS, _WB, _T2, _VG, _CT, _BC, _VB, _SA, _GA, body=_channels("a8", 5, r="r", g="g", b="b")))
def px_recipe_linear(s, d):
    """The stages of px_pipeline, before codes are rounded."""
    stages = [P.white_balance((1.05, 1.0, 0.95)), P.exposure(0.3), P.tone_ends(10, -20), P.vignette(-40, 64, 64), P.contrast(15), P.base_curve(), P.vibrance(25), P.saturation(5), P.gamut()]
    return _rounded(P.plan(stages, Library(s, d).pixels()), 5)
