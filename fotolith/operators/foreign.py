"""Presets of other programs: files of settings as XMP, or as nested tables of Lua, read into looks, with a list of what has no counterpart.

Texts become a map of values and a map of lists in the tasks that read them; what they mean is said in column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import recipe as R

# The settings' prefix in XMP, names of settings that have a counterpart, bands of colours, and what is told of those that have none.
PREFIX = "crs:"
SLIDERS = {
    "Exposure2012": "exposure", "Contrast2012": "contrast", "Highlights2012": "highlights", "Shadows2012": "shadows", "Whites2012": "whites", "Blacks2012": "blacks", "Texture": "texture", "Clarity2012": "clarity", "Dehaze": "dehaze",
    "Vibrance": "vibrance", "Saturation": "saturation", "IncrementalTemperature": "temperature", "IncrementalTint": "tint", "Sharpness": "sharpening", "LuminanceSmoothing": "noiseReduction", "PostCropVignetteAmount": "vignette", "GrainAmount": "grain",
}
BANDS = ("Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta")
SHIFTS = ("Hue", "Saturation", "Luminance")
CURVE = "ToneCurvePV2012"
REGIONS = {"shadows": ("ParametricShadows", 0.0), "darks": ("ParametricDarks", 0.0), "lights": ("ParametricLights", 0.0), "highlights": ("ParametricHighlights", 0.0), "shadowSplit": ("ParametricShadowSplit", 25.0), "midtoneSplit": ("ParametricMidtoneSplit", 50.0), "highlightSplit": ("ParametricHighlightSplit", 75.0)}
WHEELS = {"shadows": "Shadow", "midtones": "Midtone", "highlights": "Highlight", "global": "Global"}
CALIBRATION = {"shadowTint": "ShadowTint", "redHue": "RedHue", "redSaturation": "RedSaturation", "greenHue": "GreenHue", "greenSaturation": "GreenSaturation", "blueHue": "BlueHue", "blueSaturation": "BlueSaturation"}
MASKS = ("MaskGroupBasedCorrections", "GradientBasedCorrections", "CircularGradientBasedCorrections", "PaintBasedCorrections", "RetouchAreas")
OPTICS = ("LensManualDistortionAmount", "DefringePurpleAmount", "DefringeGreenAmount")
PERSPECTIVE = ("PerspectiveVertical", "PerspectiveHorizontal", "PerspectiveRotate", "PerspectiveScale")
STANDARD_COLOUR_NOISE = 25.0
#: How deep tables may be nested.
DEEPEST = 16

Settings = tuple[dict[str, str], dict[str, list[str]]]


def xmp_settings(text: str) -> Settings | None:
    """Values and lists of the settings in a packet; null where there are none, or it is no XML."""
    values: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    open_: list[tuple[str | None, list[str]]] = []

    def outer() -> list[str]:
        return [name for name, _ in open_ if name]

    def start(name: str, attributes: dict[str, str]) -> None:
        top = not outer()
        if top:
            values.update({k[len(PREFIX) :]: v for k, v in attributes.items() if k.startswith(PREFIX)})
        setting = name[len(PREFIX) :] if name.startswith(PREFIX) else None
        if setting and top:
            lists.setdefault(setting, [])
        open_.append((setting, []))

    def end(name: str) -> None:
        setting, said = open_.pop()
        value, above = "".join(said).strip(), outer()
        if setting and not above and value:
            values.setdefault(setting, value)
        elif not setting and name == "rdf:li" and len(above) == 1:
            lists[above[0]].append(value)

    reader = expat.ParserCreate()
    reader.StartElementHandler, reader.EndElementHandler = start, end
    reader.CharacterDataHandler = lambda said: open_ and open_[-1][1].append(said)
    try:
        reader.Parse(text.lstrip("﻿").encode(), True)
    except (expat.ExpatError, UnicodeEncodeError):
        return None
    return (values, lists) if values or lists else None


_TOKEN = re.compile(r"""\s+|--[^\n]*|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>[-+.0-9][-+.0-9eE]*)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[{}=,;])""", re.S)


class _Tables:
    """A recursive reader of tables: a list of (name or nothing, value), where a value is a number, text, truth or a table."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(text[at : at + 1])
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def named(self) -> str | None:
        """The name of `name =`, if that comes next."""
        (kind, name), (_, mark) = self.tokens[self.at], self.tokens[min(self.at + 1, len(self.tokens) - 1)]
        if kind == "name" and mark == "=":
            self.at += 2
            return name
        return None

    def value(self, depth: int = 0):
        kind, said = self.next()
        if depth > DEEPEST:
            raise ValueError("too deep")
        if kind == "text":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), said[1:-1], flags=re.S)
        if kind == "number":
            return float(said)
        if said in ("true", "false") and kind == "name":
            return said == "true"
        if said != "{":
            raise ValueError(said)
        out = []
        while self.tokens[self.at][1] != "}":
            out.append((self.named(), self.value(depth + 1)))
            if self.tokens[self.at][1] in (",", ";"):
                self.at += 1
            elif self.tokens[self.at][1] != "}":
                raise ValueError(self.tokens[self.at][1])
        self.at += 1
        return out


def _shown(n: float) -> str:
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)


def lua_settings(text: str) -> Settings | None:
    """The same from a file of nested tables; flat lists of numbers are curves' points. The name may follow a key of translation."""
    try:
        reader = _Tables(text.lstrip("﻿"))
        reader.named()
        root = reader.value()
        if reader.next()[0] != "end":
            return None
    except (ValueError, OverflowError):
        return None
    field = lambda table, name: next((v for k, v in table if k == name), None) if isinstance(table, list) else None
    settings = field(field(root, "value"), "settings")
    if not isinstance(settings, list):
        return None
    values: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    for key, v in settings:
        if key is None:
            continue
        if isinstance(v, list):
            numbers = [n for _, n in v if isinstance(n, float)]
            lists[key] = [f"{_shown(x)}, {_shown(y)}" for x, y in zip(numbers[::2], numbers[1::2], strict=False)]
        else:
            values[key] = str(v) if isinstance(v, bool) else _shown(v) if isinstance(v, float) else v
    title = next((t for t in (field(root, "title"), field(root, "internalName")) if isinstance(t, str)), "")
    name = title.rpartition("=")[2].strip()
    if name and not name.startswith("$$$"):
        values["Name"] = name
    return values, lists


def settings(files: DataFrame) -> DataFrame:
    """files (text, and others) with `values` and `lists`, maps of its settings; null where a text holds none. Texts that begin with < are XML."""
    kind = pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", values map<string, string>, lists map<string, array<string>>"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if t is None else xmp_settings(t) if t.lstrip("﻿ \t\r\n").startswith("<") else lua_settings(t) for t in b.column("text").to_pylist()]
            maps = [pa.array([None if f is None else list(f[k].items()) for f in found], kind[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *maps], [*b.schema.names, "values", "lists"])

    return files.mapInArrow(told, schema)


def _num(key: str) -> Column:
    v = F.expr(f"try_cast(trim(values['{key}']) AS double)")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _is(key: str, value: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col("values")[key])) == value.lower(), F.lit(False))


def _any(parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def _curve(key: str) -> Column:
    """A curve's points, from lists of "x, y" in 255ths, as JSON; null for fewer than two points or a straight line."""
    at = lambda p, k: F.try_element_at(F.split(p, ","), F.lit(k)).try_cast("double")
    points = F.filter(F.transform(F.col("lists")[key], lambda p: F.array(at(p, 1) / 255.0, at(p, 2) / 255.0)), lambda p: p[0].isNotNull() & p[1].isNotNull())
    straight = (F.size(points) == 2) & F.forall(points, lambda p: p[0] == p[1])
    return F.when((F.size(points) >= 2) & ~straight, F.to_json(points))


def _json(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def presets(files: DataFrame) -> DataFrame:
    """files (text, and others) with name, recipe (a look in range), left_out and outcome: read, no preset, or nothing usable.

    left_out names what the file sets and a look can't hold. A null text is no preset; unknown settings are ignored.
    """
    held = settings(files)
    zero = lambda key, standard=0.0: F.coalesce(_num(key), F.lit(standard))
    grey = _is("ConvertToGrayscale", "True")
    fields = {field: _num(key) for key, field in SLIDERS.items()}
    used = [_num(key).isNotNull() for key in SLIDERS] + [grey]
    fields["saturation"] = F.when(grey, -100.0).otherwise(fields["saturation"])
    kelvin = _num("Temperature").isNotNull() & ~_is("WhiteBalance", "As Shot") & F.col("values")["IncrementalTemperature"].isNull()
    used.append(kelvin)
    shift = lambda band, kind: F.when(grey, zero(f"GrayMixer{band}") if kind == "Luminance" else F.lit(0.0)).otherwise(zero(f"{kind}Adjustment{band}"))
    mixed = {band.lower(): {kind.lower(): shift(band, kind) for kind in SHIFTS} for band in BANDS}
    used += [_num(f"{kind}Adjustment{band}").isNotNull() for band in BANDS for kind in SHIFTS]
    regions = {k: zero(*v) for k, v in REGIONS.items()}
    bent = _any(regions[k] != 0.0 for k in ("shadows", "darks", "lights", "highlights"))
    channels = {c: _curve(CURVE + c.capitalize()) for c in ("red", "green", "blue")}
    grade = lambda part, k, old=None: F.coalesce(_num(f"ColorGrade{part}{k}"), *([_num(f"SplitToning{part}{old}")] if old and part in ("Shadow", "Highlight") else []), F.lit(0.0))
    wheels = {name: {"hue": grade(part, "Hue", "Hue"), "saturation": grade(part, "Sat", "Saturation"), "luminance": grade(part, "Lum")} for name, part in WHEELS.items()}
    graded = _any((w["saturation"] != 0.0) | (w["luminance"] != 0.0) for w in wheels.values())
    tuned = {k: zero(v) for k, v in CALIBRATION.items()}
    calibrated = _any(v != 0.0 for v in tuned.values())
    curved, coloured = _curve(CURVE), _any(c.isNotNull() for c in channels.values())
    used += [bent, graded, calibrated, coloured, F.array_contains(F.map_keys("lists"), CURVE)]
    wheel = lambda w: F.struct(*(v.alias(k) for k, v in w.items()))
    nested = {
        "whiteBalance": F.when(kelvin, _json({"kelvin": _num("Temperature"), "tint": zero("Tint")})),
        "mixer": F.when(_any(v != 0.0 for b in mixed.values() for v in b.values()), _json({band: wheel(b) for band, b in mixed.items()})),
        "pointCurve": curved,
        "parametricCurve": F.when(bent, _json(regions)),
        "channelCurves": F.when(coloured, F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), c)) for k, c in channels.items()))), ","), F.lit("}"))),
        "colourGrading": F.when(graded, _json({k: wheel(w) for k, w in wheels.items()} | {"blending": zero("ColorGradeBlending", 50.0), "balance": zero("SplitToningBalance")})),
        "calibration": F.when(calibrated, _json(tuned)),
    }
    has = lambda key: F.array_contains(F.map_keys("lists"), key)
    on = lambda key: F.coalesce(_num(key) != 0.0, F.lit(False))
    told = {
        "Masks and healing": _any(has(k) for k in MASKS),
        "Lens Corrections": _is("LensProfileEnable", "1") | _is("AutoLateralCA", "1") | _any(on(k) for k in OPTICS),
        "Crop and Transform": _is("HasCrop", "True") | _any(on(k) for k in PERSPECTIVE),
        "Profile": F.col("values")["CameraProfile"].isNotNull() | _any([has("Look")]),
        "Color noise reduction": on("ColorNoiseReduction") & (_num("ColorNoiseReduction") != STANDARD_COLOUR_NOISE),
    }
    outcome = F.when(F.col("values").isNull(), "no preset").when(_any(used), "read").otherwise("nothing usable")
    held = held.withColumn("outcome", outcome)
    made = F.struct(*(({"version": F.lit(R.VERSION), "look": F.lit("standard")} | fields | nested).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in R.SCHEMA.fields))
    name = F.coalesce(F.get(F.col("lists")["Name"], F.lit(0)), F.col("values")["Name"])
    read = F.col("outcome") == "read"
    held = held.withColumns({"_made": made, "name": F.when(read & (F.trim(name) != ""), F.trim(name)), "left_out": F.when(read, F.array_compact(F.array(*(F.when(v, k) for k, v in told.items()))))})
    return held.withColumn("recipe", F.when(read, R.look_only(F.col("_made")))).drop("_made", "values", "lists")
