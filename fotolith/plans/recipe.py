"""Edit recipes: versioned JSON read by one schema, migrated, put in range, compared and combined as struct expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 33
# Each slider's range and default.
SLIDERS = {"exposure": (-5.0, 5.0, 0.0)} | dict.fromkeys(("contrast", "highlights", "shadows", "whites", "blacks", "dehaze", "temperature", "tint", "vibrance", "saturation", "texture", "clarity", "vignette"), (-100.0, 100.0, 0.0))
SLIDERS |= {"sharpening": (0.0, 150.0, 40.0), "noiseReduction": (0.0, 100.0, 0.0), "grain": (0.0, 100.0, 0.0)}
FLAGS = {"whitesFromSensor": False, "profileCorrections": True, "profileWithoutChromaticAberration": False, "unoriented": False}
#: Nested settings are kept as JSON text, so that what isn't looked into comes back as it was.
NESTED = ("whiteBalance", "mixer", "geometry", "chromaticAberration", "pointCurve", "parametricCurve", "channelCurves", "colourGrading", "calibration")
LISTS = ("masks", "spots", "removals", "redEyes")
# The groups in which settings are copied; those drawn for one photo are left out unless chosen.
GROUPS = {
    "exposure": ("exposure",),
    "light": ("look", "contrast", "highlights", "shadows", "whites", "whitesFromSensor", "blacks", "dehaze", "pointCurve", "parametricCurve", "channelCurves"),
    "whiteBalance": ("temperature", "tint", "whiteBalance"),
    "colour": ("vibrance", "saturation", "mixer", "colourGrading"),
    "calibration": ("calibration",),
    "detail": ("texture", "clarity", "sharpening", "noiseReduction", "vignette", "grain"),
    "geometry": ("geometry", "chromaticAberration", "profileCorrections", "profileWithoutChromaticAberration", "unoriented"),
    "masks": ("masks",),
    "retouch": ("spots", "removals", "redEyes"),
}
LOOK = ("light", "whiteBalance", "colour", "calibration", "detail")
FIELDS = ("version", "look", *SLIDERS, *FLAGS, *NESTED, *LISTS)
SCHEMA = T.StructType(
    [T.StructField("version", T.IntegerType()), T.StructField("look", T.StringType())]
    + [T.StructField(k, T.DoubleType()) for k in SLIDERS]
    + [T.StructField(k, T.BooleanType()) for k in FLAGS]
    + [T.StructField(k, T.StringType()) for k in (*NESTED, *LISTS)]
)


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once: expressions would repeat it at every use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _empty(c: Column) -> Column:
    return c.isNull() | c.isin("[]", "{}", "null")


def _put(r: Column, **fields: Column) -> Column:
    return F.struct(*(fields.get(k, r[k]).alias(k) for k in FIELDS))


def is_identity(r: Column) -> Column:
    """Whether a recipe in range changes nothing."""
    out = (r["look"] == "standard") & r["profileCorrections"] & ~r["profileWithoutChromaticAberration"]
    for k, (_, _, default) in SLIDERS.items():
        out = out & (r[k] == default)
    for k in (*NESTED, *LISTS):
        out = out & r[k].isNull()
    return out


def _sane(c: Column, low: float, high: float, default: float) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), c)) + 0.0).otherwise(F.lit(default))


def sanitised(r: Column) -> Column:
    """Every slider in its range, defaults where a value is missing or no number, and empty settings left out."""
    return bound(r, _sanitised)


def _sanitised(r: Column) -> Column:
    fields = {k: _sane(r[k], *v) for k, v in SLIDERS.items()}
    fields |= {k: F.coalesce(r[k], F.lit(v)) for k, v in FLAGS.items()}
    fields |= {k: F.when(~_empty(r[k]), r[k]) for k in (*NESTED, *LISTS)}
    return _put(r, look=F.coalesce(r["look"], F.lit("standard")), version=F.coalesce(r["version"], F.lit(VERSION)), **fields)


def _migrated(raw: Column, read: Column) -> Column:
    return _put(
        raw,
        version=F.lit(VERSION),
        look=F.when(read <= 1, "flat").otherwise(raw["look"]),
        sharpening=F.when(read <= 6, F.lit(0.0)).otherwise(raw["sharpening"]),
        whitesFromSensor=F.when((read >= 2) & (read <= 25), F.coalesce(raw["whites"], F.lit(0.0)) != 0).otherwise(raw["whitesFromSensor"]),
    )


def _marked(now: Column, read: Column) -> Column:
    """What older edits keep: no lens profile, files as stored, profiles without chromatic aberration."""

    def put(x: Column) -> Column:
        r, edits = x["r"], ~x["plain"]
        profile = r["profileCorrections"] & ~((read < 29) & edits)
        fringes = r["profileWithoutChromaticAberration"] | ((read < 32) & profile & edits)
        return _put(r, profileCorrections=profile, unoriented=r["unoriented"] | ((read < 30) & edits), profileWithoutChromaticAberration=fringes)

    return bound(bound(now, lambda r: F.struct(r.alias("r"), is_identity(r).alias("plain"))), put)


def parsed(json: Column) -> Column:
    """A stored recipe in the present version; null if it can't be read or is newer."""

    def steps(raw: Column) -> Column:
        read = F.coalesce(raw["version"], F.lit(VERSION))
        return F.when(read <= VERSION, _marked(sanitised(_migrated(raw, read)), read))

    return F.when(json.rlike(r"^\s*\{"), bound(F.from_json(json, SCHEMA, {"mode": "PERMISSIVE"}), steps))


def state(json: Column) -> Column:
    """none, recipe or newer, as a saved edit is shown."""
    version = F.get_json_object(json, "$.version").cast("int")
    return F.when(version > VERSION, "newer").when(parsed(json).isNull(), "none").otherwise("recipe")


def pasted(target: Column, source: Column, groups: list[str]) -> Column:
    """target with the settings of the groups named from source; what source lacks goes. Unknown groups are ignored."""
    taken = {f for g in groups for f in GROUPS.get(g, ())}
    return bound(F.struct(target.alias("t"), source.alias("s")), lambda x: _sanitised(_put(x["t"], **{f: x["s"][f] for f in taken})))


def with_look_of(target: Column, preset: Column) -> Column:
    """target with the look of a preset, and its own exposure, crop, masks and retouching."""
    return pasted(target, preset, list(LOOK))


def look_only(r: Column) -> Column:
    """A recipe as a preset keeps it: without what is drawn for one photo."""
    return bound(r, lambda x: _sanitised(_put(x, **{f: F.lit(None).cast(SCHEMA[f].dataType) for g in ("geometry", "masks", "retouch") for f in GROUPS[g]})))


def to_json(r: Column) -> Column:
    """The same text for the same edit: fields in one order, unset ones left out."""
    return F.to_json(r, {"ignoreNullFields": "true"})
