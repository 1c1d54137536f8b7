"""Presets of other programs."""

from __future__ import annotations

import json

from fotolith.operators import foreign

XMP = """﻿<?xml version="1.0"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
 <rdf:Description xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" crs:Exposure2012="+0.75" crs:Contrast2012="300" crs:Temperature="4800" crs:Tint="-7" crs:WhiteBalance="Custom"
  crs:LuminanceAdjustmentBlue="-30" crs:ParametricDarks="12" crs:SplitToningShadowHue="220" crs:SplitToningShadowSaturation="15" crs:RedHue="5" crs:LensProfileEnable="1" crs:HasCrop="True" crs:ColorNoiseReduction="25" crs:Dehaze="NaN">
  <crs:Sharpness> 55 </crs:Sharpness>
  <crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li><rdf:li>255, 255</rdf:li></rdf:Seq></crs:ToneCurvePV2012>
  <crs:ToneCurvePV2012Red><rdf:Seq><rdf:li>0, 51</rdf:li><rdf:li>255, 204</rdf:li><rdf:li>odd</rdf:li></rdf:Seq></crs:ToneCurvePV2012Red>
  <crs:MaskGroupBasedCorrections><rdf:Seq><rdf:li><rdf:Description crs:Exposure2012="9"><crs:Saturation>4</crs:Saturation></rdf:Description></rdf:li></rdf:Seq></crs:MaskGroupBasedCorrections>
 </rdf:Description></rdf:RDF></x:xmpmeta>"""


def read(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return foreign.presets(df).orderBy("id").collect()


def test_settings_with_a_counterpart_and_those_without(spark):
    (r,) = read(spark, XMP)
    assert r.outcome == "read" and r.name is None
    assert (r.recipe.exposure, r.recipe.contrast, r.recipe.sharpening, r.recipe.dehaze, r.recipe.saturation) == (0.75, 100.0, 55.0, 0.0, 0.0)
    assert json.loads(r.recipe.whiteBalance) == {"kelvin": 4800, "tint": -7}
    mixer = json.loads(r.recipe.mixer)
    assert mixer["blue"] == {"hue": 0, "saturation": 0, "luminance": -30} and len(mixer) == 8
    assert json.loads(r.recipe.parametricCurve) == {"shadows": 0, "darks": 12, "lights": 0, "highlights": 0, "shadowSplit": 25, "midtoneSplit": 50, "highlightSplit": 75}
    grading = json.loads(r.recipe.colourGrading)
    assert grading["shadows"] == {"hue": 220, "saturation": 15, "luminance": 0} and grading["blending"] == 50
    assert json.loads(r.recipe.calibration)["redHue"] == 5
    assert r.recipe.pointCurve is None and json.loads(r.recipe.channelCurves) == {"red": [[0, 0.2], [1, 0.8]]}
    assert r.left_out == ["Masks and healing", "Lens Corrections", "Crop and Transform"]


def test_nested_tables_are_read(spark):
    text = """-- a look
    s = { title = "$$$/A/B=Evening \\"light\\"", internalName = 'x',
      value = { settings = { Exposure2012 = -1.5e0, Vibrance = 20; ConvertToGrayscale = true, GrayMixerRed = 40, ToneCurvePV2012 = { 0, 0, 128, 100, 255, 255 }, CameraProfile = "Own" }, },
    }"""
    (r,) = read(spark, text)
    assert r.outcome == "read" and r.name == 'Evening "light"' and r.recipe.exposure == -1.5 and r.recipe.vibrance == 20 and r.recipe.saturation == -100
    assert json.loads(r.recipe.mixer)["red"] == {"hue": 0, "saturation": 0, "luminance": 40} and len(json.loads(r.recipe.pointCurve)) == 3 and r.left_out == ["Profile"]


def test_texts_that_are_no_presets(spark):
    deep = "s = " + "{" * 40 + "}" * 40
    rows = read(spark, None, "", "<a>", "<a/>", "s = { value = { settings = 3 } }", "s = {", deep, "s = { value = { settings = { Own = 1 } } }", "s = { value = { settings = { Exposure2012 = 1 } } } more", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")
    assert [r.outcome for r in rows] == ["no preset"] * 7 + ["nothing usable", "no preset", "no preset"]
    assert all(r.recipe is None and r.name is None and r.left_out is None for r in rows)
