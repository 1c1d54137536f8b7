"""Sky masks against brute force on whole photos."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolith.plans import sky as S
from tests.test_light import pixels

LUMA = (0.2126, 0.7152, 0.0722)


def light(c):
    return sum(k * (v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4) for k, v in zip(LUMA, c))


def luma(c):
    return sum(k * v for k, v in zip(LUMA, c))


def mean(colours):
    return tuple(sum(c[k] for c in colours) / len(colours) for k in range(3))


def brute(p, ev, cell):
    """Coverage of a photo (height by width by 3), or None, by plain loops over all of it."""
    h, w = p.shape[:2]
    gh, gw = -(-h // cell), -(-w // cell)
    could, tone, whole, ends = {}, {}, {}, {}

    def fits(c):
        bright = light(c) >= 0.3 if ev is None else ev + math.log2(max(light(c), 1e-6) / 0.18) >= 9
        return bright and c[1] - max(c[0], c[2]) < 0.02 and c[0] - c[2] < 0.04 and c[1] - c[0] > -0.04

    for i in range(gh):
        for j in range(gw):
            inside = sorted((luma(p[y, x]), y, x) for y in range(i * cell, min(h, i * cell + cell)) for x in range(j * cell, min(w, j * cell + cell)))
            q = math.ceil(len(inside) / 4)
            every, dark, bright = (mean([p[y, x] for _, y, x in part]) for part in (inside, inside[:q], inside[-q:]))
            spread = np.std([v for v, _, _ in inside])
            k = 0
            if spread <= 0.01 + 0.03 * luma(every) and fits(every):
                k = 1
            elif fits(bright) and math.log2(max(light(bright), 1e-6) / max(light(dark), 1e-6)) >= 0.25 and dark[2] - dark[0] < 0.1:
                k = 2
            could[i, j], whole[i, j], ends[i, j] = k, every, (luma(dark), luma(bright))
            tone[i, j] = bright if k == 2 else every
    around = lambda c: [n for n in ((c[0] - 1, c[1]), (c[0] + 1, c[1]), (c[0], c[1] - 1), (c[0], c[1] + 1)) if n in could]
    sky = {(0, j) for j in range(gw) if could[0, j]}
    todo = list(sky)
    while todo:
        a = todo.pop()
        for b in around(a):
            stops = math.log2(max(light(tone[b]), 1e-6) / max(light(tone[a]), 1e-6))
            ca, cb = ((t[0] - t[2], t[1] - (t[0] + t[2]) / 2) for t in (tone[a], tone[b]))
            if b not in sky and could[b] and -(0.6 if could[b] == 2 else 0.33) <= stops <= 0.33 and abs(ca[0] - cb[0]) + abs(ca[1] - cb[1]) <= 0.05:
                sky.add(b)
                todo.append(b)
    if not sky or len(sky) < 0.015 * gh * gw:
        return None
    average = mean([tone[c] for c in sky])
    if average[2] - average[0] < 0.04:
        rank = lambda v, q: sorted(v)[math.floor((len(v) - 1) * q + 0.5)]
        if ev is None or rank([light(tone[c]) for c in sky], 0.5) < 0.55 * rank([light(c) for c in whole.values()], 0.97):
            return None
    kind = {c: could[c] if c in sky else 0 for c in could}
    seen = set(sky)
    for c in could:
        region, todo = [], [c] if c not in seen else []
        while todo:
            a = todo.pop()
            if a not in seen:
                seen.add(a)
                region.append(a)
                todo += around(a)
        if region and len(region) <= int(0.3 * gh * gw) and max(a[0] for a in region) < gh - 1:
            r, g, b = mean([whole[a] for a in region])
            if g - max(r, b) < 0.04 and r - b < 0.1:
                kind |= dict.fromkeys(region, 1)
    prior, guide = np.zeros((h, w)), np.array([[luma(c) for c in line] for line in p])
    for y in range(h):
        for x in range(w):
            gy, gx = (min(max((v + 0.5) / cell - 0.5, 0), n - 1) for v, n in ((y, gh), (x, gw)))
            i, j = int(gy), int(gx)
            at = lambda i, j: float(kind[min(i, gh - 1), min(j, gw - 1)] == 1)
            top, low = (at(k, j) * (1 - gx + j) + at(k, j + 1) * (gx - j) for k in (i, i + 1))
            v, c = top * (1 - gy + i) + low * (gy - i), (y // cell, x // cell)
            if kind[c] == 2:
                t = min(max(((guide[y, x] - ends[c][0]) / max(ends[c][1] - ends[c][0], 1e-3) - 0.3) / 0.5, 0), 1)
                v = max(v, t * t * (3 - 2 * t))
            prior[y, x] = v
    r = max(max(h, w) // 192, 2)
    window = lambda m: np.array([[m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean() for x in range(w)] for y in range(h)])
    a = (window(guide * prior) - window(guide) * window(prior)) / (np.maximum(window(guide**2) - window(guide) ** 2, 0) + 2e-3)
    t = np.clip((window(a) * guide + window(window(prior) - a * window(guide)) - 0.1) / 0.8, 0, 1)
    out = np.floor(t * t * (3 - 2 * t) * 255 + 0.5)
    return out if out.mean() >= 0.015 * 255 else None


def view(h, w, sky, seed=0, twigs=False, cloud=False):
    rng = np.random.default_rng(seed)
    p = np.zeros((h, w, 3)) + sky
    p += 0.0004 * np.arange(h)[:, None, None]
    if cloud:
        p[h // 5 : h // 4, w // 2 : w // 2 + 14] = 0.97
    if twigs:
        p[h // 3 :, 1 : w // 3 : 4] = 0.12
    ground = h * 3 // 5
    p[ground:] = np.array([0.3, 0.33, 0.15]) + rng.normal(0, 0.04, (h - ground, w, 1))
    return np.clip(p, 0, 1)


BLUE = (0.45, 0.65, 0.9)


def test_masks_equal_brute_force(spark):
    room = np.full((40, 30, 3), 0.5)
    images = {1: view(88, 70, BLUE, 1, True, True), 2: view(41, 67, (0.8, 0.8, 0.81), 2), 3: view(50, 50, (0.8, 0.8, 0.81), 3), 4: room, 5: np.zeros((9, 3, 3)), 6: view(64, 130, BLUE, 4), 7: room, 8: np.full((1, 1, 3), BLUE)}
    evs = {1: None, 2: 12.0, 3: None, 4: 6.0, 6: 13.0, 7: 12.0}
    edge = 24
    df = pixels(spark, images).withColumn("coverage", F.lit("kept out")).withColumn("cell", F.lit(1))
    rows = S.sky_masks(df, spark.createDataFrame(list(evs.items()), "image_id long, scene_ev double"), grid_edge=edge).collect()
    got = {i: np.full(p.shape[:2], -1.0) for i, p in images.items()}
    assert len(rows) == sum(m.size for m in got.values())
    for r in rows:
        got[r.image_id][r.y, r.x] = np.nan if r.coverage is None else r.coverage
    found = set()
    for i, p in images.items():
        want = brute(p, evs.get(i), max(1, math.floor(max(p.shape[:2]) / edge + 0.5)))
        if want is None:
            assert np.isnan(got[i]).all(), i
        else:
            found.add(i)
            assert np.abs(got[i] - want).max() <= 1, i
    # A white sky needs a known exposure, a grey room isn't sky by its exposure.
    assert {1, 2, 6} <= found and not found & {3, 4, 5}
    # The cloud is filled, twigs are left out between their gaps, the ground isn't sky.
    one = got[1]
    assert one[19, 38] > 200 and one[40, 50] == 255 and one[80, 50] == 0 and one[40, 1] < one[40, 3]


def test_large_photos_are_averaged_and_empty_tables_give_no_rows(spark):
    big = view(60, 90, BLUE, 5).repeat(2, 0).repeat(2, 1)
    got = S.sky_masks(pixels(spark, {1: big}), fine_edge=90, grid_edge=20).collect()
    want = brute(big[::2, ::2], None, 5)  # an edge of 90 over 20 cells: 4.5, rounded up
    assert len(got) == 60 * 90 and all(abs(r.coverage - want[r.y, r.x]) <= 1 for r in got)
    assert S.sky_masks(pixels(spark, {1: big}).limit(0)).count() == 0


def test_the_camera_tells_the_scene(spark):
    row = spark.range(1).select(S.scene_ev(F.lit(100), F.lit(16.0), F.lit(0.01)).alias("a"), S.scene_ev(F.lit(200), F.lit(16.0), F.lit(0.01)).alias("b"), S.scene_ev(F.lit(0), F.lit(4.0), F.lit(1.0)).alias("c")).first()
    assert row.a == pytest.approx(14.6439, abs=1e-4) and row.a - row.b == pytest.approx(1) and row.c is None
