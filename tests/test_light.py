"""Settings that are found, brushes and dust, against brute force on whole images."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import fotolith.queries as Q
from fotolith.plans import auto_tone as A
from fotolith.plans import brush as B
from fotolith.plans import dust as U
from fotolith.plans import level as L
from fotolith.plans import tiles as T

SF = "/root/testdata/sf0.001"
LUMA = np.array([0.2126, 0.7152, 0.0722])


def pixels(spark, images):
    """A table of images, which are arrays of height by width by 3, by their ids."""
    import pandas as pd

    parts = []
    for i, p in images.items():
        y, x = np.divmod(np.arange(p.shape[0] * p.shape[1]), p.shape[1])
        parts.append(pd.DataFrame({"image_id": i, "y": y.astype("int32"), "x": x.astype("int32"), **{c: p[..., k].ravel() for k, c in enumerate("rgb")}}))
    return spark.createDataFrame(pd.concat(parts))


def grey(p):
    return np.repeat(p[..., None], 3, 2)


# Tiles.


def test_boxes_equal_direct_means():
    p = np.random.default_rng(1).normal(size=(9, 14))
    for r in (1, 3, 20):
        direct = [[p[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].mean() for x in range(14)] for y in range(9)]
        assert np.allclose(T.box(p, r), direct)
        held = np.pad(p, r, mode="edge")
        direct = [[held[y : y + 2 * r + 1, x : x + 2 * r + 1].mean() for x in range(14)] for y in range(9)]
        assert np.allclose(T.box_held(p, r, 1), direct)


def test_tiles_hold_every_pixel_once_whatever_the_reach(spark):
    images = {1: np.random.default_rng(2).random((70, 130, 3)), 2: np.random.default_rng(3).random((5, 3, 3))}
    df = pixels(spark, images).withColumn("reach", F.when(F.col("image_id") == 1, 9).otherwise(0))

    def f(t):
        y, x = t.places()
        return {"y": y, "x": x, "blur": t.own(T.box(t.planes["r"], 4 if t.given["reach"] else 0))}

    got = {(r.image_id, r.y, r.x): r.blur for r in T.on_tiles(df, ["r"], f, "y int, x int, blur double", F.col("reach"), given=["reach"]).collect()}
    assert len(got) == 70 * 130 + 15
    whole = T.box(images[1][..., 0], 4)
    assert all(abs(v - (whole if i == 1 else images[2][..., 0])[y, x]) < 1e-12 for (i, y, x), v in got.items())


# Brush.


def painted(strokes, width, height):
    """Coverage of an image, pixel by pixel, stroke by stroke."""
    y, x = np.mgrid[:height, :width] + 0.5
    cover = np.zeros((height, width))
    for _, erase, size, feather, flow, points in sorted(strokes):
        r = max(size * math.hypot(width, height), 0.5)
        p = [(a * width, b * height) for a, b in points]
        v = np.zeros_like(cover)
        for (ax, ay), (bx, by) in zip(p, p[1:] or p, strict=False):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0, 1) if n else 0
            d = np.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)
            k = np.clip((d - r * (1 - feather / 100)) / max(1e-9, r * feather / 100), 0, 1)
            v = np.maximum(v, 1 - k * k * (3 - 2 * k))
        a = flow / 100 * v
        cover = np.where(v > 0, np.floor((cover * (1 - a) if erase else cover + (1 - cover) * a) * 65535 + 0.5) / 65535, cover)
    return cover


SCHEMA = "image_id long, nth long, erase boolean, size double, feather double, flow double, points array<struct<x: double, y: double>>"


def brushed(spark, strokes, width, height):
    rows = [(1, *s) for s in strokes]
    frames = spark.createDataFrame([(1, width, height)], "image_id long, width long, height long")
    out = np.zeros((height, width))
    for r in B.brush_coverage(spark.createDataFrame(rows, SCHEMA), frames).collect():
        out[r.y, r.x] = r.coverage
    return out


def test_strokes_build_up_and_are_taken_away_in_order(spark):
    add, wipe = (0, False, 0.1, 50.0, 60.0, [(0.2, 0.2), (0.8, 0.3), (0.7, 0.9)]), (1, True, 0.06, 30.0, 70.0, [(0.1, 0.5), (0.9, 0.4)])
    more = (2, False, 0.05, 100.0, 40.0, [(0.5, 0.5)])
    for order in ([add, wipe, more], [(2, *add[1:]), (0, *wipe[1:]), (1, *more[1:])]):
        assert np.abs(brushed(spark, order, 150, 90) - painted(order, 150, 90)).max() < 1e-9
    assert np.abs(brushed(spark, [add, wipe], 150, 90) - brushed(spark, [(1, *add[1:]), (0, *wipe[1:])], 150, 90)).max() > 0.1


def test_odd_strokes(spark):
    nan = float("nan")
    assert not brushed(spark, [(0, None, nan, nan, 0.0, [(0.5, 0.5)]), (1, False, 0.1, 50.0, 100.0, [])], 20, 20).any()
    edge = [(0, False, 0.1, 50.0, 100.0, [(-0.05, 0.5), (nan, 0.1), (-0.05, 0.6)])]
    assert np.abs(brushed(spark, edge, 80, 70) - painted([(0, False, 0.1, 50.0, 100.0, [(-0.05, 0.5), (-0.05, 0.6)])], 80, 70)).max() < 1e-9
    assert not brushed(spark, [(0, False, 0.01, 50.0, 100.0, [(2.5, 2.5)])], 80, 70).any()
    plain = brushed(spark, [(0, None, None, None, None, [(0.5, 0.5)])], 64, 64)
    assert np.abs(plain - painted([(0, False, 0.04, 50.0, 100.0, [(0.5, 0.5)])], 64, 64)).max() < 1e-9


def test_paths_lose_only_points_that_lie_on_them():
    line = np.array([[0, 0], [1, 0.1], [2, -0.1], [3, 0], [3, 5.0]])
    assert B.simplified(line).tolist() == [[0, 0], [3, 0], [3, 5]]
    assert len(B.simplified(np.array([[0, 0], [1, 0.3], [2, 0.0]]))) == 3 and len(B.simplified(np.zeros((1, 2)))) == 1


# Level.


def horizon(tilt, h=120, w=160, noise=0.0):
    y, x = np.mgrid[:h, :w]
    p = 0.1 + 0.6 / (1 + np.exp(-(y - h / 2 - math.tan(math.radians(tilt)) * (x - w / 2))))
    return grey(p * (1 + noise * np.random.default_rng(5).normal(size=(h, w))))


def test_level_of_known_tilts(spark):
    images = {k: horizon(t, noise=0.002) for k, t in enumerate((-9.3, -2.0, 0.0, 4.7, 12.1))}
    images[5] = np.transpose(horizon(3.0), (1, 0, 2))  # a wall
    images[6] = np.random.default_rng(1).random((90, 70, 3))
    images[7] = np.full((40, 40, 3), 0.5)
    images[8] = horizon(3.0, 15, 200)
    got = {r.image_id: r for r in L.auto_level(pixels(spark, images)).collect()}
    for k, t in enumerate((-9.3, -2.0, 0.0, 4.7, 12.1)):
        assert abs(got[k].angle - t) <= 0.1 + 1e-9
    assert abs(got[5].angle + 3.0) <= 0.1 + 1e-9
    assert got[6].angle is None and got[6].confidence < 0.075
    assert 7 not in got and 8 not in got


def test_level_doesnt_depend_on_tiles(spark, monkeypatch):
    image = {1: horizon(6.0, 130, 150, 0.02)}
    whole = L.level_estimates(pixels(spark, image)).first()
    monkeypatch.setattr(T.on_tiles, "__defaults__", (0, 16, None))
    parts = L.level_estimates(pixels(spark, image)).first()
    assert whole.angle == parts.angle and abs(whole.confidence - parts.confidence) < 1e-9


# Dust.


def sky(h=110, w=150, seed=1):
    y, x = np.mgrid[:h, :w]
    v = (0.3 + 0.02 * (1 - y / h) + 0.01 * x / w) * (1 + 0.004 * (np.random.default_rng(seed).random((h, w)) - 0.5))
    return v[..., None] * np.array([0.7, 0.85, 1.1])


def spotted(p, cx, cy, sigma, share, tint=(1, 1, 1)):
    y, x = np.mgrid[: p.shape[0], : p.shape[1]]
    g = np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * sigma * sigma))
    return p * (1 - share * g[..., None] * np.array(tint))


def dust_by_hand(p):
    """The spots of one image: flood fill, then every test on whole planes."""
    h, w, _ = p.shape
    long = max(h, w)
    log, logs = np.log(np.maximum(p @ LUMA, 1e-4)), np.log(np.maximum(p, 1e-4))

    def blur(a, r):
        for _ in range(3):
            a = np.mean([np.pad(a, ((0, 0), (r, r)), mode="edge")[:, k : k + w] for k in range(2 * r + 1)], 0)
            a = np.mean([np.pad(a, ((r, r), (0, 0)), mode="edge")[k : k + h] for k in range(2 * r + 1)], 0)
        return a

    diff = blur(log, max(1, int(long / 1000 + 0.5))) - blur(log, max(8, int(long / 50 + 0.5)))
    least, most = max(long * 0.0012, 1.2), long * 0.02
    yy, xx = np.mgrid[:h, :w]
    seen, out = diff > -0.025, []
    for sy, sx in zip(*np.nonzero(~seen), strict=True):
        if seen[sy, sx]:
            continue
        stack, blob = [(sy, sx)], []
        seen[sy, sx] = True
        while stack:
            y, x = stack.pop()
            blob.append((y, x))
            for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= a < h and 0 <= b < w and not seen[a, b]:
                    seen[a, b] = True
                    stack.append((a, b))
        ys, xs = np.array(blob).T
        weight = -diff[ys, xs]
        area, bw, bh, depth = len(blob), np.ptp(xs) + 1, np.ptp(ys) + 1, weight.max()
        core = math.sqrt(area / math.pi)
        cx, cy = ((xs + 0.5) * weight).sum() / weight.sum(), ((ys + 0.5) * weight).sum() / weight.sum()
        radius = max(max(bw, bh) / 2, core) * 1.6 + 1
        if not (least * 0.5 <= core <= most and area / (bw * bh) >= 0.5 and max(bw, bh) / min(bw, bh) <= 2 and depth <= 0.8 and least <= radius <= most * 1.6 + 1):
            continue
        d = np.hypot(xx + 0.5 - cx, yy + 0.5 - cy)
        ring = (d >= radius * 1.5) & (d <= radius * 2.5)
        spread = log[ring].std()
        drops = logs[ys, xs].mean(0) - logs[ring].mean(0)
        if ring.sum() < 12 or spread > 0.02 or depth < 3 * spread or drops[1] >= 0 or (np.abs(drops - drops[1]) > 0.2 * abs(drops[1]) + 0.01).any():
            continue
        differ = total = 0.0
        for y, x in zip(*np.nonzero(d <= radius), strict=True):
            my, mx = math.floor(2 * cy - y - 0.5), math.floor(2 * cx - x - 0.5)
            if 0 <= my < h and 0 <= mx < w:
                a, b = min(diff[y, x], 0), min(diff[my, mx], 0)
                differ, total = differ + abs(a - b), total + abs(a) + abs(b)
        if total <= 0 or differ / total > 0.35:
            continue
        out.append((cx / w, cy / h, radius / long, 1 - math.exp(-depth), depth / (spread + 0.005)))
    return sorted(out)


def test_dust_equals_brute_force(spark):
    a = sky()
    for cx, cy, s, f in ((64.0, 63.5, 1.4, 0.1), (30, 30, 1.3, 0.12), (127.6, 40, 1.4, 0.09), (100, 88, 1.2, 0.14), (2, 100, 1.5, 0.2)):
        a = spotted(a, cx, cy, s, f)
    a = spotted(spotted(a, 20, 70, 1.5, 0.3, (0.1, 1, 1)), 95, 15, 1.5, 0.95)
    b = spotted(sky(70, 300, 2), 64, 64, 3.0, 0.1)
    b[:, 180:] *= 0.5  # an edge over several tiles
    images = {1: a, 2: b, 3: sky(seed=3), 4: np.random.default_rng(4).random((80, 80, 3)), 5: spotted(sky(50, 200), 60, 25, 1.5, 0.2)}
    got = {}
    for r in U.find_dust(pixels(spark, images)).collect():
        got.setdefault(r.image_id, []).append(tuple(r)[1:])
    expected = {k: dust_by_hand(p) for k, p in images.items() if min(p.shape[:2]) >= 64}
    assert len(expected[1]) >= 4 and any(abs(x * 150 - 64.5) < 1 for x, *_ in expected[1]) and not expected[3] and not expected[4]
    for k, spots in expected.items():
        assert np.allclose(sorted(got.pop(k, [])), spots, atol=1e-8) if spots else k not in got
    assert not got


def test_labels_join_what_touches():
    mask = np.array([[1, 0, 1, 1], [1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [1, 0, 1, 0]], bool)
    got = U.labels(mask)
    assert (got[:3][mask[:3]] == 0).all() and got[4, 0] == 16 and got[4, 2] == 18 and (got[~mask] == 20).all()


def test_the_best_spots_of_an_image(spark, monkeypatch):
    monkeypatch.setattr(U, "MOST", 2)
    a = sky()
    for k, (cx, cy) in enumerate(((30, 30), (75, 40), (120, 80))):
        a = spotted(a, cx, cy, 1.3, 0.07 + 0.025 * k)
    got = U.find_dust(pixels(spark, {1: a})).collect()
    assert len(got) == 2 and min(r.score for r in got) > 0 and all(r.x > 0.4 for r in got)


def test_dust_of_the_test_skies(spark):
    rows = Q.QUERIES["px_dust"](spark, SF).collect()
    assert len({r.image_id for r in rows}) == 8 and len(rows) >= 16


# Auto tone.


def sample(spark, images):
    df = pixels(spark, images)
    return df.select("image_id", "r", "g", "b", F.log2(F.greatest(sum((F.col(c) * float(k) for c, k in zip("rgb", LUMA, strict=True)), F.lit(0.0)), F.lit(1e-6))).alias("base"))


def measured(spark, s, settings):
    held = s.crossJoin(spark.createDataFrame([(0, *(float(settings.get(n, 0)) for n in A.NAMES))], "k int, " + ", ".join(f"{n} double" for n in A.NAMES)))
    codes = np.array([[r.r, r.g, r.b] for r in A.rendered(held).select("r", "g", "b").collect()])
    return np.sort((codes @ np.array([54, 183, 19]) + 128) >> 8)


def percentile(codes, p):
    n, at = len(codes), codes[max(0, math.ceil(p * len(codes)) - 1)]
    below, here = (codes < at).sum(), (codes == at).sum()
    return (at + min(1, max(0, (p * n - below) / here))) / 256


def test_exposure_by_bisection_one_image_at_a_time(spark):
    rng = np.random.default_rng(8)
    images = {k: np.clip(rng.lognormal(mean, 0.5, (16, 16, 3)), 0, 4) for k, mean in enumerate((-4.5, -2.6, -1.9, -0.3))}
    got = {r.image_id: r for r in A.auto_tone(sample(spark, images)).collect()}
    alone = {r.image_id: r.exposure for r in A.auto_setting(sample(spark, images), "exposure").collect()}
    for k, image in images.items():
        s = sample(spark, {k: image})

        def f(v, s=s):
            return percentile(measured(spark, s, {"exposure": v}), 0.5)

        for target, value in (((0.40, 0.52), got[k].exposure), ((0.46, 0.46), alone[k])):
            now = f(0.0)
            if target[0] <= now <= target[1]:
                expected = 0.0
            else:
                low, high, to = (0.0, 2.5, target[0]) if now < target[0] else (-2.0, 0.0, target[1])
                ends = f(low), f(high)
                if ends[0] >= to or ends[1] <= to:
                    expected = low if ends[0] >= to else high
                else:
                    for _ in range(7):
                        mid = (low + high) / 2
                        low, high = (mid, high) if f(mid) < to else (low, mid)
                    expected = (low + high) / 2
            assert value == pytest.approx(math.floor(abs(expected) / 0.05 + 0.5) * 0.05 * (1 if expected > 0 else -1), abs=1e-9)


def test_tones_of_dull_and_colourful_photos(spark):
    flat = grey(0.1 + 0.1 * np.random.default_rng(1).random((20, 20)))
    colourful = np.random.default_rng(2).random((20, 20, 3)) * np.array([1.0, 0.1, 0.6])
    got = {r.image_id: r for r in A.auto_tone(sample(spark, {1: flat, 2: colourful})).collect()}
    assert got[1].vibrance == 20 and got[2].vibrance == 0 and got[1].contrast > 0
    assert A.auto_setting(sample(spark, {1: flat, 2: colourful}), "vibrance").count() == 2
    assert A.auto_tone(sample(spark, {1: flat}).limit(0)).count() == 0
