"""Sampling, lenses, fringes and retouching against brute force on whole images."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fotolith.plans import fringes as C
from fotolith.plans import lens as N
from fotolith.plans import retouch as R
from fotolith.plans import sampling as S
from fotolith.plans import tiles as T

from test_light import pixels

RNG = np.random.default_rng(7)


def image_of(df, image, h, w):
    out = np.full((h, w, 3), np.nan)
    for r in df.filter(f"image_id = {image}").collect():
        out[r.y, r.x] = (r.r, r.g, r.b)
    return out


def between(p, x, y):
    """A plane at pixel places x, y."""
    x, y = np.clip(x, 0, p.shape[1] - 1), np.clip(y, 0, p.shape[0] - 1)
    ix, iy = np.floor(x).astype(int), np.floor(y).astype(int)
    jx, jy = np.minimum(ix + 1, p.shape[1] - 1), np.minimum(iy + 1, p.shape[0] - 1)
    tx, ty = x - ix, y - iy
    if p.ndim == 3 and np.ndim(tx):
        tx, ty = tx[..., None], ty[..., None]
    top, low = p[iy, ix] + (p[iy, jx] - p[iy, ix]) * tx, p[jy, ix] + (p[jy, jx] - p[jy, ix]) * tx
    return top + (low - top) * ty


def test_points_are_sampled_over_tile_borders(spark):
    images = {1: RNG.random((70, 140, 3)), 2: RNG.random((3, 2, 3))}
    df = pixels(spark, images)
    rows = [(i, k, float(x), float(y)) for i in images for k, (x, y) in enumerate(RNG.random((300, 2)) * 160 - 10)] + [(1, 900, 63.0, 63.5), (1, 901, 139.0, 69.0), (1, 902, 64.0, 64.0)]
    got = S.gathered(spark.createDataFrame(rows, "image_id long, k long, sx double, sy double"), df, T.frames(df), {"r": "red", "b": "blue"})
    assert got.count() == len(rows)
    for r in got.collect():
        assert abs(between(images[r.image_id][..., 0], r.sx, r.sy) - r.red) < 1e-12 and abs(between(images[r.image_id][..., 2], r.sx, r.sy) - r.blue) < 1e-12


# Lenses.

KNOTS = [0.0, 0.3, 0.55, 0.8, 1.0]


def curve_by_hand(knots, values, x):
    if x <= knots[0]:
        return values[0]
    if x >= knots[-1]:
        return values[-1]
    i = max(k for k in range(len(knots) - 1) if knots[k] <= x)

    def slope(j):
        a, b = max(0, j - 1), min(len(knots) - 1, j + 1)
        return (values[b] - values[a]) / (knots[b] - knots[a])

    h = knots[i + 1] - knots[i]
    t = (x - knots[i]) / h
    return (2 * t**3 - 3 * t**2 + 1) * values[i] + (t**3 - 2 * t**2 + t) * h * slope(i) + (3 * t**2 - 2 * t**3) * values[i + 1] + (t**3 - t**2) * h * slope(i + 1)


def lens_by_hand(p, distortion, vignetting, red, blue):
    h, w, _ = p.shape
    half, ones = math.hypot(w, h) / 2, [1.0] * len(KNOTS)
    distortion, vignetting, red, blue = (v or ones for v in (distortion, vignetting, red, blue))
    fits = lambda s: all(s * curve_by_hand(KNOTS, distortion, s * i / 64) <= 1 + 1e-6 for i in range(65))
    fill = 1.0
    if not fits(1.0):
        low, high = 0.75, 1.0
        for _ in range(30):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        fill = low
    out = np.zeros_like(p)
    for y in range(h):
        for x in range(w):
            dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
            k = fill * curve_by_hand(KNOTS, distortion, math.hypot(dx, dy) / half * fill)
            dx, dy = dx * k, dy * k
            r = math.hypot(dx, dy) / half
            for c, scale in enumerate((curve_by_hand(KNOTS, red, r), 1.0, curve_by_hand(KNOTS, blue, r))):
                out[y, x, c] = between(p[..., c], w / 2 + dx * scale - 0.5, h / 2 + dy * scale - 0.5) / curve_by_hand(KNOTS, vignetting, r)
    return out


def test_lens_profiles(spark):
    images = {k: RNG.random((50, 70, 3)) for k in range(1, 7)}
    df = pixels(spark, images)
    bent, dark = [1.0, 0.99, 0.97, 0.95, 0.94], [1.0, 0.98, 0.9, 0.8, 0.6]
    out_, red, blue = [1.0, 1.01, 1.02, 1.04, 1.06], [1.0, 1.001, 1.002, 1.002, 1.003], [1.0, 0.999, 0.998, 0.998, 0.997]
    lenses = [(1, KNOTS, bent, dark, red, blue), (2, KNOTS, out_, None, None, None), (3, KNOTS, None, dark, None, None), (4, KNOTS[::-1], bent, None, None, None), (5, KNOTS, bent[:3], None, None, None)]
    got = N.corrected(df, T.frames(df), spark.createDataFrame(lenses, "image_id long, knots array<double>, distortion array<double>, vignetting array<double>, red array<double>, blue array<double>"))
    assert got.count() == 6 * 3500
    for k, knots, *curves in lenses[:3]:
        assert np.abs(image_of(got, k, 50, 70) - lens_by_hand(images[k], *curves)).max() < 1e-9
    for k in (4, 5, 6):  # no sound profile
        assert np.array_equal(image_of(got, k, 50, 70), images[k])


# Fringes.


def blocks(h, w, seed, scale=1.0, bend=0.0):
    """Soft blocks of random brightness, drawn 1 + scale larger about the centre."""
    values = np.random.default_rng(seed).random((h // 6 + 20, w // 6 + 20)) * 0.6 + 0.1
    y, x = np.mgrid[:h, :w] + 0.5
    dx, dy = x - w / 2, y - h / 2
    rho = (dx * dx + dy * dy) / ((w * w + h * h) / 4)
    s = 1 - scale - bend * rho
    return between(values, (w / 2 + dx * s) / 6 + 4, (h / 2 + dy * s) / 6 + 4)


def test_planted_fringes_are_found_and_undone(spark):
    planted = {1: (0.003, -0.002), 2: (0.0, 0.004), 3: (-0.0015, 0.0)}
    images = {k: np.stack([blocks(330, 360, k, r), blocks(330, 360, k, 0.0), blocks(330, 360, k, b)], 2) for k, (r, b) in planted.items()}
    images[4] = RNG.random((330, 360, 3))  # channels that don't match
    images[5] = np.full((200, 200, 3), 0.4)
    images[6] = np.stack([blocks(100, 400, 6)] * 3, 2)
    df = pixels(spark, images).cache()
    got = {r.image_id: r for r in C.estimated(df).collect()}
    assert sorted(got) == [1, 2, 3]
    half = math.hypot(330, 360) / 2
    for k, (r, b) in planted.items():
        assert abs(got[k].red_shift - r * half) < 0.12 and abs(got[k].blue_shift - b * half) < 0.12
        assert abs(got[k].red_a + got[k].red_b - r) < 5e-4
    fixed = C.applied(df, T.frames(df), spark.createDataFrame([(k, v.red_a, v.red_b, v.blue_a, v.blue_b) for k, v in got.items()], "image_id long, red_a double, red_b double, blue_a double, blue_b double"))
    after, before = image_of(fixed, 1, 330, 360), images[1]
    inner = (slice(20, -20), slice(20, -20))
    assert np.abs(after[..., 0] - after[..., 1])[inner].mean() < 0.3 * np.abs(before[..., 0] - before[..., 1])[inner].mean()
    assert np.array_equal(image_of(fixed, 4, 330, 360), images[4])


def test_fringes_of_large_images_made_by_tiles(spark):
    """The query's rows are those of its large images as pixels, which are never dealt out."""
    import fotolith.queries as Q
    from fotolith.adapters import Library
    from pyspark.sql import functions as F

    sf, sc = "/root/testdata/sf0.001", spark.sparkContext
    sc.setJobGroup("fringes", "fringes")
    got = {r.image_id: tuple(r) for r in Q.QUERIES["px_fringe_fit"](spark, sf).collect()}
    sc.setLocalProperty("spark.jobGroup.id", None)
    small = Library(spark, sf).pixels()
    store = sc._jsc.sc().statusStore()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("fringes") for s in sc.statusTracker().getJobInfo(j).stageIds}
    dealt = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert dealt < 4 * small.count()  # 25 times as many are in the large images, which were dealt out again and again
    pixels = small.filter("image_id in (1, 7)").cache()  # a whole one and one of fewer lines
    sized = T.frames(pixels)
    fives = F.explode(F.array(*map(F.lit, range(5))))
    large = pixels.select("image_id", "y", "x", fives.alias("i")).select("*", fives.alias("j"))
    large = large.select("image_id", (F.col("y") * 5 + F.col("j")).alias("y"), (F.col("x") * 5 + F.col("i")).alias("x")).join(sized, "image_id")
    for c, by in (("r", (F.col("image_id") % 5 - 2) * 0.0015), ("g", F.lit(0.0)), ("b", (F.col("image_id") % 3 - 1) * 0.002)):
        place = lambda a, n, by=by: (F.col(n) * 2.5 + (F.col(a) + 0.5 - F.col(n) * 2.5) * (1.0 - by)) / 5.0 - 0.5
        large = S.gathered(large.withColumns({"sx": place("x", "width"), "sy": place("y", "height")}), pixels, sized, {"g": c}).drop("sx", "sy")
    found = C.estimated(large.select("image_id", "y", "x", "r", "g", "b"))
    rows = found.select("image_id", *(F.round(c, 4).alias(c) for c in ("red_a", "red_b", "blue_a", "blue_b", "red_shift", "blue_shift"))).collect()
    assert sorted(r.image_id for r in rows) == [1, 7] and all(np.allclose(tuple(r), got[r.image_id], rtol=0, atol=1e-4) for r in rows)


def test_blocks_beside_missing_pixels():
    from fotolith.queries_retouch import _enlarged

    g = 0.1 + 0.6 * RNG.random((64, 64))
    tile = lambda held: T.Tile(1, 0, 0, (slice(0, 64), slice(0, 64)), {"g": np.where(held > 0, g, 0.0), "held": held}, {"width": 64.0, "height": 64.0, "reach": 6.0})
    held = np.ones((64, 64))
    whole = _enlarged(tile(held))
    cut = T.Tile(1, 9, 0, (slice(0, 55), slice(0, 64)), {"g": g[9:], "held": held[9:]}, {"width": 64.0, "height": 64.0, "reach": 6.0})  # begins late
    assert sorted(set(_enlarged(cut)["top"])) == [64, 96, 128, 160, 192, 224]
    held[30] = 0.0  # lines 150 to 154 of the large image, and those that sample them
    part = _enlarged(tile(held))
    assert len(whole["top"]) == 49 and sorted(set(part["top"])) == [32, 64, 96, 192, 224]
    at = {(a, b): (r, g) for a, b, r, g in zip(whole["top"], whole["left"], whole["r"], whole["g"])}
    far = [(a, b, r, g) for a, b, r, g in zip(part["top"], part["left"], part["r"], part["g"]) if a in (32, 64, 224)]
    assert far and all(np.allclose(np.frombuffer(r), np.frombuffer(at[a, b][0]), atol=1e-9) and np.allclose(np.frombuffer(g), np.frombuffer(at[a, b][1]), atol=1e-9) for a, b, r, g in far)


# Retouching.


def placed_by_hand(s, w, h):
    kind, x, y, sx, sy, radius, feather, opacity = s
    return kind, x * w, y * h, (sx - x) * w, (sy - y) * h, max(1.0, radius * max(w, h)), 1 - feather / 100, opacity / 100


def heal_by_hand(p, spots):
    p = p.copy()
    h, w, _ = p.shape
    for s in spots:
        kind, cx, cy, dx, dy, r, inner, opacity = placed_by_hand(s, w, h)
        grid = None
        if kind == "heal":
            n = min(128, max(12, math.ceil(math.tau * r / 2)))
            turn = np.arange(n) / n * math.tau
            c, t = np.cos(turn), np.sin(turn)
            diff = sum(between(p, cx + c * (r + o) - 0.5, cy + t * (r + o) - 0.5) - between(p, cx + c * (r + o) + dx - 0.5, cy + t * (r + o) + dy - 0.5) for o in (0, 1, 2)) / 3
            width = max(1, n // 16)
            diff = np.array([np.mean([diff[(k + j - width) % n] for j in range(2 * width + 1)], 0) for k in range(n)])
            step = max(1.0, r / 24)
            cells = math.ceil(2 * r / step) + 2
            start = -(cells - 1) * step / 2
            grid = np.zeros((cells, cells, 3))
            for j in range(cells):
                for i in range(cells):
                    weight = 1 / np.maximum((start + i * step - c * r) ** 2 + (start + j * step - t * r) ** 2, 1e-3)
                    grid[j, i] = (weight[:, None] * diff).sum(0) / weight.sum()
        old = p.copy()
        for y in range(h):
            for x in range(w):
                d = math.hypot(x + 0.5 - cx, y + 0.5 - cy) / r
                k = min(1, max(0, (d - inner) / (1 - inner))) if inner < 1 else float(d > inner)
                alpha = opacity * (0 if d >= 1 else 1 if d <= inner else 1 - k * k * (3 - 2 * k))
                if alpha > 0:
                    v = between(old, x + dx, y + dy)
                    if grid is not None:
                        v = v + between(grid, (x + 0.5 - cx - start) / step, (y + 0.5 - cy - start) / step)
                    p[y, x] = np.floor(np.clip(old[y, x] + (v - old[y, x]) * alpha, 0, 1) * 65535 + 0.5) / 65535
    return p


SPOTS = "image_id long, nth long, kind string, x double, y double, source_x double, source_y double, radius double, feather double, opacity double"


def test_spots_see_those_before_them(spark):
    images = {1: RNG.random((80, 100, 3)), 2: RNG.random((40, 50, 3)), 3: RNG.random((30, 30, 3))}
    first = [("heal", 0.64, 0.8, 0.3, 0.4, 0.08, 30.0, 100.0), ("clone", 0.66, 0.78, 0.62, 0.82, 0.06, 50.0, 70.0), ("heal", 0.2, 0.3, 0.66, 0.78, 0.05, 0.0, 100.0), ("heal", 0.9, 0.1, 0.5, 0.1, 0.03, 100.0, 50.0)]
    second = [("clone", 0.0, 0.0, 0.5, 0.5, 0.25, 20.0, 100.0), ("heal", 0.5, 0.5, 0.5, 0.5, 0.1, 0.0, 100.0)]
    rows = [(i, k, *s) for i, spots in ((1, first), (2, second)) for k, s in enumerate(spots)]
    df = pixels(spark, images)
    got = R.retouched(df, T.frames(df), spark.createDataFrame(rows, SPOTS))
    assert got.count() == sum(p.shape[0] * p.shape[1] for p in images.values())
    for i, spots in ((1, first), (2, second[:1]), (3, [])):
        h, w, _ = images[i].shape
        assert np.abs(image_of(got, i, h, w) - heal_by_hand(images[i], spots)).max() < 1e-9
    assert np.abs(heal_by_hand(images[1], first) - heal_by_hand(images[1], first[::-1])).max() > 0.01


def test_no_spots(spark):
    df = pixels(spark, {1: RNG.random((8, 9, 3))})
    assert R.retouched(df, T.frames(df), spark.createDataFrame([], SPOTS)).count() == 72


def source_by_hand(p, x, y, radius, avoid):
    h, w, _ = p.shape
    cx, cy, r = x * w, y * h, max(1.0, radius * max(w, h))
    look = lambda a, b: np.sqrt(between(p, a - 0.5, b - 0.5))
    angles = lambda n: [(math.cos(i / n * math.tau), math.sin(i / n * math.tau)) for i in range(n)]
    ring = [(c * r * k, s * r * k) for k in (1.2, 1.5) for c, s in angles(24)]
    inside = [(c * r * 0.6, s * r * 0.6) for c, s in angles(12)] + [(0.0, 0.0)]
    around = [look(cx + a, cy + b) for a, b in ring]
    mean, best = np.mean(around, 0), None
    for d in (2.5, 3.5, 5.0):
        for c, s in angles(24):
            sx, sy = cx + c * r * d, cy + s * r * d
            if min(sx, sy, w - sx, h - sy) < r * 1.6 or any(math.hypot(a * w - sx, b * h - sy) < max(1.0, q * max(w, h)) + r for a, b, q in avoid):
                continue
            cost = np.mean([((look(sx + a, sy + b) - o) ** 2).sum() for (a, b), o in zip(ring, around, strict=True)]) + np.mean([((look(sx + a, sy + b) - mean) ** 2).sum() for a, b in inside])
            cost *= 1 + 0.05 * d
            if best is None or cost < best[2] - 1e-15:
                best = sx / w, sy / h, cost
    return best


def test_sources_equal_brute_force(spark):
    images = {1: RNG.random((90, 120, 3)), 2: RNG.random((70, 70, 3)), 3: np.full((60, 60, 3), 0.3), 4: RNG.random((20, 20, 3))}
    wanted = [(1, 0, 0.5, 0.5, 0.04), (1, 1, 0.1, 0.9, 0.05), (2, 0, 0.7, 0.2, 0.03), (3, 0, 0.5, 0.5, 0.05), (4, 0, 0.5, 0.5, 0.25)]
    avoid = [(1, 0.6, 0.6, 0.05), (1, 0.2, 0.7, 0.1), (2, 0.5, 0.5, 0.02)]
    df = pixels(spark, images)
    got = {(r.image_id, r.nth): tuple(r)[2:] for r in R.find_sources(df, T.frames(df), spark.createDataFrame(wanted, "image_id long, nth long, x double, y double, radius double"), spark.createDataFrame(avoid, "image_id long, x double, y double, radius double")).collect()}
    for i, n, x, y, radius in wanted:
        assert got.get((i, n)) == pytest.approx(source_by_hand(images[i], x, y, radius, [a[1:] for a in avoid if a[0] == i]), abs=1e-9)


# Red eyes.


def eyes_by_hand(p, eyes):
    p = p.copy()
    h, w, _ = p.shape
    step = lambda a, b, v: (lambda t: t * t * (3 - 2 * t))(min(1.0, max(0.0, (v - a) / (b - a))))
    for x, y, radius, pupil, darken in eyes:
        cx, cy, r, t, dark = x * w, y * h, max(1.5, radius * max(w, h)), 0.65 - 0.2 * pupil / 100, 1 - 0.75 * darken / 100
        box = [(j, i) for j in range(max(0, math.floor(cy - r)), min(h, math.ceil(cy + r))) for i in range(max(0, math.floor(cx - r)), min(w, math.ceil(cx + r)))]
        red = lambda v: 0.0 if v[0] < 0.002 else max(0.0, (v[0] - max(v[1], v[2])) / v[0])
        own = {(j, i): (1 - step(0.75, 1.0, math.hypot(i + 0.5 - cx, j + 0.5 - cy) / r)) * step(t - 0.12, t + 0.05, red(p[j, i])) for j, i in box}
        old = p.copy()
        for j, i in box:
            near = [own[j + a, i + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (j + a, i + b) in own]
            a = (own[j, i] + np.mean(near)) / 2
            if a > 0:
                _, g, b = old[j, i]
                shade = min(1.0, max(dark, 1 - (1 - dark) * own[j, i] / max(a, 1e-6)))
                p[j, i] = np.floor(np.clip(old[j, i] + (np.array([(g + b) / 2, g, b]) * shade - old[j, i]) * a, 0, 1) * 65535 + 0.5) / 65535
    return p


def face(h, w, pupils):
    p = np.array([0.5, 0.35, 0.25]) * (0.9 + 0.1 * RNG.random((h, w, 1)))
    y, x = np.mgrid[:h, :w] + 0.5
    for cx, cy, r in pupils:
        inside = np.hypot(x - cx, y - cy) <= r
        p[inside] = np.array([0.6, 0.05, 0.08]) * (0.8 + 0.2 * RNG.random((inside.sum(), 1)))
        p[int(cy), int(cx)] = 0.9  # a catchlight
    return p


def test_red_eyes_are_found_and_corrected(spark):
    from fotolith.plans import redeye as E

    images = {1: face(80, 120, [(40, 30, 5), (75, 32, 4), (47, 34, 3)]), 2: face(60, 60, [(2, 58, 4)]), 3: face(40, 40, [])}
    df = pixels(spark, images)
    clicks = [(1, 0, 38 / 120, 33 / 80, 0.1), (1, 1, 0.6, 0.4, 0.1), (1, 2, 0.1, 0.1, 0.05), (2, 0, 0.0, 1.0, 0.2), (3, 0, 0.5, 0.5, 0.2)]
    got = {(r.image_id, r.nth): r for r in E.find(df, T.frames(df), spark.createDataFrame(clicks, "image_id long, nth long, x double, y double, search double")).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0)]
    red = lambda p: (p[..., 0] - np.maximum(p[..., 1], p[..., 2])) / p[..., 0] >= 0.55
    inside = red(images[1])
    y, x = np.nonzero(inside)
    one = np.hypot(x + 0.5 - 75, y + 0.5 - 32) <= 6
    e = got[1, 1]
    assert (e.x, e.y, e.radius) == pytest.approx(((x[one] + 0.5).mean() / 120, (y[one] + 0.5).mean() / 80, (math.sqrt(one.sum() / math.pi) * 1.5 + 1) / 120))
    eyes = {1: [(40 / 120, 30 / 80, 0.07, 50.0, 50.0), (47 / 120, 34 / 80, 0.05, 80.0, 100.0), (75 / 120, 32 / 80, 0.06, 0.0, 20.0)], 2: [(0.02, 0.97, 0.1, 50.0, 50.0)]}
    rows = [(i, n, *e) for i, some in eyes.items() for n, e in enumerate(some)] + [(3, 0, None, None, None, None, None)]
    fixed = E.corrected(df, T.frames(df), spark.createDataFrame(rows, "image_id long, nth long, x double, y double, radius double, pupil double, darken double"))
    assert fixed.count() == 80 * 120 + 3600 + 1600
    for i, some in ((1, eyes[1]), (2, eyes[2]), (3, [(0.5, 0.5, 0.01, 50.0, 50.0)])):
        apart = np.abs(image_of(fixed, i, *images[i].shape[:2]) - eyes_by_hand(images[i], some))
        assert apart.max() < 1.1 / 65535 and (i == 1 or apart.max() < 1e-9)  # where circles overlap, the mean of two levels may lie between two
    assert red(image_of(fixed, 1, 80, 120))[25:39, 68:82].sum() < 0.5 * red(images[1])[25:39, 68:82].sum()
