"""Recursions, tiles, signals and planes against plain loops, with small buckets, tiles and batches."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenflow.operators import planes as P
from lumenflow.operators import scans, tiles
from lumenflow.operators import signals as S
from lumenflow.operators.streams import Stream

ONE = Stream(("k",), "ts", ("i",), "hour")


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def stream(spark, rows=400, seed=1):
    """A stream of three quarters of the rows, a short one, one of a null key and one of a single row; times repeat, some are null, and so are some values."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        key = rng.choice(["a", "a", "a", "b", None] if i else ["one"])
        minutes = None if i % 97 == 5 else rng.randrange(0, 900) if key != "a" else rng.randrange(0, 60 * 300) // 30 * 30
        data.append((key, i, minutes, None if i % 41 == 3 else rng.uniform(-3, 3)))
    df = spark.createDataFrame(data, "k string, i long, minutes long, x double").withColumn("ts", F.timestamp_seconds(F.col("minutes") * 60).cast("timestamp_ntz"))
    streams = {}
    for key, i, minutes, x in sorted((r for r in data if r[2] is not None), key=lambda r: (r[2], r[1])):
        streams.setdefault(key, []).append((i, x))
    return df, streams


def test_affine_scan_as_a_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 97):
        a, b = rng.normal(size=(n, 3, 3)) / 2, rng.normal(size=(n, 3, 2))
        x, want = np.zeros((3, 2)), []
        for k in range(n):
            x = a[k] @ x + b[k]
            want.append(x)
        assert np.allclose(scans.affine_scan(a, b), want)


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_filters_as_a_loop(spark, small_batches, unit):
    df, streams = stream(spark)
    sections = [(0.4, 0.2, -0.1, -0.5, 0.25), (1.0, -2.0, 1.0, -1.2, 0.5)]
    got = {r.i: r.filtered for r in S.section_filtered(df, Stream(("k",), "ts", ("i",), unit), "x", sections).collect()}
    want = {}
    for rows in streams.values():
        past = [[0.0] * 4 for _ in sections]  # x1, x2, y1, y2
        for i, x in rows:
            v = x or 0.0
            for (b0, b1, b2, a1, a2), p in zip(sections, past, strict=True):
                y = b0 * v + b1 * p[0] + b2 * p[1] - a1 * p[2] - a2 * p[3]
                p[:] = [v, p[0], y, p[2]]
                v = y
            want[i] = v
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9, abs_tol=1e-9) for i in want)


def test_the_standards_filter_at_48_kilohertz():
    shelf, high = S.loudness_sections()
    assert np.allclose(shelf, (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585))
    assert np.allclose(high, (1, -2, 1, -1.99004745483398, 0.99007225036621))


def test_envelopes_as_a_loop(spark, small_batches):
    for attack, decay in ((0.3, 0.02), (0.05, 0.4), (1.0, 0.1)):
        df, streams = stream(spark, seed=int(attack * 100))
        points = [(-20, -30), (-3, -3), (6, 0)]
        got = {r.i: (r.envelope, r.companded) for r in S.companded(df, ONE, "x", attack, decay, points).collect()}
        n = 0
        for rows in streams.values():
            env = 0.0
            for i, x in rows:
                if x is not None:
                    env += (attack if abs(x) > env else decay) * (abs(x) - env)
                assert math.isclose(got[i][0], env, rel_tol=1e-9, abs_tol=1e-12)
                if x is None:
                    assert got[i][1] is None
                elif env > 0:
                    db = 20 * math.log10(env)
                    out = -30 + (db + 20) * 27 / 17 if db < -3 else -3 + (db + 3) / 3
                    assert math.isclose(got[i][1], x * 10 ** ((out - db) / 20), rel_tol=1e-9)
                n += 1
        assert n == len(got)


def test_an_envelopes_line_stays_short():
    chain = scans.Envelope("x", 0.3, 0.02, {"e": 0})
    x = np.random.default_rng(3).normal(size=50_000)
    line = chain.summaries({"x": x}, np.array([0, len(x)]), None)[0]
    assert len(line) < 200
    for start in (0.0, 0.7, 5.0, 1e6):
        want = chain.run({"x": x}, np.array([0, len(x)]), [np.array([start])])[-1, 0]
        assert math.isclose(chain.apply(line, np.array([start]))[0], want, rel_tol=1e-9)


def test_clock_filter_as_a_loop(spark, small_batches):
    df, streams = stream(spark)
    df = df.withColumn("pts", F.col("i") * 10.0 + F.coalesce("x", F.lit(0.0)))
    got = {r.i: r.smoothed for r in S.clock_filtered(df, ONE, "pts", 20.0, 0.1, 0.01).collect()}
    for rows in streams.values():
        for n, (i, x) in enumerate(rows, 1):
            t = i * 10.0 + (x or 0.0)
            if n == 1:
                cycle, length = t, 20.0
            else:
                cycle += length
                error = t - cycle
                cycle, length = cycle + max(0.1, 1 / n) * error, length + 0.01 * error
            assert math.isclose(got[i], cycle, rel_tol=1e-9, abs_tol=1e-6)


@pytest.mark.parametrize("size", [1, 2, 5, 8])
@pytest.mark.parametrize("ahead", [True, False])
def test_sliding_extremes(spark, size, ahead):
    rng = random.Random(size)
    rows = [(k, n, rng.choice([None, *range(50)])) for k, m in (("a", 61), (None, 8), ("c", 1)) for n in range(m)]
    df = spark.createDataFrame(rows, "k string, n long, v int")
    for how, best in (("max", max), ("min", min)):
        got = {(r.k, r.n): r.out for r in tiles.sliding_extreme(df, ["k"], "n", "v", size, "out", how, ahead, tile=10).collect()}
        for k, n, _ in rows:
            near = [v for a, b, v in rows if a == k and (n <= b < n + size if ahead else n - size < b <= n) and v is not None]
            assert got[k, n] == (best(near) if near else None)


def test_limiter_never_passes_the_limit(spark):
    df, streams = stream(spark)
    got = {r.i: r.limited for r in S.limited(df, ONE, "x", 1.0, 3, 0.2).collect()}
    for rows in streams.values():
        level = 0.0
        for n, (i, x) in enumerate(rows):
            peak = max((abs(v) for _, v in rows[n : n + 4] if v is not None), default=0.0)
            level = max(peak, level * 0.8)
            assert got[i] is None if x is None else math.isclose(got[i], x / max(level, 1.0), rel_tol=1e-9)
            assert x is None or abs(got[i]) <= 1.0 + 1e-9


def test_loudness_of_a_tone_and_of_silence(spark):
    n = 48_000 * 4
    df = spark.range(2 * n).select((F.col("id") % 2).alias("k"), F.expr("id div 2").alias("i"), F.timestamp_micros((F.expr("id div 2") * 1_000_000 / 48_000).cast("long")).cast("timestamp_ntz").alias("ts"))
    df = df.withColumn("x", F.when(F.col("k") == 0, F.sin(2 * F.pi() * 997 * F.col("i") / 48_000)).otherwise(0.0))
    w = S.loudness_windows(df, Stream(("k",), "ts", ("i",), "second"), "x", 4800)
    got = {r.k: r for r in S.loudness(w, ["k"]).collect()}
    assert abs(got[0].integrated + 3.01) < 0.02 and abs(got[0].peak - 1) < 1e-3  # a full-scale sine of 997 Hz, as the standard says
    assert got[1].integrated is None and got[1].windows is None and got[1].peak == 0


def test_resampling(spark):
    df = spark.range(900).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), F.sin(F.col("id") * 0.2).alias("x"))
    same = {r.m: r.sample for r in S.rate_changed(df, ONE, "x", 1, 1, 4, tile=16).collect()}
    assert len(same) == 900 and all(math.isclose(same[m], math.sin(m * 0.2), abs_tol=1e-12) for m in same)
    for up, down in ((3, 2), (2, 3), (7, 5)):
        out = {r.m: r.sample for r in S.rate_changed(df, ONE, "x", up, down, 16, tile=16).collect()}
        assert sorted(out) == list(range(math.floor((900 * up - 1) / down) + 1))
        assert all(abs(out[m] - math.sin(m * down / up * 0.2)) < 0.01 for m in out if 40 < m * down / up < 860)


def test_mixing(spark):
    rows = spark.createDataFrame([(1, "l", 2.0), (1, "r", 4.0), (2, "l", 1.0), (2, None, 9.0), (3, "x", 5.0), (4, "r", None)], "t long, c string, v double")
    m = spark.createDataFrame([("mono", "l", 0.5), ("mono", "r", 0.5), ("side", "l", 1.0), ("side", "r", -1.0), ("void", None, 1.0)], "out string, in string, gain double")
    got = {(r.t, r.out): r.value for r in S.mixed(rows, ["t"], "c", "v", m).collect()}
    assert got == {(1, "mono"): 3.0, (1, "side"): -2.0, (2, "mono"): 0.5, (2, "side"): 1.0, (2, "void"): 9.0, (4, "mono"): 0.0, (4, "side"): 0.0}


# Planes ---------------------------------------------------------------------


def plane(spark, w=23, h=17, seed=4):
    v = np.random.default_rng(seed).integers(0, 255, (h, w)).astype(float)
    return v, spark.createDataFrame([("p", x, y, float(v[y, x])) for y in range(h) for x in range(w)], "p string, x long, y long, v double")


def as_array(df, name="v"):
    rows = df.collect()
    out = np.full((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.nan)
    for r in rows:
        assert math.isnan(out[r.y, r.x])
        out[r.y, r.x] = r[name]
    return out


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_unsharp_over_tiles(spark, tile):
    v, df = plane(spark)
    wx, wy = P.binomial(5), P.binomial(3)
    assert sum(wx) == sum(wy) == 1
    p = np.pad(v, ((1, 1), (2, 2)), "edge")
    blur = sum(wx[i] * wy[j] * p[j : j + v.shape[0], i : i + v.shape[1]] for i in range(5) for j in range(3))
    assert np.allclose(as_array(P.unsharp(df, ["p"], "v", 5, 3, 0.7, tile=tile), "sharp"), v + 0.7 * (v - blur))


def test_padding(spark):
    v, df = plane(spark)
    assert np.array_equal(as_array(P.padded(df, ["p"], "v", 2, 1, 3, 4, 9.0)), np.pad(v, ((1, 4), (2, 3)), constant_values=9.0))
    assert np.array_equal(as_array(P.padded(df, ["p"], "v", 0, 0, 0, 0, 9.0)), v)


def test_remapping(spark):
    v, df = plane(spark)
    rng = random.Random(5)
    asked = [("p", i, 0, rng.uniform(-2, 25), rng.uniform(-2, 19)) for i in range(300)] + [("p", 300, 0, None, 1.0), ("other", 0, 0, 1.0, 1.0)]
    places = spark.createDataFrame(asked, "p string, x long, y long, sx double, sy double")
    near = {(r.p, r.x): r.v for r in P.remapped(df, places, ["p"], "v", -1.0).collect()}
    soft = {(r.p, r.x): r.v for r in P.remapped(df, places, ["p"], "v", -1.0, linear=True).collect()}
    for p, i, _, sx, sy in asked:
        if p != "p" or sx is None or not (0 <= sx < 23 and 0 <= sy < 17):
            assert near[p, i] == soft[p, i] == -1.0
            continue
        assert near[p, i] == v[int(sy), int(sx)]
        u, w = min(max(sx - 0.5, 0), 22), min(max(sy - 0.5, 0), 16)
        a, b = int(u), int(w)
        c, d = min(a + 1, 22), min(b + 1, 16)
        want = (v[b, a] * (1 - u + a) + v[b, c] * (u - a)) * (1 - w + b) + (v[d, a] * (1 - u + a) + v[d, c] * (u - a)) * (w - b)
        assert math.isclose(soft[p, i], want, rel_tol=1e-9, abs_tol=1e-9)


def test_lut_of_itself_and_of_a_plane(spark):
    n = spark.range(27).select(F.expr("id div 9").alias("i"), F.expr("id div 3 % 3").alias("j"), F.expr("id % 3").alias("k"))
    same = n.select("i", "j", "k", *[(F.col(c) / 2).alias(o) for c, o in zip("ijk", "rgb", strict=True)])
    rng = random.Random(6)
    cols = [(i, rng.random(), rng.random(), rng.random()) for i in range(200)] + [(200, 0.0, 0.5, 1.0), (201, 1.0, 1.0, 1.0), (202, -3.0, 0.2, 7.0), (203, None, 0.1, 0.2)]
    rows = spark.createDataFrame(cols, "id long, r double, g double, b double")
    for how in ("trilinear", "tetrahedral"):
        got = {x.id: (x.lut_r, x.lut_g, x.lut_b) for x in P.looked_up(rows, same, 3, how=how).collect()}
        assert len(got) == len(cols)
        for i, *c in cols[:-1]:
            assert np.allclose(got[i], np.clip(c, 0, 1))
        assert got[203] == (None, None, None)


def plain_palette(colours, levels):
    boxes = {1: list(colours)}
    for _ in range(levels):
        out = {}
        for b, rows in boxes.items():
            spread = [max(c[a] for c in rows) - min(c[a] for c in rows) for a in range(3)]
            axis = spread.index(max(spread))
            if not spread[axis]:
                out[2 * b] = rows
                continue
            values, top = sorted(c[axis] for c in rows), max(c[axis] for c in rows)
            cut = values[(len(values) + 1) // 2 - 1]
            cut = cut if cut < top else max(v for v in values if v < top)
            out[2 * b] = [c for c in rows if c[axis] <= cut]
            out[2 * b + 1] = [c for c in rows if c[axis] > cut]
        boxes = out
    return {b: (*[math.floor(sum(c[a] for c in rows) / len(rows) + 0.5) for a in range(3)], len(rows)) for b, rows in boxes.items()}


def test_palettes(spark):
    rng = random.Random(7)
    colours = [tuple(rng.choice([0, 3, 40, 41, 42, 200, 255]) for _ in range(3)) for _ in range(300)] + [(9, 9, 9)] * 150
    df = spark.createDataFrame(colours, "r int, g int, b int")
    for levels in (0, 1, 3, 6):
        got = {r.box: (r.r, r.g, r.b, r.rows) for r in P.palette(df, ["r", "g", "b"], levels).collect()}
        assert got == plain_palette(colours, levels)
    assert P.palette(df.where("false"), ["r", "g", "b"], 3).count() == 0


def test_measures_see_what_they_are_for(spark):
    y, x = np.mgrid[0:48, 0:64]
    smooth = 100 + 40 * np.sin(x / 9.0) + 30 * np.cos(y / 7.0)
    blocks = smooth + 25 * ((x // 8 + y // 8) % 2)
    sharp = np.where((x // 6) % 2, 200.0, 50.0)
    soft = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 4, "edge"), np.ones(5) / 5, "same")[4:-4], 1, sharp)
    rows = [(n, int(j), int(i), float(v[i, j]), float(smooth[i, j])) for n, v in (("smooth", smooth), ("blocks", blocks), ("sharp", sharp), ("soft", soft)) for i in range(48) for j in range(64)]
    df = spark.createDataFrame(rows, "p string, x long, y long, v double, o double")
    block = {r.p: r for r in P.blockiness(df, ["p"], "v").collect()}
    assert (block["blocks"].period, block["blocks"].phase) == (8, 0) and block["blocks"].block > 3 > block["smooth"].block
    blur = {r.p: r.blur for r in P.edge_widths(df, ["p"], "v", 10.0).collect()}
    assert blur["sharp"] == 1.0 and blur["soft"] > 3
    error = {r.p: r for r in P.weighted_error(df, ["p"], "v", "o").collect()}
    assert error["smooth"].wsse == 0 and error["smooth"].xpsnr is None and error["blocks"].xpsnr > 10
    keyed = P.colour_keyed(df.where("p = 'sharp'"), ["v", "o", "v"], [50, 100, 50], 60.0)
    assert {r.alpha for r in keyed.collect()} == {0.0, 1.0}


@pytest.mark.parametrize("threshold", [0.0, 0.5, 2.5, 100.0])
def test_decimation_as_a_loop(spark, small_batches, threshold):
    df, streams = stream(spark, seed=int(threshold * 10) + 3)
    got = sorted(r.i for r in S.decimated(df, ONE, "x", threshold).collect())
    want = []
    for rows in streams.values():
        last = None
        for i, x in rows:
            if x is not None and (last is None or abs(x - last) > threshold):
                last = x
                want.append(i)
    assert got == sorted(want)


def test_kept_levels_over_pieces_are_those_of_the_whole():
    rng = np.random.default_rng(5)
    for t in (0.0, 0.3, 1.0):
        chain = scans.Kept("x", t, {"kept": 1})
        x = np.cumsum(rng.normal(size=400)) / 5
        x[rng.random(400) < 0.1] = np.nan
        whole = chain.summaries({"x": x}, np.array([0, 400]), None)[0]
        carry = None
        for a in range(0, 400, 37):
            carry = chain.summaries({"x": x[a : a + 37]}, np.array([0, len(x[a : a + 37])]), carry)[0]
        for start in (float("nan"), *rng.normal(size=50), *x[~np.isnan(x)][:50]):
            want = chain.run({"x": x}, np.array([0, 400]), [np.array([start, 0.0])])[-1, 0]
            for summary in (whole, carry):
                got = chain.apply(summary, np.array([start, 0.0]))[0]
                assert got == want or (got != got and want != want)


def test_kept_levels_are_compared_as_rows_are():
    """Values of two decimals whose difference is the threshold but for rounding: 22.01 - 2.01 isn't above 20, though 2.01 is below 22.01 - 20."""
    chain = scans.Kept("x", 20.0, {"kept": 1})
    levels = np.arange(0, 54_000, 7) / 100
    for level in levels:
        for value in (np.rint(level * 100) + 2000) / 100, (np.rint(level * 100) - 2000) / 100:
            x = {"x": np.array([value, value])}
            want = chain.run(x, np.array([0, 2]), [np.array([level, 0.0])])[-1, 0]
            first = chain.summaries({"x": x["x"][:1]}, np.array([0, 1]), None)[0]
            for summary in (chain.summaries(x, np.array([0, 2]), None)[0], chain.summaries({"x": x["x"][1:]}, np.array([0, 1]), first)[0]):
                assert chain.apply(summary, np.array([level, 0.0]))[0] == want
