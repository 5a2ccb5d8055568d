"""Numeric kernels on array columns and small planes, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def scalar_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def sum_abs_diff(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def sum_squared_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def psnr(mse: Column, peak: float) -> Column:
    """Decibels; null for equal planes, whose distortion has no logarithm."""
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def count_at_most(a: Column, threshold: float) -> Column:
    return F.size(F.filter(a, lambda x: x <= threshold)).cast("long")


def threshold_select(value: Column, threshold: Column, low: Column, high: Column) -> Column:
    return F.when(value <= threshold, low).otherwise(high)


def hermite(x: Column, x0: Column, x1: Column, p0: Column, p1: Column, m0: Column, m1: Column) -> Column:
    """Cubic through (x0, p0) and (x1, p1) with tangents m0 and m1."""
    w = x1 - x0
    t = (x - x0) / w
    slope0, slope1 = m0 * w, m1 * w
    return p0 + t * (slope0 + t * (3 * (p1 - p0) - 2 * slope0 - slope1 + t * (2 * (p0 - p1) + slope0 + slope1)))


def box_mean(a: Column, radius: int) -> Column:
    """Mean over [i - radius, i + radius], cut at the edges and divided by what is there."""

    def at(_, i: Column) -> Column:
        lo = F.greatest(i - radius, F.lit(0))
        part = F.slice(a, lo + 1, F.least(i + radius, F.size(a) - 1) - lo + 1)
        return F.aggregate(part, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(part)

    return F.transform(a, at)


def box_extreme(a: Column, radius: int, largest: bool, most: float | None = None) -> Column:
    """Dilation (largest) or erosion over the same neighbourhood; `most` limits how far a value changes."""
    pick = F.array_max if largest else F.array_min

    def at(x: Column, i: Column) -> Column:
        lo = F.greatest(i - radius, F.lit(0))
        found = pick(F.slice(a, lo + 1, F.least(i + radius, F.size(a) - 1) - lo + 1))
        if most is None:
            return found
        return F.least(found, x + most) if largest else F.greatest(found, x - most)

    return F.transform(a, at)


def transposed(a: Column, width: int, height: int) -> Column:
    """A plane of height rows of width values, turned over its diagonal."""
    places = F.sequence(F.lit(0), F.lit(width * height - 1))
    return F.transform(places, lambda i: F.get(a, (i % height) * width + F.floor(i / height).cast("int")))


def integral_image(a: Column, width: int) -> Column:
    """Summed-area table: sums over all rows and columns up to each place, with one addition for each place along its row and one down its column."""
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")), lambda r: F.slice(a, r * width + 1, width))
    none, zeros = F.array().cast("array<double>"), F.array_repeat(F.lit(0.0), width)
    along = F.transform(rows, lambda row: F.aggregate(row, F.struct(F.lit(0.0).alias("s"), none.alias("out")), lambda t, x: F.struct((t["s"] + x).alias("s"), F.concat(t["out"], F.array(t["s"] + x)).alias("out")), lambda t: t["out"]))
    down = lambda t, row: F.struct(F.zip_with(t["last"], row, lambda x, y: x + y).alias("last"), F.concat(t["out"], F.zip_with(t["last"], row, lambda x, y: x + y)).alias("out"))
    return F.aggregate(along, F.struct(zeros.alias("last"), none.alias("out")), down, lambda t: t["out"])


def bounding_range(a: Column, least: float) -> Column:
    """First and last place with a value above least; null if none."""
    places = F.filter(F.transform(a, lambda x, i: F.when(x > least, i)), lambda i: i.isNotNull())
    return F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last"))


def stereo_widened(left: Column, right: Column, m: float = 2.5) -> Column:
    """Difference from the mean times m, clipped to [-1, 1]."""
    mean = (left + right) / 2
    clip = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    return F.struct(clip(mean + m * (left - mean)).alias("left"), clip(mean + m * (right - mean)).alias("right"))


def _clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _over(x: Column, y: Column, if_zero: Column | float) -> Column:
    return F.when(y == 0, if_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def _levels(x: Column) -> Column:
    return F.round(x * 255).cast("int")


def _burn(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - _over(1 - b, a, 1.0)) * (a > 0).cast("double")


def _dodge(a: Column, b: Column) -> Column:
    return F.when(a >= 1, a).otherwise(F.least(F.lit(1.0), _over(b, 1 - a, 1.0)))


# Blend modes by name, for values from 0 to 1.
BLENDS = {
    "normal": lambda a, b: b,
    "average": lambda a, b: (a + b) / 2,
    "addition": lambda a, b: F.least(a + b, F.lit(1.0)),
    "subtract": lambda a, b: F.greatest(a - b, F.lit(0.0)),
    "multiply": lambda a, b: a * b,
    "screen": lambda a, b: 1 - (1 - a) * (1 - b),
    "difference": lambda a, b: F.abs(a - b),
    "negation": lambda a, b: 1 - F.abs(1 - a - b),
    "exclusion": lambda a, b: a + b - 2 * a * b,
    "darken": lambda a, b: F.least(a, b),
    "lighten": lambda a, b: F.greatest(a, b),
    "phoenix": lambda a, b: F.least(a, b) - F.greatest(a, b) + 1,
    "overlay": lambda a, b: F.when(a < 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b)),
    "hardlight": lambda a, b: F.when(b < 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b)),
    "and": lambda a, b: _levels(a).bitwiseAND(_levels(b)) / 255,
    "or": lambda a, b: _levels(a).bitwiseOR(_levels(b)) / 255,
    "xor": lambda a, b: _levels(a).bitwiseXOR(_levels(b)) / 255,
    "burn": _burn,
    "dodge": _dodge,
    "divide": lambda a, b: _clip(_over(a, b, 1.0)),
    "grainextract": lambda a, b: _clip(a - b + 0.5),
    "grainmerge": lambda a, b: _clip(a + b - 0.5),
    "pinlight": lambda a, b: F.when(b < 0.5, F.least(a, 2 * b)).otherwise(F.greatest(a, 2 * b - 1)),
    "reflect": lambda a, b: F.when(b >= 1, b).otherwise(F.least(F.lit(1.0), _over(a * a, 1 - b, 1.0))),
    "glow": lambda a, b: F.when(a >= 1, a).otherwise(F.least(F.lit(1.0), _over(b * b, 1 - a, 1.0))),
    "softlight": lambda a, b: b + F.when(a > 0.5, (1 - b) * (2 * a - 1)).otherwise(-b * (1 - 2 * a)) * (0.5 - F.abs(b - 0.5)),
    "vividlight": lambda a, b: F.when(a < 0.5, _burn(2 * a, b)).otherwise(_dodge(2 * a - 1, b)),
    "linearlight": lambda a, b: _clip(b + 2 * a - 1),
    "hardmix": lambda a, b: F.when(a < 1 - b, 0.0).otherwise(1.0),
    "multiply128": lambda a, b: _clip((a - 0.5) * b * 8 + 0.5),
    "heat": lambda a, b: F.when(a == 0, 0.0).otherwise(1 - F.least(_over((1 - b) * (1 - b), a, 1.0), F.lit(1.0))),
    "freeze": lambda a, b: F.when(b == 0, 0.0).otherwise(1 - F.least(_over((1 - a) * (1 - a), b, 1.0), F.lit(1.0))),
    "extremity": lambda a, b: F.abs(1 - a - b),
    "softdifference": lambda a, b: _clip(F.when(a > b, _over(a - b, 1 - b, 0.0)).otherwise(_over(b - a, b, 0.0))),
    "geometric": lambda a, b: F.sqrt(a * b),
    "harmonic": lambda a, b: _over(2 * a * b, a + b, 0.0),
    "bleach": lambda a, b: (1 - b) + (1 - a) - 1,
    "stain": lambda a, b: 2 - a - b,
    "interpolate": lambda a, b: (2 - F.cos(a * F.pi()) - F.cos(b * F.pi())) / 4,
    "hardoverlay": lambda a, b: F.when(a >= 1, 1.0).when(a > 0.5, F.least(F.lit(1.0), _over(b, 2 - 2 * a, 1.0))).otherwise(F.least(F.lit(1.0), 2 * a * b)),
}


def blended(mode: str, a: Column, b: Column, opacity: float = 1.0) -> Column:
    return a + (BLENDS[mode](a, b) - a) * opacity


def colour_norms(r: Column, g: Column, b: Column) -> Column:
    return F.struct(
        F.greatest(r, g, b).alias("max"), ((r + g + b) / 3).alias("average"), (r + g + b).alias("sum"), F.sqrt(r * r + g * g + b * b).alias("l2"), F.cbrt(r * r * r + g * g * g + b * b * b).alias("l3"), (0.2126 * r + 0.7152 * g + 0.0722 * b).alias("luminance")
    )


def nearest(points: DataFrame, palette: list[list[float]], value: str) -> DataFrame:
    """points with the number of the palette entry nearest to an array column, the first of equals; the palette is a constant of the plan."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, p)).alias("p")) for i, p in enumerate(palette)])
    ranked = F.transform(entries, lambda e: F.struct(F.round(sum_squared_error(F.col(value), e["p"]), 9).alias("d"), e["i"].alias("i")))
    return points.withColumn("nearest", F.array_min(ranked)["i"].cast("long"))


def least_squares(df: DataFrame, y: str, xs: list[str], keys: list[str], pivot: float = 1e-12) -> DataFrame:
    """Coefficients without intercept for each key, from sums of products.

    The sums merge like any aggregate, so no rows meet anywhere. A pivot below the
    threshold counts as 1. Three variables and more are solved by Cholesky's
    decomposition, one row of sums for each key.
    """
    if not xs:
        raise ValueError("no variables")
    c = lambda n: F.col(n).cast("double")
    sums = {f"s_{a}_{b}": F.sum(c(a) * c(b)) for i, a in enumerate(xs) for b in [*xs[i:], y]}
    out = df.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    safe = lambda v: F.when(F.abs(v) < pivot, 1.0).otherwise(v)
    if len(xs) > 2:
        n = len(xs)

        @F.pandas_udf("array<double>")
        def solved(rows: pd.Series) -> pd.Series:
            def one(sums: np.ndarray) -> list[float] | None:
                s = np.asarray(sums, float)
                if not np.isfinite(s).all():
                    return None
                m, v, at = np.zeros((n, n)), np.zeros(n), 0
                for i in range(n):
                    m[i, i:], v[i] = s[at : at + n - i], s[at + n - i]
                    at += n - i + 1
                low = np.zeros((n, n))
                for i in range(n):
                    p = m[i, i] - low[i, :i] @ low[i, :i]
                    low[i, i] = np.sqrt(p if p >= pivot else 1.0)
                    low[i + 1 :, i] = (m[i, i + 1 :] - low[i + 1 :, :i] @ low[i, :i]) / low[i, i]
                for i in range(n):
                    v[i] = (v[i] - low[i, :i] @ v[:i]) / low[i, i]
                for i in reversed(range(n)):
                    v[i] = (v[i] - low[i + 1 :, i] @ v[i + 1 :]) / low[i, i]
                return v.tolist()

            return rows.map(one)

        out = out.select(*keys, solved(F.array(*[F.coalesce(F.col(k), F.lit(float("nan"))) for k in sums])).alias("__c"))
        return out.select(*keys, *[F.get("__c", F.lit(i)).alias(f"c_{x}") for i, x in enumerate(xs)])
    a = xs[0]
    if len(xs) == 1:
        return out.select(*keys, (F.col(f"s_{a}_{y}") / safe(F.col(f"s_{a}_{a}"))).alias(f"c_{a}"))
    b = xs[1]
    aa, ab, bb, ay, by = (F.col(f"s_{p}_{q}") for p, q in ((a, a), (a, b), (b, b), (a, y), (b, y)))
    det = safe(aa * bb - ab * ab)
    return out.select(*keys, ((ay * bb - by * ab) / det).alias(f"c_{a}"), ((by * aa - ay * ab) / det).alias(f"c_{b}"))


def _merged_moments(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two sets together."""
    (n, mean, c), (m, other, d) = a, b
    if not n or not m:
        return b if not n else a
    off = other - mean
    return n + m, mean + off * (m / (n + m)), c + d + (off[:, None] * off) * (n * m / (n + m))


def covariance(df: DataFrame, value: str, width: int) -> DataFrame:
    """i, j, cov of an array column's components, i <= j.

    A task makes one matrix of its vectors, batch by batch; matrices are put together
    in two steps. Vectors that are null, of another width or hold a null are left out;
    without any there are no rows.
    """
    schema = "n long, mean array<double>, c array<double>"

    def packed(n, mean, c) -> pa.Table:
        floats = pa.list_(pa.float64())
        return pa.table({"n": pa.array([n], pa.int64()), "mean": pa.array([mean.tolist()], floats), "c": pa.array([c.ravel().tolist()], floats)})

    def none() -> tuple:
        return 0, np.zeros(width), np.zeros((width, width))

    def moments(batches):
        total = none()
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(x):
                mean = x.mean(0)
                total = _merged_moments(total, (len(x), mean, (x - mean).T @ (x - mean)))
        if total[0]:
            yield from packed(*total).to_batches()

    def together(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = none()
        for r in table.to_pylist():
            total = _merged_moments(total, (r["n"], np.array(r["mean"]), np.array(r["c"]).reshape(width, width)))
        return packed(*total)

    whole = df.select(F.col(value).cast("array<double>").alias("x")).where((F.size("x") == width) & F.forall("x", lambda v: v.isNotNull()))
    parts = whole.mapInArrow(moments, schema)
    some = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(256))).applyInArrow(together, schema)
    all_ = some.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(together, schema)  # 256 rows at most
    cells = all_.select("n", F.posexplode("c").alias("at", "s")).select(F.floor(F.col("at") / width).cast("int").alias("i"), (F.col("at") % width).alias("j"), (F.col("s") / F.col("n")).alias("cov"))
    return cells.where("i <= j")


def principal_components(df: DataFrame, value: str, width: int) -> tuple[list[float], list[list[float]]]:
    """Eigenvalues, largest first, and their vectors; only the width * width covariance matrix comes to the driver."""
    m = np.zeros((width, width))
    for r in covariance(df, value, width).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["cov"]
    values, vectors = np.linalg.eigh(m)
    return values[::-1].tolist(), vectors[:, ::-1].T.tolist()


def tremolo_gain(n: Column, rate: int, freq: float, depth: float) -> Column:
    """Gain of a sample by its number: a table of round(rate / freq + 0.5) places (halves to even) over and over."""
    size, off = round(rate / freq + 0.5), 1 - depth / 2
    turn = (F.lit(freq) * (n % size) / rate + 0.25) % 1
    return F.sin(2 * F.pi() * turn) * (1 - abs(off)) + off


def wave_table(i: Column, size: int, low: float, high: float, phase: float = 0.0, kind: str = "sin", whole: bool = False) -> Column:
    """Place i of a table of one turn of a sine or triangle, scaled to [low, high]; whole numbers round half away from zero."""
    import math

    point = (i + int(phase / math.pi / 2 * size + 0.5)) % size
    turn = point / size
    quarter = F.floor(4 * turn)
    tri = F.when(quarter == 0, 2 * turn + 0.5).when(quarter == 3, 2 * turn - 1.5).otherwise(1.5 - 2 * turn)
    d = ((F.sin(turn * 2 * F.pi()) + 1) / 2 if kind == "sin" else tri) * (high - low) + low
    return F.when(d < 0, F.ceil(d - 0.5)).otherwise(F.floor(d + 0.5)).cast("long") if whole else d


def qp_table(base: Column, deltas: Column, width: int, height: int) -> Column:
    """A value for each block of 16 by 16: base and the block's delta; base alone if there are no deltas, null if their number is not that of the blocks."""
    blocks = -(-width // 16) * -(-height // 16)
    return F.when(F.size(deltas) == 0, F.array_repeat(base, blocks)).when(F.size(deltas) == blocks, F.transform(deltas, lambda d: base + d))


def palette_box(n: Column, size: int) -> Column:
    """Left, top of the n-th palette entry's box in a grid of 16 by 16 boxes of so many points."""
    return F.struct((n % 16 * size).alias("x"), (F.floor(n / 16) * size).cast("long").alias("y"))


def bounding_box(a: Column, width: int, least: float) -> Column:
    """x1, y1, x2, y2 of the values above least in a plane; null if none."""
    places = F.filter(F.transform(a, lambda x, i: F.when(x > least, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(places, lambda i: i % width), F.transform(places, lambda i: F.floor(i / width).cast("int"))
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def ssim(a: Column, b: Column, peak: float) -> Column:
    """Structural similarity of two blocks: of their means, spreads and covariance."""
    n = F.size(a)
    ma, mb = total(F.transform(a, lambda x: x.cast("double"))) / n, total(F.transform(b, lambda x: x.cast("double"))) / n
    va, vb, cov = sum_products(a, a) / n - ma * ma, sum_products(b, b) / n - mb * mb, sum_products(a, b) / n - ma * mb
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


sum_products = scalar_product


def similarity_db(s: Column) -> Column:
    """A similarity up to 1 in decibels; null for 1."""
    return F.when(s < 1, -10 * F.log10(1 - s))


def denoised(values: Column, mid: int, each: float, together: float, weights: list[float] | None = None) -> Column:
    """The value at mid of an array of neighbours in time, averaged with those on either side up to the first that differs by more than `each`, or with whose difference all so far exceed `together`."""
    n = F.size(values)
    here = F.get(values, F.lit(mid))
    weight = lambda k: F.get(F.array(*map(F.lit, weights)), k) if weights else F.lit(1.0)

    def side(places: Column) -> Column:
        start = F.struct(F.lit(True).alias("on"), F.lit(0.0).alias("diff"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("w"))

        def step(t: Column, i: Column) -> Column:
            d = F.abs(F.get(values, i) - here)
            on = t["on"] & (d <= each) & (t["diff"] + d <= together)
            w = weight(i)
            return F.struct(on.alias("on"), (t["diff"] + d).alias("diff"), (t["sum"] + F.when(on, F.get(values, i) * w).otherwise(0.0)).alias("sum"), (t["w"] + F.when(on, w).otherwise(0.0)).alias("w"))

        return F.aggregate(places, start, step)

    before = side(F.sequence(F.lit(mid - 1), F.lit(0)) if mid else F.array().cast("array<int>"))
    behind = side(F.when(n > mid + 1, F.sequence(F.lit(mid + 1), n - 1)).otherwise(F.array().cast("array<int>")))
    w = weight(F.lit(mid))
    return (here * w + before["sum"] + behind["sum"]) / (w + before["w"] + behind["w"])


def field_order(top: Column, bottom: Column, still: Column, interlaced: float = 1.04, progressive: float = 1.5) -> Column:
    """tff, bff, progressive or undetermined from how much a frame differs between its fields' neighbours: top first, bottom first, and inside itself."""
    return F.when(top > interlaced * bottom, "tff").when(bottom > interlaced * top, "bff").when(still > progressive * F.greatest(top, bottom), "progressive").otherwise("undetermined")


def scaled_size(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Width and height to scale to. -n keeps the proportion, to a multiple of n; 0 keeps the side; both negative keep both."""
    side = lambda want, own: own if want == 0 else F.lit(want)
    by = lambda own, other, want_other, n: (F.round(other * own.cast("double") / want_other / n) * n).cast("long")
    if to_width < 0 and to_height < 0:
        return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))
    if to_width < 0:
        return F.struct(by(width, side(to_height, height), height, -to_width).alias("width"), side(to_height, height).cast("long").alias("height"))
    if to_height < 0:
        return F.struct(side(to_width, width).cast("long").alias("width"), by(height, side(to_width, width), width, -to_height).alias("height"))
    return F.struct(side(to_width, width).cast("long").alias("width"), side(to_height, height).cast("long").alias("height"))


def volume(value: Column, decibels: Column, replay_gain: Column | None = None, peak: Column | None = None) -> Column:
    """A sample louder by decibels and a replay gain, which is held back so that the peak stays at 1."""
    gain = F.pow(F.lit(10.0), (decibels + (F.coalesce(replay_gain, F.lit(0.0)) if replay_gain is not None else 0.0)) / 20)
    return value * (F.least(gain, 1 / F.nullif(peak, F.lit(0.0))) if peak is not None else gain)


def uniform_noise(id_: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's id and the seed alone, so it is the same however rows are dealt."""
    return F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) / float(1 << 53)


def gaussian_noise(id_: Column, seed: int) -> Column:
    """Likewise with mean 0 and spread 1."""
    return F.sqrt(-2 * F.log(1 - uniform_noise(id_, seed))) * F.cos(2 * F.pi() * uniform_noise(id_, seed + 1))


def swapped_planes(df: DataFrame, u: str, v: str) -> DataFrame:
    """df with two of its columns changed over."""
    return df.select(*[F.col({u: v, v: u}.get(c, c)).alias(c) for c in df.columns])


def lut_1d(value: Column, table: list[float]) -> Column:
    """A value from 0 to 1 through a table, straight between its entries."""
    t = F.array(*map(F.lit, table))
    x = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * (len(table) - 1)
    low = F.floor(x).cast("int")
    a = F.get(t, low)
    return a + (F.coalesce(F.get(t, low + 1), a) - a) * (x - low)
