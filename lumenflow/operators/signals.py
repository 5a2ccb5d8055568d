"""Operators on sampled streams: filters, loudness, resampling, dynamics and mixing.

A stream's rows in order are its samples. Filters and envelopes are recursions
(lumenflow.operators.scans); windows over samples are tiles with rims
(lumenflow.operators.tiles). No stream is in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Affine, Columns, Envelope, Kept, chained
from .streams import Stream
from .tiles import Axis, dealt, line, owned, sliding_extreme

Section = tuple[float, float, float, float, float]  # b0, b1, b2, a1, a2


def loudness_sections(rate: float = 48_000.0) -> list[Section]:
    """The two sections of the K-weighting of ITU-R BS.1770: a high shelf and a high pass, for a sampling rate."""
    # Centre frequencies, qualities and gain of the standard's filters.
    f0, q, gain = 1681.974450955533, 0.7071752369554196, 3.999843853973347
    k, high = math.tan(math.pi * f0 / rate), 10 ** (gain / 20)
    band, a0 = high**0.4996667741545416, 1 + k / q + k * k
    shelf = ((high + band * k / q + k * k) / a0, 2 * (k * k - high) / a0, (high - band * k / q + k * k) / a0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (1.0, -2.0, 1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)]


def _sections_map(sections: Sequence[Section]) -> tuple[np.ndarray, np.ndarray]:
    """Second-order sections one behind the other as one affine step: two states for each section, and the output."""
    d = 2 * len(sections) + 1
    a, b = np.zeros((d, d)), np.zeros(d)
    u, ux = np.zeros(d), 1.0  # the section's input, in terms of states and of the sample
    for i, (b0, b1, b2, a1, a2) in enumerate(sections):
        y, yx = b0 * u, b0 * ux
        y[2 * i] += 1
        a[2 * i], b[2 * i] = b1 * u - a1 * y, b1 * ux - a1 * yx
        a[2 * i, 2 * i + 1] += 1
        a[2 * i + 1], b[2 * i + 1] = b2 * u - a2 * y, b2 * ux - a2 * yx
        u, ux = y, yx
    a[-1], b[-1] = u, ux
    return a, b


def section_filtered(df: DataFrame, s: Stream, value: str, sections: Sequence[Section], name: str = "filtered") -> DataFrame:
    """df with the samples behind recursive filters of the second order; a null sample counts as 0."""
    a, b = _sections_map(sections)

    def maps(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        return a, np.nan_to_num(cols[value])[:, None] * b

    return chained(df, s, Affine([0.0] * len(b), maps, {name: len(b) - 1}), [value])


def clock_filtered(df: DataFrame, s: Stream, pts: str, period: float, feedback2: float, feedback3: float, name: str = "smoothed") -> DataFrame:
    """A delay-locked loop over noisy times: the smoothed time of each row.

    A row's gain is known from its number, so the loop is an affine recursion over
    the cycle's time and its length; the first row sets the time.
    """

    def maps(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        t, n = cols[pts], cols["__n1"]
        gain = np.maximum(feedback2, 1 / n)
        a, b = np.empty((len(t), 2, 2)), np.empty((len(t), 2))
        a[:, 0, 0] = a[:, 0, 1] = 1 - gain
        a[:, 1, 0], a[:, 1, 1] = -feedback3, 1 - feedback3
        b[:, 0], b[:, 1] = gain * t, feedback3 * t
        first = n == 1
        a[first], b[first, 0], b[first, 1] = 0, t[first], period
        return a, b

    rows = s.running(df, F.lit(1).cast("long"), "__n1")
    return chained(rows, s, Affine([0.0, period], maps, {name: 0}), [pts, "__n1"]).drop("__n1")


def decimated(df: DataFrame, s: Stream, value: str, threshold: float) -> DataFrame:
    """Rows that differ from their stream's last kept row by more than threshold; the first with a value is kept, and rows without one never are."""
    return chained(df, s, Kept(value, threshold, {"__kept": 1}), [value]).where("__kept = 1").drop("__kept")


# --- loudness ---------------------------------------------------------------

#: Fixed values of the standard: what full scale is offset by, and the two gates (absolute; below the mean of what passes it, for programme and range).
OFFSET, SILENT, BELOW, BELOW_RANGE = -0.691, -70.0, -10.0, -20.0
MOMENTARY, SHORT = 4, 30  # in hops of a tenth of a second


def _level(energy: Column) -> Column:
    return F.lit(OFFSET) + 10 * F.log10(energy)


def loudness_windows(df: DataFrame, s: Stream, value: str, hop_rows: int, rate: float = 48_000.0) -> DataFrame:
    """keys, hop, peak, momentary and short: for each whole hop the largest sample, and the mean square of the K-weighted samples of the last 4 hops (400 ms) and 30 hops (3 s), null where there aren't so many yet."""
    rows = s.numbered(section_filtered(df, s, value, loudness_sections(rate), "__z"), "__n").withColumn("hop", F.expr(f"__n div {hop_rows}"))
    hops = rows.groupBy(*s.keys, "hop").agg(F.count(F.lit(1)).alias("__rows"), F.sum(F.col("__z") * F.col("__z")).alias("__e"), F.max(F.abs(value)).alias("peak")).where(F.col("__rows") == hop_rows)
    axis = Axis("hop", 65_536, SHORT - 1, 0)
    w = line(s.keys, [axis], "hop")
    over = lambda k: F.when(F.col("hop") >= k - 1, F.sum("__e").over(w.rowsBetween(1 - k, 0)) / (k * hop_rows))
    hops = dealt(hops, s.keys, [axis]).withColumns({"momentary": over(MOMENTARY), "short": over(SHORT)})
    return owned(hops, [axis]).drop("__rows", "__e")


def _with_values(rows: DataFrame, table: DataFrame, keys: Sequence[str], salt: Column, salts: int = 64) -> DataFrame:
    """rows with the columns of a table of one row for each stream; a stream's rows meet copies of its row in `salts` groups, so a long stream isn't one task."""
    spread = table.withColumnsRenamed({k: f"__k_{k}" for k in keys}).withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return rows.withColumn("__salt", F.pmod(salt, F.lit(salts))).join(spread, same & (F.col("__salt") == F.col("__s"))).drop("__salt", "__s", *[f"__k_{k}" for k in keys])


def gated(windows: DataFrame, keys: Sequence[str], energy: str, below: float) -> DataFrame:
    """The windows that pass both gates: louder than silence, and louder than the mean of those that are, less `below`."""
    loud = windows.where(F.col(energy).isNotNull() & (_level(F.col(energy)) > SILENT))
    mean = loud.groupBy(*keys).agg(F.avg(energy).alias("__mean"))
    return _with_values(loud, mean, keys, F.col("hop")).where(_level(F.col(energy)) > _level(F.col("__mean")) + below).drop("__mean")


def loudness(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, peak, integrated (gated loudness of the programme) and windows that count for it, of loudness_windows's rows; a stream without any has nulls."""
    blocks = gated(windows, keys, "momentary", BELOW).groupBy(*keys).agg(_level(F.avg("momentary")).alias("integrated"), F.count(F.lit(1)).alias("windows"))
    every = windows.groupBy(*keys).agg(F.max("peak").alias("peak"))
    blocks = blocks.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return every.join(blocks, same, "left").drop(*[f"__k_{k}" for k in keys])


# --- resampling -------------------------------------------------------------


def sinc_taps(up: int, down: int, width: int) -> list[list[float]]:
    """For each of `up` phases the 2 * width weights of a Hann-windowed sinc around it."""
    cut = min(1.0, up / down)
    out = []
    for phase in range(up):
        taps = []
        for j in range(2 * width):
            t = phase / up - (j - width + 1)
            taps.append(cut * float(np.sinc(cut * t)) * math.cos(math.pi * t / (2 * width)) ** 2)
        out.append(taps)
    return out


def rate_changed(df: DataFrame, s: Stream, value: str, up: int, down: int, width: int = 8, name: str = "sample", tile: int = 16_384) -> DataFrame:
    """keys, m and the stream's sample at each up/down-th of a step: m * down / up steps from its beginning, by a windowed sinc over 2 * width samples.

    Samples beyond a stream's ends, and nulls, count as 0. Weights for all phases are
    constants of the plan; each tile holds the samples that its outputs reach to.
    """
    axis = Axis("__n", tile, width - 1, width)
    rows = s.numbered(df, "__n").select(*s.keys, "__n", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"))
    w = line(s.keys, [axis], "__n").rowsBetween(1 - width, width)
    rows = dealt(rows, s.keys, [axis]).withColumn("__near", F.collect_list(F.struct("__n", "__v")).over(w))
    n = F.col("__n")
    first = F.ceil(n * up / F.lit(float(down))).cast("long")
    # The outputs between this sample and the next: m * down // up is this sample's number.
    m = F.filter(F.sequence(first - 1, F.ceil((n + 1) * up / F.lit(float(down))).cast("long") + 1), lambda m: (m >= 0) & (F.floor(m * down / F.lit(float(up))) == n))
    taps = F.array(*[F.array(*[F.lit(t) for t in phase]) for phase in sinc_taps(up, down, width)])
    out = owned(rows, [axis]).select(*s.keys, n, "__near", F.explode(m).alias("m")).withColumn("__taps", F.get(taps, ((F.col("m") * down) % up).cast("int")))
    total = F.aggregate("__near", F.lit(0.0), lambda acc, x: acc + x["__v"] * F.get(F.col("__taps"), (x["__n"] - F.col("__n") + width - 1).cast("int")))
    return out.select(*s.keys, "m", total.alias(name))


# --- dynamics ---------------------------------------------------------------


def _decibel(c: Column) -> Column:
    return 20 * F.log10(c)


def transfer(level: Column, points: Sequence[tuple[float, float]]) -> Column:
    """A line through points (in, out), going on beyond them with the slope of its end; the points are constants."""
    pts = sorted(points)
    seg = lambda a, b: F.lit(a[1]) + (level - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))
    out = F.when(level < pts[1][0], seg(pts[0], pts[1]))
    for a, b in zip(pts[1:-1], pts[2:], strict=True):
        out = out.when(level < b[0], seg(a, b))
    return out.otherwise(seg(pts[-2], pts[-1]))


def companded(df: DataFrame, s: Stream, value: str, attack: float, decay: float, points: Sequence[tuple[float, float]], name: str = "companded", envelope: str = "envelope") -> DataFrame:
    """df with a level that follows the samples (shares of the difference for each row, rising and falling), and the sample with the gain that the points (decibels in and out) give for it; null stays null, and silence stays as it is."""
    rows = chained(df, s, Envelope(value, attack, decay, {envelope: 0}), [value])
    level = _decibel(F.col(envelope))
    return rows.withColumn(name, F.when(F.col(envelope) > 0, F.col(value) * F.pow(F.lit(10.0), (transfer(level, points) - level) / 20)).otherwise(F.col(value)))


def limited(df: DataFrame, s: Stream, value: str, limit: float, ahead: int, release: float, name: str = "limited") -> DataFrame:
    """df with samples that never pass the limit: the gain falls `ahead` rows before a peak, and recovers by a share `release` of the level for each row.

    The peak's level falls by a constant factor from row to row, so its logarithm is a
    running maximum of the peaks' logarithms less a line.
    """
    rows = s.numbered(df, "__n").withColumn("__size", F.abs(value))
    rows = sliding_extreme(rows, s.keys, "__n", "__size", ahead + 1, "__peak")
    fall = -math.log(1 - release)
    rows = s.running(rows, F.ln(F.nullif(F.col("__peak"), F.lit(0.0))) + F.col("__n") * fall, "__top", "max")
    level = F.coalesce(F.exp(F.col("__top") - F.col("__n") * fall), F.lit(0.0))
    return rows.withColumn(name, F.col(value) * F.when(level > limit, limit / level).otherwise(1.0)).drop("__n", "__size", "__peak", "__top")


# --- mixing -----------------------------------------------------------------


def mixed(df: DataFrame, keys: Sequence[str], channel: str, value: str, matrix: DataFrame) -> DataFrame:
    """keys, out and value: output channels as sums of input channels by matrix(out, in, gain), of any size and layout.

    A matrix of ones and zeros is a channel map or a join of channels. Channels that
    the matrix doesn't name are dropped; one that is named and absent adds nothing, and
    so does a null. The matrix has a row for each gain, and is broadcast if Spark finds it small.
    """
    m = matrix.select(F.col("out").alias("__out"), F.col("in").alias("__in"), F.col("gain").cast("double").alias("__gain"))
    rows = df.join(m, F.col(channel).eqNullSafe(F.col("__in")))
    return rows.groupBy(*keys, F.col("__out").alias("out")).agg(F.coalesce(F.sum(F.col(value) * F.col("__gain")), F.lit(0.0)).alias("value"))


def threshold_streams(values: DataFrame, threshold: DataFrame, low: DataFrame, high: DataFrame, s: Stream, value: str, name: str = "out") -> DataFrame:
    """n and low's value where the value is at most the threshold, else high's: four streams aligned by number, ending with the shortest."""
    from .timing import stacked_all

    rows = stacked_all([values, threshold, low, high], s, value)
    at = lambda i: F.get("values", F.lit(i))
    return rows.select("n", F.when(at(0) <= at(1), at(2)).otherwise(at(3)).alias(name))
