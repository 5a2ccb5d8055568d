"""Operators on timed streams: selecting, re-timing, joining on time, detecting.

A stream is the rows of one value of `keys`, ordered by `ts` and then by `ties`,
which must tell rows apart. Built on lumenflow.operators.ordering, so that a busy
stream is spread over its time buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering as O


@dataclass(frozen=True)
class Stream:
    """Which columns make streams of a table."""

    keys: tuple[str, ...]
    ts: str = "ts"
    ties: tuple[str, ...] = ("event_id",)
    unit: str = O.AUTO

    def _args(self) -> tuple[list[str], str, list[str]]:
        return [*self.keys], self.ts, [*self.ties]

    def fitted(self, df: DataFrame, most: int = O.BUCKET_ROWS) -> Stream:
        """The stream with the unit of time that keeps its fullest bucket at `most` rows or fewer."""
        return replace(self, unit=O.fitted_unit(df, [*self.keys], self.ts, most))

    def numbered(self, df: DataFrame, name: str = "n") -> DataFrame:
        return O.numbered(df, *self._args(), name, self.unit)

    def previous(self, df: DataFrame, **cols: str) -> DataFrame:
        """previous(df, new="old"): the row before's `old` as `new`."""
        return O.with_previous(df, *self._args(), {old: new for new, old in cols.items()}, self.unit)

    def next(self, df: DataFrame, **cols: str) -> DataFrame:
        return O.with_next(df, *self._args(), {old: new for new, old in cols.items()}, self.unit)

    def running(self, df: DataFrame, value: Column, name: str, how: str = "sum") -> DataFrame:
        return O.running(df, *self._args(), value, name, how, self.unit)

    def annotated(self, df: DataFrame, **asked) -> DataFrame:
        """Sums, rows before and rows behind in one pass; see ordering.annotated."""
        return O.annotated(df, *self._args(), **asked, unit=self.unit)

    def islands(self, df: DataFrame, cols: list[str], same: Callable[[Column, Column], Column], name: str = "island") -> DataFrame:
        return O.islands(df, *self._args(), cols, same, name, self.unit)


def every_nth(df: DataFrame, s: Stream, step: int) -> DataFrame:
    return s.numbered(df, "__n").where(F.col("__n") % step == 0).drop("__n")


def trim_index(df: DataFrame, s: Stream, start: int, end: int) -> DataFrame:
    """Rows start <= n < end of each stream."""
    return s.numbered(df, "__n").where(F.col("__n").between(start, end - 1)).drop("__n")


def trim_time(df: DataFrame, s: Stream, start: str, end: str) -> DataFrame:
    """Rows start <= ts < end: a plain predicate, which reaches the scan."""
    kind = df.schema[s.ts].dataType
    return df.where((F.col(s.ts) >= F.lit(start).cast(kind)) & (F.col(s.ts) < F.lit(end).cast(kind)))


def retimed(df: DataFrame, s: Stream, scale: float, name: str = "pts") -> DataFrame:
    """A new time for each row: its number by scale, truncated toward zero."""
    return s.numbered(df, "__n").withColumn(name, (F.col("__n") * F.lit(scale)).cast("long")).drop("__n")


def rate_report(df: DataFrame, s: Stream, pts: str) -> DataFrame:
    """Whether a stream's rate is constant: cfr and vfr steps, least and largest step, mean changed step (integer, toward zero)."""
    steps = s.annotated(df, before={"__p": (pts, 1), "__pp": (pts, 2)}).where("__p IS NOT NULL").withColumns({"__d": F.col(pts) - F.col("__p"), "__pd": F.col("__p") - F.col("__pp")})
    changed = F.col("__pd").isNotNull() & (F.col("__d") != F.col("__pd"))
    agg = steps.groupBy(*s.keys).agg(F.count_if(changed).alias("vfr"), F.count_if(~changed).alias("cfr"), F.min("__d").alias("min_delta"), F.max("__d").alias("max_delta"), F.sum(F.when(changed, F.col("__d"))).alias("__sum"))
    return agg.withColumn("avg_delta", F.expr("__sum div nullif(vfr, 0)")).drop("__sum")


def chunked(df: DataFrame, s: Stream, size: int, name: str = "chunk") -> DataFrame:
    """Tumbling windows of `size` rows; the last may be short."""
    return s.numbered(df, "__n").withColumn(name, F.expr(f"__n div {size}")).drop("__n")


def tiled(df: DataFrame, s: Stream, size: int, value: str) -> DataFrame:
    """Rows of `size` values in order."""
    c = s.numbered(df, "__n").withColumn("tile", F.expr(f"__n div {size}"))
    return c.groupBy(*s.keys, "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", value))), lambda x: x[value]).alias("tiles"))


def untiled(df: DataFrame, keys: list[str], tiles: str, value: str) -> DataFrame:
    return df.select(*keys, "tile", F.posexplode(tiles).alias("pos", value))


def shuffled_frames(df: DataFrame, s: Stream, order: list[int], name: str = "n") -> DataFrame:
    """Each block of len(order) rows permuted: output k is input order[k]; -1 drops; a short last block is dropped."""
    k = len(order)
    rows = s.numbered(df, "__n").withColumns({"__b": F.expr(f"__n div {k}"), "__o": F.col("__n") % k})
    size = rows.groupBy(*s.keys).agg(F.max("__n").alias("__top"))
    rows = rows.join(size, [*s.keys])
    places = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(order)]), lambda x: x["o"] == F.col("__o"))
    kept = sum(o >= 0 for o in order)
    rank = {i: sum(o >= 0 for o in order[:i]) for i in range(k)}
    ranks = F.create_map(*[F.lit(x) for i, r in rank.items() for x in (i, r)])
    out = rows.where((F.col("__b") + 1) * k <= F.col("__top") + 1).withColumn("__x", F.explode(places))
    return out.withColumn(name, (F.col("__b") * kept + ranks[F.col("__x")["i"]]).cast("long")).drop("__n", "__b", "__o", "__x", "__top")


def looped(df: DataFrame, s: Stream, start: int, size: int, times: int, name: str = "n") -> DataFrame:
    """Rows start..start+size-1 come times more; rows are numbered anew."""
    rows = s.numbered(df, "__n")
    inside = F.col("__n").between(start, start + size - 1)
    turns = F.when(inside, F.sequence(F.lit(0), F.lit(times))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("__turn", F.explode(turns))
    n = F.when(inside, F.col("__n") + F.col("__turn") * size).when(F.col("__n") >= start + size, F.col("__n") + times * size).otherwise(F.col("__n"))
    return out.withColumn(name, n.cast("long")).drop("__n", "__turn")


def padded(df: DataFrame, s: Stream, count: int, name: str = "n") -> DataFrame:
    """The stream's first row comes `count` times more at its head."""
    rows = s.numbered(df, "__n")
    head = F.when(F.col("__n") == 0, F.sequence(F.lit(0), F.lit(count))).otherwise(F.array(F.lit(count)))
    return rows.withColumn("__k", F.explode(head)).withColumn(name, (F.col("__n") + F.col("__k")).cast("long")).drop("__n", "__k")


def concatenated(df: DataFrame, segment: str, pts: str, name: str = "out_pts") -> DataFrame:
    """Segments one behind the other in order of their names: each begins where the longest time of those before ends."""
    spans = df.groupBy(segment).agg(F.min(pts).alias("__from"), (F.max(pts) - F.min(pts)).alias("__len"))
    before = Window.orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)  # one row for each segment
    spans = spans.withColumn("__off", F.coalesce(F.sum("__len").over(before), F.lit(0)))
    return df.join(spans, segment).withColumn(name, F.col(pts) - F.col("__from") + F.col("__off")).drop("__from", "__len", "__off")


def stacked(a: DataFrame, b: DataFrame, s: Stream, value: str) -> DataFrame:
    """Two streams side by side by number, ending with the shorter."""
    x = s.numbered(a, "n").select("n", F.col(value).alias("first"))
    return x.join(s.numbered(b, "n").select("n", F.col(value).alias("second")), "n")


def asof(main: DataFrame, other: DataFrame, s: Stream, value: str, name: str) -> DataFrame:
    """main with the value of other's last row at or before each of its rows, in the same stream."""
    side = other.select(*s.keys, s.ts, *[F.lit(None).cast(main.schema[t].dataType).alias(t) for t in s.ties], F.lit(0).alias("__main"), F.struct(F.col(value).alias("v")).alias("__v"))
    rows = main.withColumns({"__main": F.lit(1), "__v": F.lit(None).cast(side.schema["__v"].dataType)}).unionByName(side, allowMissingColumns=True)
    out = O.carried(rows, [*s.keys], s.ts, ["__main", *s.ties], "__v", "__last", s.unit)
    return out.where("__main = 1").withColumn(name, F.col("__last")["v"]).drop("__main", "__v", "__last")


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def grid(df: DataFrame, s: Stream, step: str) -> DataFrame:
    """Regular times for each stream, from its first whole step's unit to its last row; laid out a thousand at a time."""
    count, unit = step.split()
    unit = unit.rstrip("s")
    seconds = int(count) * _SECONDS[unit]
    ends = df.groupBy(*s.keys).agg(F.date_trunc(unit, F.min(s.ts)).cast(df.schema[s.ts].dataType).alias("__a"), F.max(s.ts).alias("__b")).where("__a IS NOT NULL")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    blocks = ends.withColumn("__n", F.floor((us("__b") - us("__a")) / (seconds * 1_000_000))).select(*s.keys, "__a", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"), F.lit(1000).cast("long"))).alias("__k"))
    at = blocks.select(*s.keys, "__a", F.explode(F.sequence("__k", F.least(F.col("__k") + 999, F.col("__n")))).alias("__k"))
    return at.select(*s.keys, F.timestamp_add("SECOND", (F.col("__k") * seconds).cast("int"), F.col("__a")).alias(s.ts))


def resampled(df: DataFrame, s: Stream, step: str, value: str, cut: float | None = None) -> DataFrame:
    """Each grid time with the stream's last value (held) and the value interpolated to the next row.

    cut: where the next value differs by more than this, as across a change of scene,
    nothing is blended: the nearer one counts, the next at half way.
    """
    ahead = s.next(df, __nts=s.ts, __nv=value).select(*s.keys, s.ts, *s.ties, F.struct(F.col(s.ts).alias("t"), F.col(value).alias("v"), F.col("__nts").alias("nt"), F.col("__nv").alias("nv")).alias("__x"))
    g = grid(df, s, step).withColumns({t: F.lit(None).cast(df.schema[t].dataType) for t in s.ties})
    out = asof(g, ahead, s, "__x", "x")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    share = (us(F.col(s.ts)) - us(F.col("x.t"))) / F.nullif(us(F.col("x.nt")) - us(F.col("x.t")), F.lit(0))
    blend = F.col("x.v") + (F.col("x.nv") - F.col("x.v")) * share
    if cut is not None:
        blend = F.when(F.abs(F.col("x.nv") - F.col("x.v")) > cut, F.when(share >= 0.5, F.col("x.nv")).otherwise(F.col("x.v"))).otherwise(blend)
    return out.select(*s.keys, s.ts, F.col("x.v").alias("held"), F.coalesce(blend, F.col("x.v")).alias("interpolated"))


def scene_scores(df: DataFrame, s: Stream, value: str) -> DataFrame:
    """mafd: change from the row before; score: the lesser of it and its own change."""
    a = s.annotated(df, before={"__p": (value, 1), "__pp": (value, 2)}).withColumns({"mafd": F.abs(F.col(value) - F.col("__p")), "__pm": F.abs(F.col("__p") - F.col("__pp"))})
    return a.withColumn("score", F.when(F.col("__pm").isNotNull(), F.least("mafd", F.abs(F.col("mafd") - F.col("__pm"))))).drop("__p", "__pp", "__pm")


def _runs(rows: DataFrame, s: Stream) -> DataFrame:
    return rows.groupBy(*s.keys, "island").agg(F.min(s.ts).alias("start"), F.max(s.ts).alias("end"), F.count(F.lit(1)).alias("rows"))


def runs_where(df: DataFrame, s: Stream, flag: Column, least: int) -> DataFrame:
    """Maximal runs of at least `least` rows whose flag holds: start, end and number of rows."""
    rows = s.islands(df.withColumn("__f", F.coalesce(flag, F.lit(False))), ["__f"], lambda a, b: a["__f"] & b["__f"])
    return _runs(rows.where("__f"), s).where(F.col("rows") >= least).drop("island")


def frozen(df: DataFrame, s: Stream, value: str, tolerance: float, least: int) -> DataFrame:
    """Maximal runs of rows that each differ from the row before by tolerance or less."""
    rows = s.islands(df, [value], lambda a, b: F.abs(b[value] - a[value]) <= tolerance)
    return _runs(rows, s).where(F.col("rows") >= least).drop("island")


def sessions(df: DataFrame, s: Stream, gap_seconds: int) -> DataFrame:
    """Runs of rows without a gap above gap_seconds between neighbours."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = s.islands(df, [s.ts], lambda a, b: us(b[s.ts]) - us(a[s.ts]) <= gap_seconds * 1_000_000)
    return _runs(rows, s).withColumnRenamed("island", "session")


def run_lengths(df: DataFrame, s: Stream, value: str) -> DataFrame:
    """Run-length coding of a column; nulls are equal to each other."""
    rows = s.islands(df, [value], lambda a, b: a[value].eqNullSafe(b[value]))
    return rows.groupBy(*s.keys, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length")).withColumnRenamed("island", "run")


def representatives(df: DataFrame, s: Stream, size: int, value: str, id_: str) -> DataFrame:
    """Of each chunk of rows the one whose value is nearest to the chunk's mean; the smallest id of equals."""
    c = chunked(df, s, size)
    mean = c.groupBy(*s.keys, "chunk").agg(F.avg(value).alias("__m"))
    near = F.struct(F.round(F.abs(F.col(value) - F.col("__m")), 9).alias("d"), F.col(id_).alias("i"))
    return c.join(mean, [*s.keys, "chunk"]).groupBy(*s.keys, "chunk").agg(F.min(near).alias("__b")).select(*s.keys, "chunk", F.col("__b.i").alias(id_))


def decimated(df: DataFrame, s: Stream, value: str, id_: str, threshold: float) -> DataFrame:
    """Ids of rows that differ from the last kept row by more than threshold; rows without a value are never kept."""
    from .signals import decimated as kept

    return kept(df.select(*s.keys, s.ts, *s.ties, value), s, value, threshold).select(id_)


def clock_filtered(df: DataFrame, s: Stream, pts: str, id_: str, period: float, feedback2: float, feedback3: float) -> DataFrame:
    """Ids and smoothed times of a delay-locked loop over noisy times."""
    from .signals import clock_filtered as smoothed

    return smoothed(df.select(*s.keys, s.ts, *s.ties, pts), s, pts, period, feedback2, feedback3).select(id_, "smoothed")


#: Types in a history, and how many of them that agree change a stream's type.
HISTORY, AGREE = 4, 3


def settled(df: DataFrame, s: Stream, kind: str, unknown: str, name: str = "settled") -> DataFrame:
    """df with the type that a stream has settled on: a column of types, of which single ones may be wrong, made steady by their history.

    A row's history is its own type and the three before; unknown ones don't count, and
    if the others differ there is none. The stream takes on the type of the first
    history there is; after that it changes only where three or more agree. So the type
    is that of the last such row, or of the first history before there is one: both
    are carried from bucket to bucket.
    """
    rows = s.annotated(df, before={f"__h{k}": (kind, k) for k in range(1, HISTORY)})
    known = F.filter(F.array(kind, *[f"__h{k}" for k in range(1, HISTORY)]), lambda x: x.isNotNull() & (x != unknown))
    best = F.when(F.size(F.array_distinct(known)) == 1, F.get(known, F.lit(0)))
    rows = rows.withColumns({"__best": best, "__strong": F.when(F.size(known) >= AGREE, best)}).drop(*[f"__h{k}" for k in range(1, HISTORY)])
    place = F.struct(F.col(s.ts).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(s.ties)], F.col("__best").alias("best"))
    rows = s.running(rows, F.when(F.col("__best").isNotNull(), place), "__first", "min")
    out = O.carried(rows, [*s.keys], s.ts, [*s.ties], "__strong", "__last", s.unit)
    return out.withColumn(name, F.coalesce(F.col("__last"), F.col("__first")["best"], F.lit(unknown))).drop("__best", "__strong", "__first", "__last")
