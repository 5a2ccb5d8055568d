"""More operators on timed streams: cutting, re-timing to a fixed rate, padding, stacking, medians and exact quantiles.

A stream is as in lumenflow.operators.streams; rows without a time belong to none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .streams import Stream, asof


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def trimmed(df: DataFrame, s: Stream, start: str | None = None, end: str | None = None, start_n: int | None = None, end_n: int | None = None, duration: float | None = None) -> DataFrame:
    """Rows from where any start (a time, a number) is reached to where all ends (a time, a number, seconds after the first row kept) are.

    Without a start a stream begins with its first row, without an end it goes on
    to its last.
    """
    kind = df.schema[s.ts].dataType
    rows = s.numbered(df, "__n") if start_n is not None or end_n is not None else df.where(F.col(s.ts).isNotNull())
    at = lambda t: F.lit(t).cast(kind)
    begun = [c for c in (F.col(s.ts) >= at(start) if start is not None else None, F.col("__n") >= start_n if start_n is not None else None) if c is not None]
    rows = rows.where(reduce(lambda a, b: a | b, begun)) if begun else rows
    going = [c for c in (F.col(s.ts) < at(end) if end is not None else None, F.col("__n") < end_n if end_n is not None else None) if c is not None]
    if duration is not None:
        first = rows.groupBy(*s.keys).agg(F.min(s.ts).alias("__first")).withColumnsRenamed({k: f"__k_{k}" for k in s.keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in s.keys])
        rows = rows.join(first, same).drop(*[f"__k_{k}" for k in s.keys])
        going.append(_us(F.col(s.ts)) - _us(F.col("__first")) < int(duration * 1_000_000))
    rows = rows.where(reduce(lambda a, b: a | b, going)) if going else rows
    return rows.drop("__n", "__first")


ROUNDING = ("near", "down", "up", "zero", "inf")


def _slot(t: Column, step: int, how: str) -> Column:
    q = t / step
    away = F.when(q < 0, F.floor(q)).otherwise(F.ceil(q))
    return {"near": F.when(q < 0, F.ceil(q - 0.5)).otherwise(F.floor(q + 0.5)), "down": F.floor(q), "up": F.ceil(q), "zero": F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)), "inf": away}[how].cast("long")


def at_rate(df: DataFrame, s: Stream, seconds: int, round_: str = "near", start: str | None = None, name: str = "slot") -> DataFrame:
    """The stream at one row for each slot of so many seconds: of rows that round to one slot the last, and a row again for each slot without one behind it.

    start: the stream begins there: what comes before is dropped, but its last row
    fills the slots up to the next, or the first row does if it comes late.
    """
    step = seconds * 1_000_000
    rows = df.where(F.col(s.ts).isNotNull()).withColumn(name, _slot(_us(F.col(s.ts)), step, round_))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.groupBy(*s.keys, name).agg(F.max_by(whole, F.struct(s.ts, *s.ties)).alias("__row")).select("__row.*")
    out = s.annotated(last, before={"__prev": (name, 1)}, behind={"__next": name})
    low, high = F.col(name), F.coalesce(F.col("__next") - 1, F.col(name))
    if start is not None:
        first = _slot(_us(F.lit(start).cast(df.schema[s.ts].dataType)), step, round_)
        low = F.when(F.col("__prev").isNull() & (low > first), first).otherwise(F.greatest(low, first))
    # A long gap is laid out a thousand slots at a time, so that no row holds all of it.
    blocks = out.where(low <= high).withColumns({"__high": high, "__low": F.explode(F.sequence(low, high, F.lit(1000).cast("long")))})
    return blocks.withColumn(name, F.explode(F.sequence("__low", F.least(F.col("__low") + 999, F.col("__high"))))).drop("__prev", "__next", "__low", "__high")


def at_times(times: DataFrame, df: DataFrame, s: Stream, value: str, name: str) -> DataFrame:
    """times(keys, ts, ties) with the value of the stream's last row at or before each: a stream re-timed to a list."""
    return asof(times, df, s, value, name)


def padded_ends(df: DataFrame, s: Stream, head: int = 0, tail: int = 0, name: str = "n") -> DataFrame:
    """The first row `head` times more in front, the last `tail` times more behind; rows are numbered anew, and `copy` says which are copies."""
    rows = s.annotated(df, sums={"__n": (F.lit(1), "sum")}, behind={"__after": s.ts}).withColumn("__n", F.col("__n") - 1)
    first, last = F.col("__n") == 0, F.col("__after").isNull()
    turns = F.sequence(F.when(first, -head).otherwise(0), F.when(last, tail).otherwise(0))
    out = rows.withColumn("__k", F.explode(turns))
    return out.withColumn(name, (F.col("__n") + F.col("__k") + head).cast("long")).withColumn("copy", F.col("__k") != 0).drop("__n", "__k", "__after")


def delayed(df: DataFrame, ts: str, seconds: dict[str, int], key: str) -> DataFrame:
    """Each stream's times later by its own number of seconds; streams that aren't named stay."""
    late = reduce(lambda c, k: c.when(F.col(key) == k, seconds[k]), seconds, F.when(F.lit(False), 0)).otherwise(0)
    return df.withColumn(ts, F.timestamp_add("SECOND", late, F.col(ts)))


def segmented(df: DataFrame, ts: str, stamps: list[str], name: str = "segment") -> DataFrame:
    """df with the number of stamps at or before each row's time; the stamps are constants."""
    kind = df.schema[ts].dataType
    return df.withColumn(name, sum((F.when(F.col(ts) >= F.lit(t).cast(kind), 1).otherwise(0) for t in stamps), F.lit(0)).cast("long"))


def stacked_all(inputs: list[DataFrame], s: Stream, value: str, shortest: bool = True) -> DataFrame:
    """Any number of streams side by side by number: n and an array with a value for each input, null where a longer one goes on alone."""
    rows = reduce(DataFrame.unionByName, [s.numbered(d, "n").select("n", F.lit(i).alias("i"), F.col(value).alias("v")) for i, d in enumerate(inputs)])
    out = rows.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    out = out.where(F.size("m") == len(inputs)) if shortest else out
    return out.select("n", F.array(*[F.element_at("m", F.lit(i)) for i in range(len(inputs))]).alias("values"))


def sliding_median(df: DataFrame, s: Stream, value: str, size: int, name: str = "median") -> DataFrame:
    """df with the lower median of the last `size` rows, fewer at the stream's beginning."""
    rows = s.annotated(df, before={f"__m{k}": (value, k) for k in range(1, size)})
    window = F.array_sort(F.array_compact(F.array(value, *[f"__m{k}" for k in range(1, size)])))
    return rows.withColumn(name, F.get(window, F.floor((F.size(window) - 1) / 2).cast("int"))).drop(*[f"__m{k}" for k in range(1, size)])


#: Accuracy of the sketch that brackets a quantile, and the ranks (as a share of a key's rows) that a bracket reaches to on either side.
ACCURACY, MARGIN = 100_000, 5e-5


def exact_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = ACCURACY, margin: float = MARGIN, salts: int = 64) -> DataFrame:
    """Interpolated quantiles of each key, exact, without all of a key's values in one task.

    A sketch of bounded size brackets each quantile by values a few ranks below and
    above, however values are spread. A second pass counts what lies below, and sorts
    only the distinct values inside the bracket: about a ten-thousandth of a key's
    rows. The values next to a bracket count too, so that a rank right beside it is
    found; one further away would be an error, and is raised. Nulls don't count. A key
    with very many rows meets the table of brackets in `salts` groups.
    """
    names, qs = [*shares], [*shares.values()]
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    probes = [p for q in qs for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    ends = rows.groupBy(F.col("k").alias("ek")).agg(F.percentile_approx("v", probes, accuracy).alias("p"), F.count(F.lit(1)).alias("total"))
    ends = ends.withColumn("es", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.withColumn("s", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(salts))).join(ends, F.col("k").eqNullSafe(F.col("ek")) & (F.col("s") == F.col("es")))
    side = lambda i: F.when(F.col("v") < F.get("p", F.lit(2 * i)), -1).when(F.col("v") > F.get("p", F.lit(2 * i + 1)), 1).otherwise(0)
    each = met.select("k", "v", "total", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), side(i).alias("side")) for i in range(len(qs))])).alias("x")).select("k", "v", "total", "x.i", "x.side")
    inner = F.when(F.col("side") == 0, F.col("v")).alias("w")
    counts = each.groupBy("k", "i", "side", inner).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.first("total").alias("total"))
    line = Window.partitionBy("k", "i").orderBy("side", "w").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(line))
    share = F.get(F.array(*[F.lit(float(q)) for q in qs]), F.col("i"))
    place = (F.col("total") - 1) * share

    def at(rank: Column) -> Column:
        inside = (F.col("side") == 0) & (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
        below = (F.col("side") == -1) & (rank == F.col("upto") - 1)
        above = (F.col("side") == 1) & (rank == F.col("upto") - F.col("n"))
        return F.max(F.when(inside, F.col("w")).when(below, F.col("most")).when(above, F.col("least")))

    found = ranked.groupBy("k", "i").agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part"))
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    made = found.withColumn("q", sure("low") + (sure("high") - sure("low")) * F.col("part"))
    return made.groupBy(F.col("k").alias(key)).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])


def drained(df: DataFrame, s: Stream, size: Column, seconds: int, most: int) -> DataFrame:
    """keys, tick, came, gone and waiting: a queue that lets out up to `most` of what has come by each tick of so many seconds.

    Rows count for the first tick at or after them. What has gone by a tick is the least,
    over the ticks up to it, of what had come by then plus `most` for each tick since: a
    running minimum, so no stream is in one task. Ticks run from a stream's first to the
    one that empties the queue; rows without a time belong to none.
    """
    step = seconds * 1_000_000
    came = df.where(F.col(s.ts).isNotNull()).groupBy(*s.keys, F.ceil(_us(F.col(s.ts)) / step).cast("long").alias("tick")).agg(F.sum(F.coalesce(size, F.lit(0)).cast("long")).alias("came"))
    at = F.timestamp_micros(F.col("tick") * step)
    t = Stream(s.keys, "__at", ("tick",), s.unit)
    rows = t.annotated(came.withColumn("__at", at), sums={"__total": (F.col("came"), "sum")}, behind={"__next": "tick"})
    # Before a tick with arrivals the queue holds at most what came until the one before.
    rows = t.annotated(rows, sums={"__low": (F.col("__total") - F.col("came") - (F.col("tick") - 1) * most, "min")})
    # Gone by tick k: the least of all that has come, and (k - j) * most more than had come before tick j, for each j up to k with arrivals.
    gone = lambda k: F.least(F.col("__total"), F.col("__low") + k * most)
    last = F.least(F.coalesce(F.col("__next") - 1, F.col("tick") + (1 << 40)), F.greatest(F.col("tick"), F.ceil((F.col("__total") - F.col("__low")) / most).cast("long")))
    blocks = rows.withColumn("__from", F.explode(F.sequence(F.col("tick"), last, F.lit(1000).cast("long"))))
    ticks = blocks.withColumn("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + 999, last))))
    k = F.col("__k")
    before = F.when(k == F.col("tick"), F.least(F.col("__total") - F.col("came"), F.col("__low") + (k - 1) * most)).otherwise(gone(k - 1))
    return ticks.select(*s.keys, k.alias("tick"), F.when(k == F.col("tick"), F.col("came")).otherwise(0).alias("came"), (gone(k) - before).alias("gone"), (F.col("__total") - gone(k)).alias("waiting"))
