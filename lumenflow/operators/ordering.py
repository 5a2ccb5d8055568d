"""Order-dependent building blocks that don't put a whole stream into one task.

A stream (the rows of one value of `keys`, ordered by a timestamp and ties) is cut
into time buckets. What depends on earlier rows (running sums, the rows before, the
last value that is not null, runs) is found inside each bucket by windows, and
from bucket to bucket over a small table with one row for each bucket. All that one
pass asks for shares its shuffle: rows are dealt once by stream and bucket, the small
table is taken from the dealt rows, and the two are joined. A stream with a third of
all rows is spread over its buckets; for large inputs `fitted_unit` chooses the unit of
time that keeps the fullest bucket small.

Rows without a timestamp have no place in a stream and are left out by everything
here; so are they in the SQL of the queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
#: Units of time from coarse to fine, those for bursts inside a second, and the rows that a bucket should have at most.
UNITS, FINER, BUCKET_ROWS = ("day", "hour", "minute", "second"), ("millisecond", "microsecond"), 1_000_000
#: The unit that is chosen from the input: a day for less than AUTO_BYTES of files, else what fitted_unit says.
AUTO, AUTO_BYTES = "auto", 1 << 28


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables that df is made from, as far as Spark knows them without reading."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)  # what isn't known counts as Long's largest


def bucketed(df: DataFrame, ts: str, unit: str = AUTO, keys: list[str] | None = None) -> DataFrame:
    if unit == AUTO:
        unit = fitted_unit(df, keys or [], ts, finer=True) if input_bytes(df) >= AUTO_BYTES else UNITS[0]
    return df.where(F.col(ts).isNotNull()).withColumn(BUCKET, F.date_trunc(unit, F.col(ts)))


def fitted_unit(df: DataFrame, keys: list[str], ts: str, most: int = BUCKET_ROWS, finer: bool = False) -> str:
    """The coarsest unit whose fullest bucket has `most` rows or fewer; the finest if none has, which is a second, or a microsecond if finer. Only one number for each unit comes to the driver."""
    fine = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc(UNITS[-1], F.col(ts)).alias("__t")).agg(F.count(F.lit(1)).alias("__n"))
    for unit in reversed(UNITS):
        fine = fine.groupBy(*keys, F.date_trunc(unit, F.col("__t")).alias("__t")).agg(F.sum("__n").alias("__n")) if unit != UNITS[-1] else fine
        top = fine.agg(F.max("__n").alias("m")).select(F.lit(unit).alias("unit"), "m")
        tops = top if unit == UNITS[-1] else tops.unionByName(top)
    found = {r["unit"]: r["m"] or 0 for r in tops.collect()}
    unit = next((u for u in UNITS if found[u] <= most), UNITS[-1])
    if not finer or found[unit] <= most:
        return unit
    for unit in FINER:
        top = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias("__t")).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0]
        if top <= most:
            break
    return unit


def _inside(keys: list[str], order: list[Column | str]):
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def _between(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BUCKET)


def _pass(df: DataFrame, keys: list[str], ts: str, unit: str, local: dict[str, Column], edges: dict[str, Column], *between: dict[str, Column]) -> DataFrame:
    """df by bucket with local columns (windows inside a bucket, each of which may use those before it) and `between` columns.

    edges are aggregates of a bucket; each of `between` has windows over the table
    of buckets, on the columns that the one before it gives.
    """
    rows = bucketed(df, ts, unit, keys).repartition(*[F.col(k) for k in keys], F.col(BUCKET))
    for n, c in local.items():
        rows = rows.withColumn(n, c)
    table = rows.groupBy(*keys, BUCKET).agg(*[c.alias(n) for n, c in edges.items()])
    for cols in between:
        table = table.select(*keys, BUCKET, *[c.alias(n) for n, c in cols.items()])
    names = {c: f"__r_{c}" for c in (*keys, BUCKET)}
    cond = None
    for c, n in names.items():
        same = F.col(c).eqNullSafe(F.col(n))
        cond = same if cond is None else cond & same
    return rows.join(table.withColumnsRenamed(names), cond).drop(*names.values(), BUCKET)


_HOW: dict[str, tuple[Callable, Callable]] = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def annotated(df: DataFrame, keys: list[str], ts: str, ties: list[str], sums: dict[str, tuple[Column, str]] | None = None, before: dict[str, tuple[str, int]] | None = None, behind: dict[str, str] | None = None, unit: str = AUTO) -> DataFrame:
    """df with columns that depend on a row's place in its stream, all in one pass.

    sums: name -> (value, sum | min | max): over the stream's rows up to and with each row.
    before: name -> (column, k): the column's value k rows before (k from 1).
    behind: name -> column: its value in the next row.
    """
    sums, before, behind = sums or {}, before or {}, behind or {}
    order = [ts, *ties]
    w, line = _inside(keys, order), _between(keys)
    local: dict[str, Column] = {}
    edges: dict[str, Column] = {}
    between: dict[str, Column] = {}
    df = df.withColumns({f"__i_v_{n}": v for n, (v, _) in sums.items()}) if sums else df
    for n, (_, how) in sums.items():
        agg = _HOW[how][0]
        local[f"__i_s_{n}"] = agg(f"__i_v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0))
        edges[f"__i_t_{n}"] = agg(f"__i_v_{n}")
        between[f"__i_o_{n}"] = agg(f"__i_t_{n}").over(line.rowsBetween(Window.unboundedPreceding, -1))
    depth = max((k for _, k in before.values()), default=0)
    here = F.struct(*[F.col(c).alias(c) for c in sorted({c for c, _ in before.values()})]) if before else None
    if before:
        local["__i_row"] = F.row_number().over(w)
        local |= {f"__i_b{k}": F.lag(here, k).over(w) for k in range(1, depth + 1)}
        # The last rows of a bucket, and then of those before it: the latest first.
        edges["__last"] = F.max_by(F.array(here, *[F.col(f"__i_b{k}") for k in range(1, depth)]), F.struct(*order))
        between["__i_ago"] = F.filter(F.flatten(F.reverse(F.collect_list("__last").over(line.rowsBetween(-depth, -1)))), lambda x: x.isNotNull())
    if behind:
        ahead = F.struct(*[F.col(c).alias(c) for c in sorted(set(behind.values()))])
        local["__i_next"] = F.lead(ahead).over(w)
        edges["__first"] = F.min_by(ahead, F.struct(*order))
        between["__i_then"] = F.lead("__first").over(line)
    out = _pass(df, keys, ts, unit, local, edges, between)
    made = {n: _HOW[how][1](F.col(f"__i_o_{n}"), F.col(f"__i_s_{n}")) for n, (_, how) in sums.items()}
    for n, (c, k) in before.items():
        made[n] = F.when(F.col("__i_row") > k, F.col(f"__i_b{k}")[c]).otherwise(F.get("__i_ago", F.lit(k) - F.col("__i_row"))[c])
    made |= {n: F.when(F.col("__i_next").isNotNull(), F.col("__i_next")[c]).otherwise(F.col("__i_then")[c]) for n, c in behind.items()}
    return out.withColumns(made).drop(*local, *between, *[f"__i_v_{n}" for n in sums])


def running(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: Column, name: str, how: str = "sum", unit: str = AUTO) -> DataFrame:
    """df with a column: the sum, min or max of value over the stream's rows up to and with each row."""
    return annotated(df, keys, ts, ties, sums={name: (value, how)}, unit=unit)


def numbered(df: DataFrame, keys: list[str], ts: str, ties: list[str], name: str = "n", unit: str = AUTO) -> DataFrame:
    """df with each row's place in its stream, from 0."""
    return running(df, keys, ts, ties, F.lit(1).cast("long"), name, "sum", unit).withColumn(name, (F.col(name) - 1).cast("long"))


def with_previous(df: DataFrame, keys: list[str], ts: str, ties: list[str], cols: dict[str, str], unit: str = AUTO) -> DataFrame:
    """df with the values that columns have in the stream's row before: cols maps a column to the new one's name."""
    return annotated(df, keys, ts, ties, before={n: (c, 1) for c, n in cols.items()}, unit=unit)


def with_next(df: DataFrame, keys: list[str], ts: str, ties: list[str], cols: dict[str, str], unit: str = AUTO) -> DataFrame:
    """df with the values that columns have in the stream's row behind."""
    return annotated(df, keys, ts, ties, behind={n: c for c, n in cols.items()}, unit=unit)


def carried(df: DataFrame, keys: list[str], ts: str, ties: list[str], value: str, name: str, unit: str = AUTO) -> DataFrame:
    """df with the last value that is not null at or before each row of the stream."""
    upto = Window.unboundedPreceding
    local = {"__local": F.last(value, ignorenulls=True).over(_inside(keys, [ts, *ties]).rowsBetween(upto, 0))}
    edges = {"__last": F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(ts, *ties)))}
    between = {"__before": F.last("__last", ignorenulls=True).over(_between(keys).rowsBetween(upto, -1))}
    return _pass(df, keys, ts, unit, local, edges, between).withColumn(name, F.coalesce("__local", "__before")).drop("__local", "__before")


def islands(df: DataFrame, keys: list[str], ts: str, ties: list[str], cols: list[str], same: Callable[[Column, Column], Column], name: str = "island", unit: str = AUTO) -> DataFrame:
    """df with a number for each maximal run of rows, from 1.

    same(a, b) says, from the structs of `cols` of the row before and of a row,
    whether the row goes on the run (null: no).
    """
    here, order = F.struct(*[F.col(c).alias(c) for c in cols]), F.struct(ts, *ties)
    new = lambda a, b: F.when(F.coalesce(same(a, b), F.lit(False)), 0).otherwise(1)
    w = _inside(keys, [ts, *ties])
    rows = df.withColumn("__here", here)
    local = {"__prev": F.lag("__here").over(w), "__new": F.when(F.col("__prev").isNull(), 0).otherwise(new(F.col("__prev"), F.col("__here")))}
    local["__count"] = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    edges = {"__head": F.min_by("__here", order), "__tail": F.max_by("__here", order), "__total": F.sum("__new")}
    line = _between(keys)
    before = F.lag("__tail").over(line)
    begins = F.when(before.isNull(), 1).otherwise(new(before, F.col("__head")))
    # What a bucket's first row adds is known only from the bucket before.
    between = {"__begins": begins, "__total": F.col("__total")}
    dealt = _pass(rows, keys, ts, unit, local, edges, between, {"__offset": F.sum(F.col("__begins") + F.col("__total")).over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__total")})
    return dealt.withColumn(name, (F.col("__offset") + F.col("__count")).cast("long")).drop("__here", "__prev", "__new", "__count", "__offset")
