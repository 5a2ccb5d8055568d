"""Stencils over rows with places: tiles that hold a rim of their neighbours' rows.

A row is sent to its own tile and to those whose rim it lies in, so that whatever looks
`before` and `behind` rows away finds them in one group of bounded size, however long
the line or large the plane. One shuffle deals the tiles; windows inside them need none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axis:
    """A column of whole-number places, cut into tiles of `size` with rims."""

    name: str
    size: int
    before: int = 0
    behind: int = 0

    @property
    def tile(self) -> str:
        return f"__tile_{self.name}"


def _tile(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("long")


def dealt(df: DataFrame, keys: Sequence[str], axes: Sequence[Axis]) -> DataFrame:
    """df's rows by tile, each once for every tile that it belongs to or is in the rim of; __own says which are a tile's own."""
    own = F.lit(True)
    for a in axes:
        place = F.col(a.name)
        df = df.withColumn(a.tile, F.explode(F.sequence(_tile(place - a.behind, a.size), _tile(place + a.before, a.size))))
        own = own & (F.col(a.tile) == _tile(place, a.size))
    return df.withColumn("__own", own).repartition(*[F.col(k) for k in keys], *[F.col(a.tile) for a in axes])


def owned(df: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """Without rims and the columns of tiles."""
    return df.where("__own").drop("__own", *[a.tile for a in axes])


def line(keys: Sequence[str], axes: Sequence[Axis], along: str, *fixed: str):
    """A window along one axis inside a tile; fixed are the other places."""
    return Window.partitionBy(*keys, *[a.tile for a in axes], *fixed).orderBy(along)


def neighbour(value: str | Column, w, by: int) -> Column:
    """The value `by` rows on in a dense line; beyond its ends that of the end."""
    c = F.col(value) if isinstance(value, str) else value
    if by == 0:
        return c
    if by < 0:
        return F.coalesce(F.lag(c, -by).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return F.coalesce(F.lead(c, by).over(w), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def weighted(value: str, w, weights: Sequence[float]) -> Column:
    """The sum of 2 r + 1 weights over the r rows before to the r behind."""
    r = len(weights) // 2
    parts = [neighbour(value, w, k - r) * F.lit(float(x)) for k, x in enumerate(weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def sliding_extreme(df: DataFrame, keys: Sequence[str], place: str, value: str, size: int, name: str, how: str = "max", ahead: bool = True, tile: int = 65_536) -> DataFrame:
    """df with the largest (or smallest) value of the `size` rows from each row on (or up to it), in time that doesn't depend on size.

    Rows have whole numbers as places, one each without gaps. In blocks of `size` rows the
    extremes from a block's beginning and to its end are kept; any stretch of `size` rows
    is the end of one block and the beginning of the next. Nulls don't count; at the ends
    of a line the stretch is shorter.
    """
    reach = size - 1
    axis = Axis(place, max(tile, size), 0 if ahead else reach, reach if ahead else 0)
    rows = dealt(df, keys, [axis]).withColumn("__block", _tile(F.col(place), size))
    agg, pick = (F.max, F.greatest) if how == "max" else (F.min, F.least)
    block = Window.partitionBy(*keys, axis.tile, "__block").orderBy(place)
    rows = rows.withColumns({"__from": agg(value).over(block.rowsBetween(Window.unboundedPreceding, 0)), "__to": agg(value).over(block.rowsBetween(0, Window.unboundedFollowing))})
    w = line(keys, [axis], place)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Where the line ends earlier: what is left of the row's block, and the whole of the next one if there is one.
    if ahead:
        far = F.when(F.lead("__block", reach).over(w).isNotNull(), F.lead("__from", reach).over(w)).when(F.col("__block") < F.max("__block").over(all_), F.last("__from").over(all_))
        rows = rows.withColumn(name, pick("__to", far if reach else F.col("__to")))
    else:
        far = F.when(F.lag("__block", reach).over(w).isNotNull(), F.lag("__to", reach).over(w)).when(F.col("__block") > F.min("__block").over(all_), F.first("__to").over(all_))
        rows = rows.withColumn(name, pick("__from", far if reach else F.col("__from")))
    return owned(rows.drop("__block", "__from", "__to"), [axis])
