"""Operators on planes whose pixels are rows: plane, x, y and values.

For planes of any size: a stencil sees its neighbours in tiles with rims, a look-up joins.
Planes are dense rectangles from (0, 0); keys tell planes apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import Axis, dealt, line, neighbour, owned, weighted

#: Pixels on a side of a tile.
TILE = 256


def _axes(rx: int, ry: int, tile: int = TILE) -> list[Axis]:
    return [Axis("x", tile, rx, rx), Axis("y", tile, ry, ry)]


def _same(keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def sizes(planes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, width and height of each plane."""
    return planes.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def blurred(planes: DataFrame, keys: Sequence[str], value: str, wx: Sequence[float], wy: Sequence[float], name: str, tile: int = TILE) -> DataFrame:
    """planes with a weighted mean of each pixel's surroundings, along x and then along y; beyond the border its pixels go on."""
    axes = _axes(len(wx) // 2, len(wy) // 2, tile)
    rows = dealt(planes, keys, axes)
    rows = rows.withColumn("__b", weighted(value, line(keys, axes, "x", "y"), wx))
    return owned(rows.withColumn(name, weighted("__b", line(keys, axes, "y", "x"), wy)).drop("__b"), axes)


def binomial(size: int) -> list[float]:
    """Weights of a row of Pascal's triangle, which add up to 1."""
    row = [1]
    for _ in range(size - 1):
        row = [a + b for a, b in zip([0, *row], [*row, 0], strict=True)]
    return [x / 2 ** (size - 1) for x in row]


def unsharp(planes: DataFrame, keys: Sequence[str], value: str, size_x: int = 5, size_y: int = 5, amount: float = 1.0, name: str = "sharp", tile: int = TILE) -> DataFrame:
    """planes with each pixel moved away from its blurred surroundings by `amount`; a negative amount blurs. Sizes are odd."""
    rows = blurred(planes, keys, value, binomial(size_x), binomial(size_y), "__blur", tile)
    return rows.withColumn(name, F.col(value) + (F.col(value) - F.col("__blur")) * amount).drop("__blur")


def padded(planes: DataFrame, keys: Sequence[str], value: str, left: int, top: int, right: int, bottom: int, fill: float) -> DataFrame:
    """keys, x, y and value of planes inside a border of one value. The border's rows are laid out line by line, so that no row makes more than one line of pixels."""
    moved = planes.select(*keys, (F.col("x") + left).alias("x"), (F.col("y") + top).alias("y"), F.col(value))
    lines = sizes(planes, keys).select(*keys, "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") + (top + bottom - 1))).alias("y"))
    whole = F.sequence(F.lit(0).cast("long"), F.col("width") + (left + right - 1))
    inner = (F.col("y") >= top) & (F.col("y") < F.col("height") + top)
    border = F.when(inner, F.filter(whole, lambda x: (x < left) | (x >= F.col("width") + left))).otherwise(whole)
    rim = lines.select(*keys, F.explode(border).alias("x"), "y", F.lit(fill).cast(planes.schema[value].dataType).alias(value))
    return moved.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), value).unionByName(rim)


def colour_keyed(rows: DataFrame, colours: Sequence[str], key: Sequence[float], similarity: float, blend: float = 0.0, name: str = "alpha") -> DataFrame:
    """rows with how opaque each is: 0 within `similarity` of the key colour, 1 beyond, with a slope of `blend` between if there is one; null for a null component."""
    far = F.sqrt(sum(((F.col(c) - F.lit(float(k))) * (F.col(c) - F.lit(float(k))) for c, k in zip(colours, key, strict=True)), F.lit(0.0)))
    soft = F.least(F.greatest((far - similarity) / (blend or 1.0), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn(name, F.when(far.isNotNull(), soft if blend > 0 else F.when(far > similarity, 1.0).otherwise(0.0)))


def remapped(planes: DataFrame, places: DataFrame, keys: Sequence[str], value: str, fill: float, linear: bool = False) -> DataFrame:
    """keys, x, y and value of places(keys, x, y, sx, sy): the plane's value at (sx, sy), or fill where that lies outside.

    Nearest takes the pixel that holds the place; linear weighs the four whose centres
    are around it, those beyond the border being the border's. Each pixel is joined to
    the places by a corner of a cell, with its right and lower neighbours beside it; a
    pixel that very many places ask for is split by adaptive execution, as the join needs
    no order.
    """
    size = sizes(planes, keys).withColumnsRenamed({k: f"__z_{k}" for k in keys})
    asked = places.join(size, _same(keys, "__z_"), "left").drop(*[f"__z_{k}" for k in keys])
    inside = (F.col("sx") >= 0) & (F.col("sy") >= 0) & (F.col("sx") < F.col("width")) & (F.col("sy") < F.col("height"))
    asked = asked.withColumn("__in", F.coalesce(inside, F.lit(False)))
    if not linear:
        source = planes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("x").cast("long").alias("__cx"), F.col("y").cast("long").alias("__cy"), F.col(value).alias("__v"))
        asked = asked.withColumns({"__ax": F.when(F.col("__in"), F.floor("sx")), "__ay": F.when(F.col("__in"), F.floor("sy"))})
        out = asked.join(source, _same(keys, "__k_") & (F.col("__ax") == F.col("__cx")) & (F.col("__ay") == F.col("__cy")), "left")
        return out.select(*keys, "x", "y", F.coalesce(F.col("__v"), F.lit(fill)).alias(value))
    axes = [Axis("x", TILE, 0, 1), Axis("y", TILE, 0, 1)]
    cells = dealt(planes, keys, axes)
    cells = cells.withColumn("__r", neighbour(value, line(keys, axes, "x", "y"), 1))
    down = line(keys, axes, "y", "x")
    cells = owned(cells.withColumns({"__d": neighbour(value, down, 1), "__e": neighbour("__r", down, 1)}), axes)
    source = cells.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("x").cast("long").alias("__cx"), F.col("y").cast("long").alias("__cy"), F.col(value).alias("__v"), "__r", "__d", "__e")
    at = lambda c, top: F.least(F.greatest(F.col(c) - 0.5, F.lit(0.0)), (F.col(top) - 1).cast("double"))
    asked = asked.withColumns({"__u": at("sx", "width"), "__w": at("sy", "height")}).withColumns({"__ax": F.when(F.col("__in"), F.floor("__u")), "__ay": F.when(F.col("__in"), F.floor("__w"))})
    out = asked.join(source, _same(keys, "__k_") & (F.col("__ax") == F.col("__cx")) & (F.col("__ay") == F.col("__cy")), "left")
    p, q = F.col("__u") - F.col("__ax"), F.col("__w") - F.col("__ay")
    mean = (F.col("__v") * (1 - p) + F.col("__r") * p) * (1 - q) + (F.col("__d") * (1 - p) + F.col("__e") * p) * q
    return out.select(*keys, "x", "y", F.coalesce(mean, F.lit(fill)).alias(value))


# --- three-dimensional look-up tables ---------------------------------------


def lut_cells(lut: DataFrame, size: int) -> DataFrame:
    """For each cell of a table lut(i, j, k, r, g, b) of size ** 3 points its corners: array of the eight points' values, numbered 4 di + 2 dj + dk."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(n >> s & 1).alias(d) for s, d in ((2, "di"), (1, "dj"), (0, "dk"))], F.lit(n).alias("n")) for n in range(8)]))
    at = [(F.col(c) - F.col(f"c.d{c}")) for c in "ijk"]
    rows = lut.withColumn("c", corner)
    inside = reduce(lambda a, b: a & b, [(p >= 0) & (p < size - 1) for p in at])
    cell = (at[0] * size + at[1]) * size + at[2]
    rows = rows.where(inside).select(cell.cast("long").alias("__cell"), F.struct(F.col("c.n").alias("n"), F.struct("r", "g", "b").alias("v")).alias("p"))
    return rows.groupBy("__cell").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["v"]).alias("__corners"))  # eight rows a group


def looked_up(rows: DataFrame, lut: DataFrame, size: int, colours: Sequence[str] = ("r", "g", "b"), how: str = "tetrahedral", prefix: str = "lut_") -> DataFrame:
    """rows with three columns from a table of size ** 3 points over colours from 0 to 1, between them trilinear or tetrahedral.

    A row joins its cell, which has the corners beside it. The table may be too large
    for a literal or a broadcast: Spark broadcasts it if it is small, and else shuffles.
    Colours beyond 0..1 count as the end; a null gives nulls.
    """
    if how not in ("trilinear", "tetrahedral"):
        raise ValueError("how is trilinear or tetrahedral")
    top = size - 1
    scaled = {f"__s{n}": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * top) for n, c in enumerate(colours)}
    rows = rows.withColumns(scaled).withColumns({f"__i{n}": F.when(F.col(f"__s{n}").isNotNull(), F.least(F.floor(f"__s{n}"), F.lit(top - 1))) for n in range(3)})
    rows = rows.withColumns({f"__f{n}": F.col(f"__s{n}") - F.col(f"__i{n}") for n in range(3)}).withColumn("__at", ((F.col("__i0") * size + F.col("__i1")) * size + F.col("__i2")).cast("long"))
    out = rows.join(lut_cells(lut, size), F.col("__at") == F.col("__cell"), "left")
    f = [F.col(f"__f{n}") for n in range(3)]
    corner = lambda n, c: F.get("__corners", n if isinstance(n, Column) else F.lit(n))[c]
    made = {}
    if how == "trilinear":
        weights = [reduce(lambda a, b: a * b, [f[d] if n >> (2 - d) & 1 else 1 - f[d] for d in range(3)]) for n in range(8)]
        made = {f"{prefix}{c}": sum((w * corner(n, c) for n, w in enumerate(weights)), F.lit(0.0)) for c in "rgb"}
    else:
        # From the cell's lowest corner along its axes in order of their shares, largest first: four corners in all.
        order = F.transform(F.array_sort(F.array(*[F.struct((-f[d]).alias("share"), F.lit(d).alias("axis")) for d in range(3)])), lambda x: x["axis"])
        out = out.withColumn("__order", order).withColumn("__shares", F.transform("__order", lambda d: F.get(F.array(*f), d)))
        bit = lambda k: F.get(F.array(F.lit(4), F.lit(2), F.lit(1)), F.get("__order", F.lit(k)))
        share = lambda k: F.get("__shares", F.lit(k))
        for c in "rgb":
            made[f"{prefix}{c}"] = (1 - share(0)) * corner(0, c) + (share(0) - share(1)) * corner(bit(0), c) + (share(1) - share(2)) * corner(bit(0) + bit(1), c) + share(2) * corner(7, c)
    return out.withColumns(made).drop("__at", "__cell", "__corners", "__order", "__shares", *[f"__{x}{n}" for x in "sif" for n in range(3)])


# --- palettes ---------------------------------------------------------------


def _box(cuts: list[dict[int, tuple[int, int]]], colours: Sequence[str]) -> Column:
    """A colour's box, by a tree of one comparison for each cut: a box's number doubles at each level, plus one beyond the cut."""

    def node(box: int, level: int) -> Column:
        if level == len(cuts):
            return F.lit(box).cast("long")
        if (cut := cuts[level].get(box)) is None:
            return node(2 * box, level + 1)
        return F.when(F.col(colours[cut[0]]) > cut[1], node(2 * box + 1, level + 1)).otherwise(node(2 * box, level + 1))

    return node(1, 0)


def median_cuts(rows: DataFrame, colours: Sequence[str], levels: int) -> list[dict[int, tuple[int, int]]]:
    """Where the boxes of each level are cut: box -> (axis, largest value of the lower half).

    All boxes of a level are cut in one pass: whole-number colours are counted by box,
    axis and value, a table of at most boxes x axes x values rows; each box is cut along
    the axis of the largest spread, the first of equals, at its weighted median. A box of
    one colour is not cut. Only the cuts, at most one for each box, come to the driver.
    """
    cuts: list[dict[int, tuple[int, int]]] = []
    for _ in range(levels):
        axes = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(c).cast("long").alias("v")) for n, c in enumerate(colours)]))
        counts = rows.select(_box(cuts, colours).alias("box"), axes.alias("a")).groupBy("box", F.col("a.axis").alias("axis"), F.col("a.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        line_ = Window.partitionBy("box", "axis")
        stats = counts.withColumns({"spread": F.max("v").over(line_) - F.min("v").over(line_), "top": F.max("v").over(line_), "total": F.sum("n").over(line_), "upto": F.sum("n").over(line_.orderBy("v"))})
        # The lower half ends at the median, or before the largest value if that is the median.
        lower = F.min(F.when((2 * F.col("upto") >= F.col("total")) & (F.col("v") < F.col("top")), F.col("v")))
        cut = stats.groupBy("box", "axis").agg(F.max("spread").alias("spread"), F.coalesce(lower, F.max(F.when(F.col("v") < F.col("top"), F.col("v")))).alias("cut"))
        best = cut.groupBy("box").agg(F.max_by(F.struct("axis", "cut", "spread"), F.struct("spread", -F.col("axis"))).alias("b"))
        cuts.append({r.box: (r.b.axis, r.b.cut) for r in best.collect() if r.b.spread})
    return cuts


def palette(rows: DataFrame, colours: Sequence[str], levels: int) -> DataFrame:
    """Up to 2 ** levels representatives by median cut: box, the rounded mean of each colour component (halves up), and how many rows it stands for."""
    box = _box(median_cuts(rows, colours, levels), colours)
    means = [F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in colours]
    return rows.groupBy(box.alias("box")).agg(*means, F.count(F.lit(1)).alias("rows"))


# --- measures ---------------------------------------------------------------


def weighted_error(planes: DataFrame, keys: Sequence[str], original: str, other: str, block: int = 4, top: float = 255.0, floor: float = 1.0) -> DataFrame:
    """keys, wsse and xpsnr: squared errors of blocks weighed down by how busy the block is, as errors show less there.

    A pixel's activity is the size of a high pass over its eight neighbours (12 for
    itself, -2 for those beside it, -1 for those across corners); a block's is the square
    of its mean activity, `floor` squared at least; its weight the root of the plane's
    mean activity over its own. Without any error xpsnr is null.
    """
    axes = _axes(1, 1)
    rows = dealt(planes, keys, axes)
    along = line(keys, axes, "x", "y")
    rows = rows.withColumns({"__w": neighbour(original, along, -1), "__e": neighbour(original, along, 1)}).withColumn("__s", F.col("__w") + F.col("__e"))
    down = line(keys, axes, "y", "x")
    beside = F.col("__s") + neighbour(original, down, -1) + neighbour(original, down, 1)
    across = neighbour("__s", down, -1) + neighbour("__s", down, 1)
    rows = owned(rows.withColumn("__h", F.abs(12 * F.col(original) - 2 * beside - across)), axes)
    d = F.col(original) - F.col(other)
    blocks = rows.groupBy(*keys, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by")).agg(F.avg("__h").alias("__a"), F.sum(d * d).alias("__sse"), F.count(F.lit(1)).alias("__n"))
    # With weights sqrt(mean / a) the mean can be taken out of the sum: no second pass.
    act = F.greatest(F.col("__a") * F.col("__a"), F.lit(floor * floor))
    out = blocks.groupBy(*keys).agg(F.sum(F.col("__sse") / F.sqrt(act)).alias("__s"), F.avg(act).alias("__m"), F.sum("__n").alias("__n"))
    wsse = F.sqrt("__m") * F.col("__s")
    return out.select(*keys, wsse.alias("wsse"), (10 * F.log10(F.nullif(F.lit(top * top) * F.col("__n") / F.nullif(wsse, F.lit(0.0)), F.lit(0.0)))).alias("xpsnr"))


def blockiness(planes: DataFrame, keys: Sequence[str], value: str, least: int = 3, most: int = 12) -> DataFrame:
    """keys, period, phase and block: how much larger steps between neighbours are at every period-th place than between, for the period and phase where that is most; the mean of both directions."""
    axes = [Axis("x", TILE, 1, 0), Axis("y", TILE, 1, 0)]
    rows = dealt(planes, keys, axes)
    step = lambda along, fixed: F.abs(F.col(value) - F.lag(value).over(line(keys, axes, along, fixed)))
    rows = owned(rows.withColumns({"__gx": step("x", "y"), "__gy": step("y", "x")}), axes)
    # Steps by place first: what periods and phases need is a sum over the places of a line only.
    each = rows.select(*keys, F.explode(F.array(F.struct(F.lit("x").alias("d"), F.col("x").alias("at"), F.col("__gx").alias("g")), F.struct(F.lit("y").alias("d"), F.col("y").alias("at"), F.col("__gy").alias("g")))).alias("__p"))
    places = each.where("__p.g IS NOT NULL").groupBy(*keys, F.col("__p.d").alias("d"), F.col("__p.at").alias("at")).agg(F.sum("__p.g").alias("g"), F.count(F.lit(1)).alias("n"))
    places = places.withColumn("period", F.explode(F.sequence(F.lit(least), F.lit(most)))).withColumn("phase", (F.col("at") % F.col("period")).cast("int"))
    phases = places.groupBy(*keys, "d", "period", "phase").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    all_ = Window.partitionBy(*keys, "d", "period")  # `most` rows
    rest = (F.sum("g").over(all_) - F.col("g")) / F.nullif(F.sum("n").over(all_) - F.col("n"), F.lit(0))
    ratio = phases.withColumn("ratio", F.col("g") / F.col("n") / F.nullif(rest, F.lit(0.0)))
    both = ratio.groupBy(*keys, "period", "phase").agg(F.avg("ratio").alias("block"))
    return both.groupBy(*keys).agg(F.max_by(F.struct("period", "phase", "block"), F.struct("block", -F.col("period"), -F.col("phase"))).alias("b")).select(*keys, "b.period", "b.phase", "b.block")


def edge_widths(planes: DataFrame, keys: Sequence[str], value: str, threshold: float, reach: int = 16) -> DataFrame:
    """keys, edges and blur: the mean width of edges along x.

    An edge is a pixel whose central difference is at least the threshold and a largest
    one among its neighbours'; its width is that of the rising (or falling) run of pixels
    that it lies in, of which up to `reach` pixels on either side count.
    """
    axes = [Axis("x", TILE, reach + 2, reach + 2)]
    rows = dealt(planes, [*keys, "y"], axes)
    w = line([*keys, "y"], axes, "x")
    rows = rows.withColumns({"__p": F.col(value) - F.lag(value).over(w), "__g": (F.lead(value).over(w) - F.lag(value).over(w)) / 2})
    rows = rows.withColumn("__sign", F.signum("__p"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # The step into a pixel goes the other way than the one before it, or none: a run ends there.
    rows = rows.withColumn("__turn", F.when(F.col("__sign").eqNullSafe(F.lag("__sign").over(w)), 0).otherwise(1)).withColumn("__run", F.sum("__turn").over(run))
    part = Window.partitionBy(*keys, "y", *[a.tile for a in axes], "__run")
    rows = rows.withColumns({"__lo": F.min("x").over(part) - 1, "__hi": F.max("x").over(part)})
    # A pixel between two steps of one sign lies in the run of both.
    size = F.abs("__g")
    peak = (size >= threshold) & (size >= F.coalesce(F.abs(F.lag("__g").over(w)), F.lit(0.0))) & (size > F.coalesce(F.abs(F.lead("__g").over(w)), F.lit(0.0))) & (F.col("__sign") == F.signum("__g"))
    width = F.least(F.col("x") - F.col("__lo"), F.lit(reach)) + F.least(F.col("__hi") - F.col("x"), F.lit(reach))
    edges = owned(rows.withColumn("__width", F.when(peak, width)), axes)
    return edges.groupBy(*keys).agg(F.count("__width").alias("edges"), F.avg("__width").alias("blur"))
