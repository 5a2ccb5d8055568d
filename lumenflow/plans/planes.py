"""Queries over planes and colours that embeddings hold: a plane is 64 vectors of 64 components, a colour three components one behind the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenflow.operators import planes as P
from lumenflow.registry import query
from lumenflow.session import table

_P = "p AS MATERIALIZED (SELECT vec_id // 64 AS plane, vec_id % 64 AS y, i::BIGINT AS x, 128 + 256 * embedding[i + 1]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings))"
_C = "c AS MATERIALIZED (SELECT vec_id, i::BIGINT AS i, least(greatest(floor(128 + 256 * embedding[3 * i + 1]::DOUBLE), 0), 255)::BIGINT AS r, least(greatest(floor(128 + 256 * embedding[3 * i + 2]::DOUBLE), 0), 255)::BIGINT AS g, least(greatest(floor(128 + 256 * embedding[3 * i + 3]::DOUBLE), 0), 255)::BIGINT AS b FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 3)) AS i FROM embeddings))"
_S = "s AS (SELECT plane, max(x) + 1 AS width, max(y) + 1 AS height FROM p GROUP BY plane)"


def _planes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select(F.expr("vec_id div 64").alias("plane"), (F.col("vec_id") % 64).alias("y"), F.col("i").cast("long").alias("x"), (128 + 256 * F.col("e").cast("double")).alias("v"))


def _colours(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    e = e.where(F.size("embedding") >= 3).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1)).alias("i"))
    at = lambda k: F.least(F.greatest(F.floor(128 + 256 * F.get("embedding", 3 * F.col("i") + k).cast("double")), F.lit(0)), F.lit(255))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


@query(
    f"""WITH {_P}, {_S}, k AS (SELECT x - 2 AS d, [1, 4, 6, 4, 1][x + 1] / 16.0::DOUBLE AS w FROM range(5) t(x)), l AS (SELECT x - 1 AS d, [1, 2, 1][x + 1] / 4.0::DOUBLE AS w FROM range(3) t(x)),
a AS (SELECT q.plane, q.x, q.y, sum(p.v * w) AS v FROM (SELECT plane, x, y, width, d, w FROM p JOIN s USING (plane), k) q JOIN p ON p.plane = q.plane AND p.y = q.y AND p.x = least(greatest(q.x + d, 0), width - 1) GROUP BY ALL),
b AS (SELECT q.plane, q.x, q.y, sum(a.v * w) AS v FROM (SELECT plane, x, y, height, d, w FROM a JOIN s USING (plane), l) q JOIN a ON a.plane = q.plane AND a.x = q.x AND a.y = least(greatest(q.y + d, 0), height - 1) GROUP BY ALL)
SELECT plane, x, y, round(p.v + (p.v - b.v) * 1.5::DOUBLE, 6) AS sharp FROM p JOIN b USING (plane, x, y)"""
)
def unsharp(spark, sf_dir):
    """Planes sharpened by 5 x 3 surroundings."""
    out = P.unsharp(_planes(spark, sf_dir), ["plane"], "v", 5, 3, 1.5)
    return out.select("plane", "x", "y", F.round("sharp", 6).alias("sharp"))


@query(
    f"""WITH {_P}, {_S}, g AS (SELECT plane, width, height, unnest(range(width + 5)) AS x FROM s), h AS (SELECT *, unnest(range(height + 3)) AS y FROM g)
SELECT h.plane, h.x, h.y, coalesce(p.v, 16.0) AS v FROM h LEFT JOIN p ON p.plane = h.plane AND p.x = h.x - 2 AND p.y = h.y - 1"""
)
def pad_planes(spark, sf_dir):
    """Planes with a border of 2, 1, 3 and 2 pixels."""
    return P.padded(_planes(spark, sf_dir), ["plane"], "v", 2, 1, 3, 2, 16.0)


_PLACES = "m AS (SELECT plane, x, y, 31.5::DOUBLE + (x - 31.5::DOUBLE) * 0.8::DOUBLE - (y - 31.5::DOUBLE) * 0.6::DOUBLE AS sx, 31.5::DOUBLE + (x - 31.5::DOUBLE) * 0.6::DOUBLE + (y - 31.5::DOUBLE) * 0.8::DOUBLE AS sy FROM p)"
_INSIDE = "sx >= 0 AND sy >= 0 AND sx < width AND sy < height"


def _places(planes: DataFrame) -> DataFrame:
    dx, dy = F.col("x") - F.lit(31.5), F.col("y") - F.lit(31.5)
    return planes.select("plane", "x", "y", (F.lit(31.5) + dx * 0.8 - dy * 0.6).alias("sx"), (F.lit(31.5) + dx * 0.6 + dy * 0.8).alias("sy"))


@query(f"WITH {_P}, {_S}, {_PLACES} SELECT m.plane, m.x, m.y, coalesce(p.v, -1.0) AS v FROM m JOIN s USING (plane) LEFT JOIN p ON {_INSIDE} AND p.plane = m.plane AND p.x = floor(sx)::BIGINT AND p.y = floor(sy)::BIGINT")
def remap_nearest(spark, sf_dir):
    """Planes turned by a map of places; what lies outside is -1."""
    p = _planes(spark, sf_dir)
    return P.remapped(p, _places(p), ["plane"], "v", -1.0)


@query(
    f"""WITH {_P}, {_S}, {_PLACES}, u AS (SELECT *, least(greatest(sx - 0.5, 0), width - 1)::DOUBLE AS u, least(greatest(sy - 0.5, 0), height - 1)::DOUBLE AS w FROM m JOIN s USING (plane) WHERE {_INSIDE}),
k AS (SELECT *, unnest(range(2)) AS i FROM u), l AS (SELECT *, unnest(range(2)) AS j FROM k),
r AS (SELECT l.plane, l.x, l.y, sum(p.v * CASE i WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END * CASE j WHEN 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) AS v
  FROM l JOIN p ON p.plane = l.plane AND p.x = least(floor(u)::BIGINT + i, width - 1) AND p.y = least(floor(w)::BIGINT + j, height - 1) GROUP BY ALL)
SELECT plane, x, y, round(coalesce(r.v, -1.0), 6) AS v FROM m LEFT JOIN r USING (plane, x, y)"""
)
def remap_linear(spark, sf_dir):
    p = _planes(spark, sf_dir)
    return P.remapped(p, _places(p), ["plane"], "v", -1.0, linear=True).withColumn("v", F.round("v", 6))


@query(
    f"WITH {_C}, d AS (SELECT *, sqrt((r - 120.0::DOUBLE) ** 2 + (g - 130.0::DOUBLE) ** 2 + (b - 110.0::DOUBLE) ** 2) AS far FROM c) SELECT vec_id, i, round(least(greatest((far - 20) / 30.0::DOUBLE, 0), 1), 6) AS alpha, CASE WHEN far > 40 THEN 1.0 ELSE 0.0 END::DOUBLE AS hard FROM d"
)
def colour_key(spark, sf_dir):
    """How far colours are from a key, with a slope and without."""
    rows = P.colour_keyed(_colours(spark, sf_dir), ["r", "g", "b"], [120, 130, 110], 20, 30)
    rows = P.colour_keyed(rows, ["r", "g", "b"], [120, 130, 110], 40, name="hard")
    return rows.select("vec_id", "i", F.round("alpha", 6).alias("alpha"), "hard")


# A table of 17 ** 3 points: components turned round, bent and mixed.
_LUT = "t AS MATERIALIZED (SELECT i, j, k, (i / 16.0::DOUBLE) ** 2 * 0.9731::DOUBLE AS lr, (j / 16.0::DOUBLE + k / 16.0::DOUBLE) * 0.4877::DOUBLE AS lg, (k / 16.0::DOUBLE) * (1 - i / 16.0::DOUBLE) * 0.9517::DOUBLE AS lb FROM range(17) a(i), range(17) b(j), range(17) c(k))"


def _lut(spark) -> DataFrame:
    n = spark.range(17**3).select(F.expr("id div 289").alias("i"), F.expr("id div 17 % 17").alias("j"), F.expr("id % 17").alias("k"))
    x, y, z = (F.col(c) / 16.0 for c in "ijk")
    return n.select("i", "j", "k", (x * x * 0.9731).alias("r"), ((y + z) * 0.4877).alias("g"), (z * (1 - x) * 0.9517).alias("b"))


_CELL = f"{_C}, {_LUT}, x AS (SELECT *, least(floor(r / 255.0::DOUBLE * 16), 15)::BIGINT AS ci, least(floor(g / 255.0::DOUBLE * 16), 15)::BIGINT AS cj, least(floor(b / 255.0::DOUBLE * 16), 15)::BIGINT AS ck FROM c), y AS (SELECT *, r / 255.0::DOUBLE * 16 - ci AS fi, g / 255.0::DOUBLE * 16 - cj AS fj, b / 255.0::DOUBLE * 16 - ck AS fk FROM x), n AS (SELECT a AS di, b AS dj, c AS dk FROM range(2) p(a), range(2) q(b), range(2) s(c))"
_MIXED = "round(sum(w * lr), 6) AS lut_r, round(sum(w * lg), 6) AS lut_g, round(sum(w * lb), 6) AS lut_b"


def _shares(spark, sf_dir):
    return _colours(spark, sf_dir).select("vec_id", "i", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "i", *[F.round(f"lut_{c}", 6).alias(f"lut_{c}") for c in "rgb"])


@query(f"WITH {_CELL}, w AS (SELECT *, CASE di WHEN 1 THEN fi ELSE 1 - fi END * CASE dj WHEN 1 THEN fj ELSE 1 - fj END * CASE dk WHEN 1 THEN fk ELSE 1 - fk END AS w FROM y, n) SELECT vec_id, w.i, {_MIXED} FROM w JOIN t ON t.i = ci + di AND t.j = cj + dj AND t.k = ck + dk GROUP BY vec_id, w.i")
def lut_trilinear(spark, sf_dir):
    """Colours by a table of three dimensions, between its points by all eight corners."""
    return _rounded(P.looked_up(_shares(spark, sf_dir), _lut(spark), 17, how="trilinear"))


@query(
    f"""WITH {_CELL}, o AS (SELECT *, list_sort([(-fi, 0), (-fj, 1), (-fk, 2)]) AS o FROM y), e AS (SELECT *, unnest(range(4)) AS e FROM o),
w AS (SELECT *, CASE e WHEN 0 THEN 1 + o[1][1] WHEN 3 THEN -o[3][1] ELSE -o[e][1] + o[e + 1][1] END AS w, (list_contains(list_transform(o[1:e], lambda z: z[2]), 0))::INT AS di, (list_contains(list_transform(o[1:e], lambda z: z[2]), 1))::INT AS dj, (list_contains(list_transform(o[1:e], lambda z: z[2]), 2))::INT AS dk FROM e)
SELECT vec_id, w.i, {_MIXED} FROM w JOIN t ON t.i = ci + di AND t.j = cj + dj AND t.k = ck + dk GROUP BY vec_id, w.i"""
)
def lut_tetrahedral(spark, sf_dir):
    """The same by the four corners of the tetrahedron around each colour."""
    return _rounded(P.looked_up(_shares(spark, sf_dir), _lut(spark), 17))


def _palette_sql(levels: int) -> str:
    steps = []
    for n in range(levels):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT box, axis, v, count(*) AS n FROM (SELECT box, unnest([0, 1, 2]) AS axis, unnest([r, g, b]) AS v FROM b{n}) GROUP BY ALL),
s{n} AS (SELECT *, max(v) OVER w - min(v) OVER w AS spread, max(v) OVER w AS top, sum(n) OVER w AS total, sum(n) OVER (PARTITION BY box, axis ORDER BY v) AS upto FROM a{n} WINDOW w AS (PARTITION BY box, axis)),
u{n} AS (SELECT box, axis, max(spread) AS spread, coalesce(min(v) FILTER (2 * upto >= total AND v < top), max(v) FILTER (v < top)) AS cut FROM s{n} GROUP BY ALL),
k{n} AS (SELECT * FROM u{n} WHERE spread > 0 QUALIFY row_number() OVER (PARTITION BY box ORDER BY spread DESC, axis) = 1),
b{n + 1} AS MATERIALIZED (SELECT b{n}.box * 2 + CASE WHEN [r, g, b][axis + 1] > cut THEN 1 ELSE 0 END AS box, r, g, b FROM b{n} LEFT JOIN k{n} USING (box))""")
    return f"WITH {_C}, b0 AS (SELECT 1::BIGINT AS box, r, g, b FROM c), {', '.join(steps)} SELECT box, floor(avg(r) + 0.5)::BIGINT AS r, floor(avg(g) + 0.5)::BIGINT AS g, floor(avg(b) + 0.5)::BIGINT AS b, count(*) AS rows FROM b{levels} GROUP BY box"


@query(_palette_sql(4))
def palette(spark, sf_dir):
    """Sixteen representatives of the colours, by median cut."""
    return P.palette(_colours(spark, sf_dir), ["r", "g", "b"], 4)


_OTHER = "floor(v / 16) * 16 + 8"


@query(
    f"""WITH {_P}, {_S}, k AS (SELECT a - 1 AS dx, b - 1 AS dy, CASE WHEN a = 1 AND b = 1 THEN 12 WHEN a = 1 OR b = 1 THEN -2 ELSE -1 END AS w FROM range(3) u(a), range(3) v(b)),
h AS (SELECT q.plane, q.x, q.y, any_value(q.v) AS v, abs(sum(p.v * w)) AS h FROM (SELECT * FROM p JOIN s USING (plane), k) q JOIN p ON p.plane = q.plane AND p.x = least(greatest(q.x + dx, 0), width - 1) AND p.y = least(greatest(q.y + dy, 0), height - 1) GROUP BY ALL),
b AS (SELECT plane, x // 4 AS bx, y // 4 AS by, greatest(avg(h) ** 2, 1) AS a, sum((v - ({_OTHER})) ** 2) AS sse, count(*) AS n FROM h GROUP BY ALL),
e AS (SELECT plane, sqrt(avg(a)) * sum(sse / sqrt(a)) AS wsse, sum(n) AS n FROM b GROUP BY plane)
SELECT plane, round(wsse, 4) AS wsse, round(10 * log10(255.0::DOUBLE * 255 * n / wsse), 6) AS xpsnr FROM e"""
)
def xpsnr(spark, sf_dir):
    """Planes against themselves in steps of 16, with errors weighed by activity."""
    p = _planes(spark, sf_dir).withColumn("other", F.floor(F.col("v") / 16) * 16.0 + 8)
    return P.weighted_error(p, ["plane"], "v", "other").select("plane", F.round("wsse", 4).alias("wsse"), F.round("xpsnr", 6).alias("xpsnr"))


@query(
    f"""WITH {_P}, g AS (SELECT plane, 'x' AS d, x AS place, abs(v - lag(v) OVER (PARTITION BY plane, y ORDER BY x)) AS g FROM p UNION ALL SELECT plane, 'y', y, abs(v - lag(v) OVER (PARTITION BY plane, x ORDER BY y)) FROM p),
a AS (SELECT plane, d, period, (place % period)::INT AS phase, sum(g) AS g, count(*) AS n FROM (SELECT *, unnest(range(3, 13)) AS period FROM g WHERE g IS NOT NULL) GROUP BY ALL),
r AS (SELECT *, g / n / nullif((sum(g) OVER w - g) / nullif(sum(n) OVER w - n, 0), 0) AS ratio FROM a WINDOW w AS (PARTITION BY plane, d, period)),
b AS (SELECT plane, period::INT AS period, phase, avg(ratio) AS block FROM r GROUP BY ALL)
SELECT plane, period, phase, round(block, 6) AS block FROM b QUALIFY row_number() OVER (PARTITION BY plane ORDER BY block DESC NULLS LAST, period, phase) = 1"""
)
def blockdetect(spark, sf_dir):
    """How much steps stand out on a grid, for the grid where they do most."""
    return P.blockiness(_planes(spark, sf_dir), ["plane"], "v").withColumn("block", F.round("block", 6))


@query(
    f"""WITH {_P}, a AS (SELECT *, v - lag(v) OVER w AS p, (lead(v) OVER w - lag(v) OVER w) / 2 AS g FROM p WINDOW w AS (PARTITION BY plane, y ORDER BY x)),
b AS (SELECT *, sign(p) AS s FROM a), c AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER w THEN 0 ELSE 1 END AS turn, abs(lag(g) OVER w) AS before, abs(lead(g) OVER w) AS behind FROM b WINDOW w AS (PARTITION BY plane, y ORDER BY x)),
d AS (SELECT *, sum(turn) OVER (PARTITION BY plane, y ORDER BY x) AS run FROM c), e AS (SELECT *, min(x) OVER w - 1 AS lo, max(x) OVER w AS hi FROM d WINDOW w AS (PARTITION BY plane, y, run)),
f AS (SELECT *, CASE WHEN abs(g) >= 20 AND abs(g) >= coalesce(before, 0) AND abs(g) > coalesce(behind, 0) AND s = sign(g) THEN least(x - lo, 16) + least(hi - x, 16) END AS width FROM e)
SELECT plane, count(width) AS edges, round(avg(width), 6) AS blur FROM f GROUP BY plane"""
)
def blurdetect(spark, sf_dir):
    """Mean width of edges."""
    return P.edge_widths(_planes(spark, sf_dir), ["plane"], "v", 20.0).withColumn("blur", F.round("blur", 6))
