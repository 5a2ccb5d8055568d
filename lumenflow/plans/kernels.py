"""Numeric kernels over embeddings: each vector is a row of 64 samples or an 8 by 8 plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import kernels as K
from lumenflow.registry import query
from lumenflow.session import ship_package, table

_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
_PAIR = f"{_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")


@query(f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)) / 64, 9) AS mse, round(10 * log10(4.0::DOUBLE / (list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) ** 2)) / 64)), 6) AS psnr FROM {_PAIR}")
def psnr(spark, sf_dir):
    mse = K.sum_squared_error(F.col("e"), F.col("f")) / 64
    return _pairs(spark, sf_dir).select("vec_id", F.round(mse, 9).alias("mse"), F.round(K.psnr(mse, 2.0), 6).alias("psnr"))


@query(f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))), 9) AS sad, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 9) AS dot FROM {_PAIR}")
def block_sad(spark, sf_dir):
    e, f = F.col("e"), F.col("f")
    return _pairs(spark, sf_dir).select("vec_id", F.round(K.sum_abs_diff(e, f), 9).alias("sad"), F.round(K.scalar_product(e, f), 9).alias("dot"))


@query(f"SELECT vec_id, len(list_filter(e, lambda x: x <= -0.1))::BIGINT AS n_black FROM {_E}")
def blackdetect(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", K.count_at_most(F.col("e"), -0.1).alias("n_black"))


@query(f"SELECT vec_id, i - 1 AS pos, CASE WHEN e[i] <= 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS level FROM (SELECT *, unnest(range(1, 65)) AS i FROM {_E})")
def threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode("e").alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), K.threshold_select(F.col("x"), F.lit(0.0), F.lit(-1.0), F.lit(1.0)).alias("level"))


@query(f"SELECT vec_id, i - 1 AS pos, round(list_avg(e[greatest(i - 2, 1) : i + 2]), 9) AS mean, list_max(e[greatest(i - 2, 1) : i + 2]) AS high, list_min(e[greatest(i - 2, 1) : i + 2]) AS low FROM (SELECT *, unnest(range(1, 65)) AS i FROM {_E})")
def boxblur_morphology(spark, sf_dir):
    e = F.col("e")
    rows = _vectors(spark, sf_dir).select("vec_id", F.arrays_zip(K.box_mean(e, 2).alias("mean"), K.box_extreme(e, 2, True).alias("high"), K.box_extreme(e, 2, False).alias("low")).alias("z"))
    out = rows.select("vec_id", F.posexplode("z").alias("pos", "z"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("z.mean", 9).alias("mean"), F.col("z.high").alias("high"), F.col("z.low").alias("low"))


@query(f"SELECT vec_id, i AS pos, e[(i % 8) * 8 + i // 8 + 1] AS value FROM (SELECT *, unnest(range(0, 64)) AS i FROM {_E})")
def transpose(spark, sf_dir):
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(K.transposed(F.col("e"), 8, 8)).alias("pos", "value"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


_INTEGRAL = f"""WITH c AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, e[i + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM {_E})),
r AS (SELECT *, sum(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS s FROM c) SELECT vec_id, y * 8 + x AS pos, round(sum(s) OVER (PARTITION BY vec_id, x ORDER BY y), 9) + 0 AS total FROM r"""


@query(_INTEGRAL)
@query(_INTEGRAL, "integral_image_whole")
def integral_image(spark, sf_dir):
    """Every vector as a plane."""
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(K.integral_image(F.col("e"), 8)).alias("pos", "total"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("total", 9) + 0).alias("total"))


@query(f"SELECT vec_id, list_min(list_filter(range(0, 64), lambda i: e[i + 1] > 0.2)) AS first, list_max(list_filter(range(0, 64), lambda i: e[i + 1] > 0.2)) AS last FROM {_E}")
def bounding_box(spark, sf_dir):
    b = _vectors(spark, sf_dir).select("vec_id", K.bounding_range(F.col("e"), 0.2).alias("b"))
    return b.select("vec_id", F.col("b.first").cast("long").alias("first"), F.col("b.last").cast("long").alias("last"))


_BLEND_SQL = {
    "average": "(a + b) / 2", "multiply": "a * b", "screen": "1 - (1 - a) * (1 - b)", "difference": "abs(a - b)", "overlay": "CASE WHEN a < 0.5 THEN 2 * a * b ELSE 1 - 2 * (1 - a) * (1 - b) END", "addition": "least(a + b, 1)", "subtract": "greatest(a - b, 0)",
    "negation": "1 - abs(1 - a - b)", "exclusion": "a + b - 2 * a * b", "darken": "least(a, b)", "phoenix": "least(a, b) - greatest(a, b) + 1", "hardlight": "CASE WHEN b < 0.5 THEN 2 * a * b ELSE 1 - 2 * (1 - a) * (1 - b) END",
    "burn": "CASE WHEN a = 0 THEN a ELSE greatest(0, 1 - (1 - b) / a) END", "dodge": "CASE WHEN a >= 1 THEN a ELSE least(1, b / (1 - a)) END", "divide": "CASE WHEN b = 0 THEN 1 ELSE least(a / b, 1) END", "grainextract": "least(greatest(a - b + 0.5, 0), 1)", "grainmerge": "least(greatest(a + b - 0.5, 0), 1)",
    "pinlight": "CASE WHEN b < 0.5 THEN least(a, 2 * b) ELSE greatest(a, 2 * (b - 0.5)) END", "reflect": "CASE WHEN b >= 1 THEN b ELSE least(1, a * a / (1 - b)) END", "glow": "CASE WHEN a >= 1 THEN a ELSE least(1, b * b / (1 - a)) END",
    "softlight": "CASE WHEN a > 0.5 THEN b + (1 - b) * (a - 0.5) / 0.5 * (0.5 - abs(b - 0.5)) ELSE b - b * ((0.5 - a) / 0.5) * (0.5 - abs(b - 0.5)) END", "linearlight": "least(greatest(CASE WHEN b < 0.5 THEN b + 2 * a - 1 ELSE b + 2 * (a - 0.5) END, 0), 1)",
    "vividlight": "CASE WHEN a < 0.5 THEN CASE WHEN 2 * a = 0 THEN 0 ELSE greatest(0, 1 - (1 - b) / (2 * a)) END ELSE CASE WHEN 2 * (a - 0.5) >= 1 THEN 1 ELSE least(1, b / (1 - 2 * (a - 0.5))) END END", "hardmix": "CASE WHEN a < 1 - b THEN 0 ELSE 1 END",
    "multiply128": "least(greatest((a - 0.5) * b / 0.125 + 0.5, 0), 1)", "heat": "CASE WHEN a = 0 THEN 0 ELSE 1 - least((1 - b) * (1 - b) / a, 1) END", "freeze": "CASE WHEN b = 0 THEN 0 ELSE 1 - least((1 - a) * (1 - a) / b, 1) END", "extremity": "abs(1 - a - b)",
    "softdifference": "least(greatest(CASE WHEN a > b THEN CASE WHEN b >= 1 THEN 0 ELSE (a - b) / (1 - b) END ELSE CASE WHEN b = 0 THEN 0 ELSE (b - a) / b END END, 0), 1)", "geometric": "sqrt(a * b)", "harmonic": "CASE WHEN a = 0 AND b = 0 THEN 0 ELSE 2 * a * b / (a + b) END",
    "bleach": "(1 - b) + (1 - a) - 1", "stain": "2 - a - b", "interpolate": "(2 - cos(a * pi()) - cos(b * pi())) * 0.25", "hardoverlay": "CASE WHEN a >= 1 THEN 1 WHEN a > 0.5 THEN least(1, b / (2 - 2 * a)) ELSE least(1, 2 * a * b) END",
    "and": "(round(a * 255)::INT & round(b * 255)::INT) / 255.0::DOUBLE", "or": "(round(a * 255)::INT | round(b * 255)::INT) / 255.0::DOUBLE", "xor": "xor(round(a * 255)::INT, round(b * 255)::INT) / 255.0::DOUBLE", "normal": "b",
}


@query(
    f"WITH p AS (SELECT vec_id, i AS pos, abs(e[i + 1]) AS a, abs(e[i + 2]) AS b FROM (SELECT *, unnest(range(0, 63)) AS i FROM {_E})) SELECT vec_id, pos, round(a + (greatest(a, b) - a) * 0.5, 9) AS lighten_half, "
    + ", ".join(f'round(({x})::DOUBLE, 9) + 0 AS "{m}"' for m, x in _BLEND_SQL.items())
    + " FROM p"
)
def blend_modes(spark, sf_dir):
    """All forty modes on each component and the next, one of them at half opacity."""
    shifted = F.arrays_zip(F.slice("e", 1, 63).alias("a"), F.slice("e", 2, 63).alias("b"))
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode(shifted).alias("pos", "p")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.abs("p.a").alias("a"), F.abs("p.b").alias("b"))
    a, b = F.col("a"), F.col("b")
    return v.select("vec_id", "pos", F.round(K.blended("lighten", a, b, 0.5), 9).alias("lighten_half"), *[(F.round(K.blended(m, a, b).cast("double"), 9) + 0).alias(m) for m in _BLEND_SQL])


@query(f"SELECT a.vec_id, round((2 * ma * mb + 0.0004) * (2 * (ab - ma * mb) + 0.0036) / ((ma * ma + mb * mb + 0.0004) * (aa - ma * ma + bb - mb * mb + 0.0036)), 9) AS ssim FROM (SELECT a.vec_id, list_avg(a.e) AS ma, list_avg(b.e) AS mb, list_avg(list_transform(a.e, lambda x: x * x)) AS aa, list_avg(list_transform(b.e, lambda x: x * x)) AS bb, list_avg(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS ab FROM {_PAIR}) a")
def ssim(spark, sf_dir):
    """Each vector as a block beside the next."""
    return _pairs(spark, sf_dir).select("vec_id", F.round(K.ssim(F.col("e"), F.col("f"), 2.0), 9).alias("ssim"))


@query(
    f"""WITH c AS (SELECT vec_id, i % 8 AS x, i // 8 AS y FROM (SELECT *, unnest(range(0, 64)) AS i FROM {_E}) WHERE e[i + 1] > 0.2), b AS (SELECT vec_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM c GROUP BY vec_id)
SELECT vec_id, x1, y1, x2, y2 FROM embeddings LEFT JOIN b USING (vec_id)"""
)
def plane_box(spark, sf_dir):
    b = _vectors(spark, sf_dir).select("vec_id", K.bounding_box(F.col("e"), 8, 0.2).alias("b"))
    return b.select("vec_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH w AS (SELECT *, e[greatest(i - 1, 1) : i + 1] AS w FROM (SELECT *, unnest(range(1, 65)) AS i FROM {_E}))
SELECT vec_id, i - 1 AS pos, least(list_max(w), e[i] + 0.05::DOUBLE) AS dilated, greatest(list_min(w), e[i] - 0.05::DOUBLE) AS eroded FROM w"""
)
def limited_morphology(spark, sf_dir):
    """Dilation and erosion that change a value by 0.05 at most."""
    e = F.col("e")
    out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(K.box_extreme(e, 1, True, 0.05).alias("d"), K.box_extreme(e, 1, False, 0.05).alias("m"))).alias("pos", "z"))
    return out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("z.d").alias("dilated"), F.col("z.m").alias("eroded"))


@query(
    """WITH t AS (SELECT event_id AS n, (event_id + 25) % 100 / 100.0::DOUBLE AS t FROM events), d AS (SELECT n, (sin(t * 2 * pi()) + 1) / 2 * 30 - 10 AS s, CASE floor(4 * t) WHEN 0 THEN 2 * t + 0.5 WHEN 3 THEN 2 * t - 1.5 ELSE 1.5 - 2 * t END * 30 - 10 AS tri FROM t)
SELECT n, round(s, 9) AS sine, round(tri, 9) AS triangle, (trunc(round(tri, 9) + CASE WHEN tri < 0 THEN -0.5 ELSE 0.5 END))::BIGINT AS whole, n % 256 % 16 * 4 AS box_x, (n % 256 // 16) * 4 AS box_y FROM d"""
)
def wave_tables(spark, sf_dir):
    """Tables of a sine and a triangle a quarter turn on, whole numbers of the latter, and the places of palette boxes."""
    import math

    n, args = F.col("event_id"), (100, -10.0, 20.0, math.pi / 2)
    box = K.palette_box(n % 256, 4)
    return table(spark, sf_dir, "events").select(n.alias("n"), F.round(K.wave_table(n, *args), 9).alias("sine"), F.round(K.wave_table(n, *args, kind="tri"), 9).alias("triangle"), K.wave_table(n, *args, kind="tri", whole=True).alias("whole"), box["x"].alias("box_x"), box["y"].alias("box_y"))


@query(
    """SELECT p_partkey, p_size * 10 AS width, p_size * 7 + 3 AS height, (round((p_size * 7 + 3) * 640.0::DOUBLE / (p_size * 10) / 2) * 2)::BIGINT AS even_height,
 CASE WHEN p_size > 1.04::DOUBLE * 25 THEN 'tff' WHEN 25 > 1.04::DOUBLE * p_size THEN 'bff' WHEN p_retailprice > 1.5::DOUBLE * greatest(p_size, 25) THEN 'progressive' ELSE 'undetermined' END AS field_order,
 round(least(pow(10, p_size / 20.0::DOUBLE), 1 / (0.01::DOUBLE * p_size)) * p_retailprice, 4) AS loud, p_size + 2 AS qp_last FROM part"""
)
def plane_arithmetic(spark, sf_dir):
    """Scaling to a width with an even height, field order, volume under a peak, and the last value of a table of quantisers."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    to = K.scaled_size(size * 10, size * 7 + 3, 640, -2)
    qp = K.qp_table(size, F.array(*[F.lit(i % 4) for i in range(15)]), 80, 48)
    loud = K.volume(F.col("p_retailprice"), size.cast("double"), None, 0.01 * size.cast("double"))
    return p.select("p_partkey", (size * 10).alias("width"), (size * 7 + 3).alias("height"), to["height"].alias("even_height"), K.field_order(size, F.lit(25), F.col("p_retailprice")).alias("field_order"), F.round(loud, 4).alias("loud"), F.element_at(qp, -1).alias("qp_last"))


@query(
    """WITH p AS (SELECT event_id, value, lag(value, 1) OVER w AS p1, lag(value, 2) OVER w AS p2 FROM (SELECT * FROM events WHERE ts IS NOT NULL) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
d AS (SELECT *, abs(p1 - value) <= 20 AS ok1, abs(p1 - value) <= 20 AND abs(p2 - value) <= 20 AND abs(p1 - value) + abs(p2 - value) <= 30 AS ok2 FROM p WHERE p2 IS NOT NULL)
SELECT event_id, round((value + CASE WHEN ok1 THEN p1 ELSE 0 END + CASE WHEN ok2 THEN p2 ELSE 0 END) / (1 + ok1::INT + ok2::INT), 9) AS value FROM d"""
)
def temporal_denoise(spark, sf_dir):
    """A row averaged with the two before it while they differ by little."""
    from lumenflow.plans.streams import BY_TYPE

    e = BY_TYPE.annotated(table(spark, sf_dir, "events"), before={"p1": ("value", 1), "p2": ("value", 2)}).where("p2 IS NOT NULL")
    return e.select("event_id", F.round(K.denoised(F.array("value", "p1", "p2"), 0, 20.0, 30.0), 9).alias("value"))


@query(
    f"""WITH p AS (SELECT vec_id, i AS pos, e[i + 1] AS l, e[i + 2] AS r, e[i + 3] AS b FROM (SELECT *, unnest(range(0, 62)) AS i FROM {_E}))
SELECT vec_id, pos, least(greatest((l + r) / 2 + 2.5 * (l - (l + r) / 2), -1), 1)::DOUBLE AS "left", least(greatest((l + r) / 2 + 2.5 * (r - (l + r) / 2), -1), 1)::DOUBLE AS "right",
 greatest(l, r, b) AS max_norm, sqrt(l * l + r * r + b * b) AS l2, 0.2126::DOUBLE * l + 0.7152::DOUBLE * r + 0.0722::DOUBLE * b AS luminance FROM p"""
)
def extrastereo_norms(spark, sf_dir):
    """On each component and the two behind it."""
    three = F.arrays_zip(*[F.slice("e", i + 1, 62).alias(n) for i, n in enumerate("lrb")])
    v = _vectors(spark, sf_dir).select("vec_id", F.posexplode(three).alias("pos", "p")).select("vec_id", F.col("pos").cast("long").alias("pos"), "p.*")
    s, n = K.stereo_widened(F.col("l"), F.col("r")), K.colour_norms(F.col("l"), F.col("r"), F.col("b"))
    return v.select("vec_id", "pos", s.alias("s"), n.alias("n")).select("vec_id", "pos", F.col("s.left").alias("left"), F.col("s.right").alias("right"), F.col("n.max").alias("max_norm"), F.col("n.l2").alias("l2"), F.col("n.luminance").alias("luminance"))


@query(
    f"""WITH p(i, c) AS (SELECT i, list_transform(range(0, 64), lambda k: ((i * 7 + k * 3) % 11 - 5) / 20.0::DOUBLE) FROM range(8) t(i)),
d AS (SELECT v.vec_id, p.i, round(list_sum(list_transform(list_zip(v.e, p.c), lambda q: (q[1] - q[2]) ** 2)), 9) AS d FROM {_E} v, p)
SELECT vec_id, min_by(i, (d, i)) AS nearest FROM d GROUP BY vec_id"""
)
def palette_nearest(spark, sf_dir):
    palette = [[((i * 7 + k * 3) % 11 - 5) / 20.0 for k in range(64)] for i in range(8)]
    return K.nearest(_vectors(spark, sf_dir), palette, "e").select("vec_id", "nearest")


@query("SELECT event_type, round(sum(value * k) / sum(k * k), 9) AS c_k FROM (SELECT *, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) GROUP BY event_type")
def lls_1var(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return K.least_squares(e, "value", ["k"], ["event_type"]).select("event_type", F.round("c_k", 9).alias("c_k"))


@query(
    """WITH s AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) AS bb, sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS sby, l_returnflag FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, round((ay * bb - sby * ab) / (aa * bb - ab * ab), 4) AS c_l_quantity, round((sby * aa - ay * ab) / (aa * bb - ab * ab), 4) AS c_l_discount FROM s"""
)
def lls_2var(spark, sf_dir):
    out = K.least_squares(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    return out.select("l_returnflag", F.round("c_l_quantity", 4).alias("c_l_quantity"), F.round("c_l_discount", 4).alias("c_l_discount"))


_COVARIANCE = f"SELECT i, j, round(covar_pop(e[i + 1], e[j + 1]), 9) + 0 AS cov FROM {_E}, range(64) a(i), range(64) b(j) WHERE i <= j GROUP BY i, j"


@query(_COVARIANCE)
@query(_COVARIANCE, "covariance_whole")
def covariance(spark, sf_dir):
    """Over all 64 components."""
    return K.covariance(_vectors(ship_package(spark), sf_dir), "e", 64).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), (F.round("cov", 9) + 0).alias("cov"))


@query()
def principal_components(spark, sf_dir):
    """The components of all vectors by size; their signs are free, so there is no SQL: tests hold them against the covariance matrix."""
    values, vectors = K.principal_components(_vectors(ship_package(spark), sf_dir), "e", 64)
    return spark.createDataFrame([(i, float(v), list(map(float, x))) for i, (v, x) in enumerate(zip(values, vectors, strict=True))], "component int, variance double, vector array<double>")


@query(f"SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.e, lambda x: x * x)) / 64 - (list_sum(a.e) / 64) ** 2), 9) AS si, round(sqrt(greatest(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[2] - p[1]) ** 2)) / 64 - (list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[2] - p[1])) / 64) ** 2, 0)), 9) AS ti FROM {_PAIR}")
def siti(spark, sf_dir):
    """Spread of a plane, and of its change to the next."""
    spread = lambda a: F.sqrt(F.greatest(K.total(F.transform(a, lambda x: x * x)) / 64 - (K.total(a) / 64) * (K.total(a) / 64), F.lit(0.0)))
    change = F.zip_with("e", "f", lambda x, y: y - x)
    return _pairs(spark, sf_dir).select("vec_id", F.round(spread(F.col("e")), 9).alias("si"), F.round(spread(change), 9).alias("ti"))


@query("SELECT event_id, round((2 * t * t * t - 3 * t * t + 1) * 1 + (t * t * t - 2 * t * t + t) * 2 * 0.5 + (-2 * t * t * t + 3 * t * t) * 3 + (t * t * t - t * t) * 2 * -1, 9) AS y FROM (SELECT event_id, least(value / 250, 1.0::DOUBLE) AS t FROM events)")
def hermite(spark, sf_dir):
    """A cubic with given ends and tangents, at each event's value."""
    x = F.least(F.col("value") / 250, F.lit(1.0)) * 2
    lits = [F.lit(float(v)) for v in (0, 2, 1, 3, 0.5, -1)]
    return table(spark, sf_dir, "events").select("event_id", F.round(K.hermite(x, *lits), 9).alias("y"))


@query(
    """WITH s AS (SELECT l_returnflag, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS cy
FROM (SELECT l_returnflag, l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)
SELECT l_returnflag, round((ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det, 3) AS c_quantity,
 round((aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det, 3) AS c_discount, round((aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det, 3) AS c_tax FROM d"""
)
def lls_3var(spark, sf_dir):
    """Least squares in three variables, without an intercept."""
    out = K.least_squares(table(ship_package(spark), sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(f"c_l_{c}", 3).alias(f"c_{c}") for c in ("quantity", "discount", "tax")])


@query()
def noise(spark, sf_dir):
    """Events with seeded noise, uniform and Gaussian, which depend on the event's id alone; SQL hasn't the hash, so tests look at the distributions."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("value") + K.uniform_noise(F.col("event_id"), 7)).alias("uniform"), (F.col("value") + K.gaussian_noise(F.col("event_id"), 7)).alias("gaussian"))
