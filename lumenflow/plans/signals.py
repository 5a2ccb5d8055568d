"""Queries of filters, loudness, resampling, dynamics and mixing over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import signals as S
from lumenflow.operators.streams import Stream
from lumenflow.registry import query
from lumenflow.session import ship_package, table

BY_TYPE = Stream(("event_type",))
_E = "(SELECT * FROM events WHERE ts IS NOT NULL)"
_W = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_NUMBERED = f"n AS MATERIALIZED (SELECT event_type, event_id, value, value / 250 AS x, row_number() {_W} - 1 AS n FROM {_E})"


def _events(spark, sf_dir):
    ship_package(spark)
    return table(spark, sf_dir, "events")


def _filter_sql(name: str, source: str = "n") -> str:
    """The K-weighted samples of n(event_type, n, x) by a recursion over their numbers."""
    (b0, b1, b2, a1, a2), (_, _, _, c1, c2) = S.loudness_sections()
    z, y = "z.y - 2 * z.y1 + z.y2", f"{b0!r}::DOUBLE * x + {b1!r}::DOUBLE * x1 + {b2!r}::DOUBLE * x2 - {a1!r}::DOUBLE * y1 - {a2!r}::DOUBLE * y2"
    return f"""{name} AS (SELECT event_type, n, x, 0.0::DOUBLE AS x1, {b0!r}::DOUBLE * x AS y, 0.0::DOUBLE AS y1, {b0!r}::DOUBLE * x AS z, 0.0::DOUBLE AS z1 FROM {source} WHERE n = 0
UNION ALL SELECT event_type, n, x, x1, y, y1, y - 2 * y1 + y2 - {c1!r}::DOUBLE * z1 - {c2!r}::DOUBLE * z2, z1 FROM (
  SELECT *, {y} AS y FROM (SELECT s.event_type, s.n, s.x, r.x AS x1, r.x1 AS x2, r.y AS y1, r.y1 AS y2, r.z AS z1, r.z1 AS z2 FROM {name} r JOIN {source} s ON s.event_type = r.event_type AND s.n = r.n + 1)))"""


_WINDOWS = f"""{_NUMBERED}, {_filter_sql("f")},
h AS (SELECT event_type, n // 10 AS hop, sum(z * z) AS e, max(abs(x)) AS peak FROM f GROUP BY ALL HAVING count(*) = 10),
w AS (SELECT *, CASE WHEN hop >= 3 THEN sum(e) OVER (o ROWS 3 PRECEDING) / 40 END AS momentary, CASE WHEN hop >= 29 THEN sum(e) OVER (o ROWS 29 PRECEDING) / 300 END AS short FROM h WINDOW o AS (PARTITION BY event_type ORDER BY hop))"""


def _windows(spark, sf_dir):
    return S.loudness_windows(_events(spark, sf_dir).withColumn("x", F.col("value") / 250), BY_TYPE, "x", 10)


@query(f"WITH RECURSIVE {_NUMBERED}, {_filter_sql('f')} SELECT event_id, round(z, 6) + 0 AS weighted FROM f JOIN n USING (event_type, n)")
def loudness_filter(spark, sf_dir):
    """Samples behind the two filters of the loudness measure."""
    e = _events(spark, sf_dir).withColumn("x", F.col("value") / 250)
    return S.section_filtered(e, BY_TYPE, "x", S.loudness_sections(), "z").select("event_id", (F.round("z", 6) + 0).alias("weighted"))


@query(f"WITH RECURSIVE {_WINDOWS} SELECT event_type, hop, peak, round(momentary, 6) AS momentary, round(short, 6) AS short FROM w")
def loudness_windows(spark, sf_dir):
    """Energy of the last 4 and 30 hops of ten rows, hop by hop."""
    return _windows(spark, sf_dir).select("event_type", "hop", "peak", F.round("momentary", 6).alias("momentary"), F.round("short", 6).alias("short"))


@query(
    f"""WITH RECURSIVE {_WINDOWS}, l AS (SELECT *, -0.691 + 10 * log10(momentary) AS level FROM w WHERE momentary IS NOT NULL), a AS (SELECT * FROM l WHERE level > -70),
m AS (SELECT event_type, avg(momentary) AS mean FROM a GROUP BY 1), g AS (SELECT a.* FROM a JOIN m USING (event_type) WHERE level > -0.691 + 10 * log10(mean) - 10),
i AS (SELECT event_type, round(-0.691 + 10 * log10(avg(momentary)), 6) AS integrated, count(*) AS windows FROM g GROUP BY 1), p AS (SELECT event_type, max(peak) AS peak FROM w GROUP BY 1)
SELECT event_type, peak, integrated, windows FROM p LEFT JOIN i USING (event_type)"""
)
def loudness(spark, sf_dir):
    """Gated loudness of each stream, with its peak and how many windows pass both gates."""
    return S.loudness(_windows(spark, sf_dir), ["event_type"]).withColumn("integrated", F.round("integrated", 6))


_UP, _DOWN, _WIDTH = 3, 2, 8


@query(
    f"""WITH {_NUMBERED}, o AS (SELECT event_type, unnest(range(0, (max(n) + 1) * {_UP} // {_DOWN} + 2)) AS m, max(n) AS last FROM n GROUP BY event_type),
p AS (SELECT *, m * {_DOWN} // {_UP} AS c, m * {_DOWN} / {_UP}::DOUBLE AS t FROM o WHERE m * {_DOWN} // {_UP} <= last),
k AS (SELECT event_type, m, n.value, p.t - n.n AS d FROM p JOIN n USING (event_type) WHERE n.n BETWEEN p.c - {_WIDTH - 1} AND p.c + {_WIDTH}),
t AS (SELECT *, least(1.0::DOUBLE, {_UP}.0::DOUBLE / {_DOWN}) AS cut FROM k)
SELECT event_type, m, round(sum(value * cut * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * cut * d) / (pi() * cut * d) END * cos(pi() * d / {2 * _WIDTH}) ** 2), 6) + 0 AS sample FROM t GROUP BY event_type, m"""
)
def resample_up(spark, sf_dir):
    """Each stream at three samples for two."""
    return S.rate_changed(_events(spark, sf_dir), BY_TYPE, "value", _UP, _DOWN, _WIDTH).withColumn("sample", F.round("sample", 6) + 0)


@query(
    f"""WITH {_NUMBERED}, o AS (SELECT event_type, unnest(range(0, (max(n) + 1) * 2 // 5 + 2)) AS m, max(n) AS last FROM n GROUP BY event_type),
p AS (SELECT *, m * 5 // 2 AS c, m * 5 / 2.0::DOUBLE AS t FROM o WHERE m * 5 // 2 <= last),
k AS (SELECT event_type, m, n.value, p.t - n.n AS d, 0.4::DOUBLE AS cut FROM p JOIN n USING (event_type) WHERE n.n BETWEEN p.c - 11 AND p.c + 12)
SELECT event_type, m, round(sum(value * cut * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * cut * d) / (pi() * cut * d) END * cos(pi() * d / 24) ** 2), 6) + 0 AS sample FROM k GROUP BY event_type, m"""
)
def resample_down(spark, sf_dir):
    """Each stream at two samples for five, with the band cut to match."""
    return S.rate_changed(_events(spark, sf_dir), BY_TYPE, "value", 2, 5, 12).withColumn("sample", F.round("sample", 6) + 0)


# The compander's curve (decibels in, out).
CURVE = ((-80.0, -80.0), (-9.0, -9.0), (0.0, -5.3), (20.0, 2.9))
_CURVE_SQL = "CASE WHEN db < -9 THEN db WHEN db < 0 THEN -9.0::DOUBLE + (db + 9) * (3.7::DOUBLE / 9) ELSE -5.3::DOUBLE + db * (8.2::DOUBLE / 20) END"


@query(
    f"""WITH RECURSIVE {_NUMBERED}, r AS (SELECT event_type, n, x, CASE WHEN abs(x) > 0 THEN 0.3::DOUBLE * abs(x) ELSE 0.0::DOUBLE END AS env FROM n WHERE n = 0
UNION ALL SELECT s.event_type, s.n, s.x, r.env + CASE WHEN abs(s.x) > r.env THEN 0.3::DOUBLE ELSE 0.02::DOUBLE END * (abs(s.x) - r.env) FROM r JOIN n s ON s.event_type = r.event_type AND s.n = r.n + 1),
d AS (SELECT *, CASE WHEN env > 0 THEN 20 * log10(env) END AS db FROM r)
SELECT event_id, round(env, 6) AS envelope, round(CASE WHEN env > 0 THEN d.x * 10 ** (({_CURVE_SQL} - db) / 20) ELSE d.x END, 6) + 0 AS companded FROM d JOIN n USING (event_type, n)"""
)
def compand(spark, sf_dir):
    """A compander: an envelope with attack and decay, and a curve of gains over it."""
    e = _events(spark, sf_dir).withColumn("x", F.col("value") / 250)
    out = S.companded(e, BY_TYPE, "x", 0.3, 0.02, CURVE)
    return out.select("event_id", F.round("envelope", 6).alias("envelope"), (F.round("companded", 6) + 0).alias("companded"))


@query(
    f"""WITH RECURSIVE {_NUMBERED}, p AS MATERIALIZED (SELECT event_type, event_id, n, value, max(abs(value)) OVER (PARTITION BY event_type ORDER BY n ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS peak FROM n),
r AS (SELECT event_type, n, peak AS env FROM p WHERE n = 0 UNION ALL SELECT s.event_type, s.n, greatest(s.peak, r.env * (1 - 0.05::DOUBLE)) FROM r JOIN p s ON s.event_type = r.event_type AND s.n = r.n + 1)
SELECT event_id, round(value * CASE WHEN env > 80 THEN 80 / env ELSE 1 END, 6) + 0 AS limited FROM r JOIN p USING (event_type, n)"""
)
def limiter(spark, sf_dir):
    """A limiter that looks five rows ahead and recovers by a twentieth a row."""
    return S.limited(_events(spark, sf_dir), BY_TYPE, "value", 80.0, 5, 0.05).select("event_id", (F.round("limited", 6) + 0).alias("limited"))


@query("SELECT date_trunc('hour', ts) AS hour, coalesce(avg(value) FILTER (event_type = 'click'), 0) * 0.7 + coalesce(avg(value) FILTER (event_type = 'view'), 0) * 0.3 AS \"left\", coalesce(avg(value) FILTER (event_type = 'view'), 0) * 0.7 - coalesce(avg(value) FILTER (event_type = 'click'), 0) * 0.3 AS \"right\" FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def channel_pan(spark, sf_dir):
    """Two output channels as mixes of two input channels, by a matrix."""
    e = _events(spark, sf_dir).where(F.col("event_type").isin("click", "view"))
    means = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.avg("value").alias("v"))
    matrix = spark.createDataFrame([("left", "click", 0.7), ("left", "view", 0.3), ("right", "view", 0.7), ("right", "click", -0.3)], "out string, in string, gain double")
    return S.mixed(means, ["hour"], "event_type", "v", matrix).groupBy("hour").pivot("out", ["left", "right"]).agg(F.first("value"))


_MAP = "SELECT i AS out, (i + 3) % 8 AS \"in\", 1.0::DOUBLE AS gain FROM range(8) t(i) UNION ALL SELECT 8, i, 0.125::DOUBLE FROM range(8) t(i)"


@query(
    f"""WITH m AS ({_MAP}), c AS (SELECT user_id, epoch_us(ts) // 3600000000 % 8 AS channel, sum(value) AS v FROM {_E} GROUP BY ALL)
SELECT user_id, out, round(sum(v * gain), 6) AS value FROM c JOIN m ON c.channel = m.in GROUP BY user_id, out"""
)
def channel_map(spark, sf_dir):
    """Eight channels in another order, and their mean as a ninth."""
    e = _events(spark, sf_dir).where("ts IS NOT NULL")
    channel = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000 % 8")
    c = e.groupBy("user_id", channel.alias("channel")).agg(F.sum("value").alias("v"))
    rows = [(i, (i + 3) % 8, 1.0) for i in range(8)] + [(8, i, 0.125) for i in range(8)]
    return S.mixed(c, ["user_id"], "channel", "v", spark.createDataFrame(rows, "out long, in long, gain double")).withColumn("value", F.round("value", 6))


@query(
    f"""WITH r AS (SELECT event_type, value, row_number() {_W} - 1 AS n FROM {_E}), p AS (SELECT n, max(value) FILTER (event_type = 'click') AS a, max(value) FILTER (event_type = 'purchase') AS b,
max(value) FILTER (event_type = 'signup') AS c, max(value) FILTER (event_type = 'view') AS d FROM r WHERE event_type IN ('click', 'purchase', 'signup', 'view') GROUP BY n HAVING count(*) = 4)
SELECT n, CASE WHEN a <= b THEN c ELSE d END AS out FROM p"""
)
def threshold_streams(spark, sf_dir):
    """Four streams aligned by number: the third's value where the first is at most the second, else the fourth's."""
    e = _events(spark, sf_dir)
    own = [e.where(F.col("event_type") == t) for t in ("click", "purchase", "signup", "view")]
    return S.threshold_streams(*own, BY_TYPE, "value")
