"""Timed-stream queries over events: a stream is the rows of one event type or user."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import kernels as K
from lumenflow.operators import streams as T
from lumenflow.operators.signals import clock_filtered, decimated
from lumenflow.operators.timing import exact_quantiles
from lumenflow.registry import query
from lumenflow.session import table

BY_TYPE = T.Stream(("event_type",))
BY_USER = T.Stream(("user_id",))
_N = "(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)"
_W = "OVER (PARTITION BY event_type ORDER BY ts, event_id)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"SELECT event_id, event_type FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)) WHERE n % 5 = 0")
def framestep(spark, sf_dir):
    return T.every_nth(_events(spark, sf_dir), BY_TYPE, 5).select("event_id", "event_type")


@query(f"SELECT event_id, n FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)) WHERE n >= 100 AND n < 250")
def trim_index(spark, sf_dir):
    e = T.trim_index(_events(spark, sf_dir), BY_TYPE, 100, 250)
    return BY_TYPE.numbered(e, "n").select("event_id", (F.col("n") + 100).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-07 00:00:00'")
def trim_time(spark, sf_dir):
    return T.trim_time(_events(spark, sf_dir), BY_TYPE, "2024-01-05 06:00:00", "2024-01-07 00:00:00").select("event_id", "event_type")


@query(f"SELECT event_id, trunc({_N} * 28.93::DOUBLE)::BIGINT AS pts FROM (SELECT * FROM events WHERE ts IS NOT NULL)")
def setpts(spark, sf_dir):
    return T.retimed(_events(spark, sf_dir), BY_TYPE, 28.93).select("event_id", "pts")


@query(
    """WITH p AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000000 AS pts FROM (SELECT * FROM events WHERE ts IS NOT NULL)),
d AS (SELECT *, pts - lag(pts) OVER w AS delta FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT *, lag(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pd FROM d WHERE delta IS NOT NULL),
f AS (SELECT *, CASE WHEN pd IS NOT NULL AND delta <> pd THEN 1 ELSE 0 END AS chg FROM e)
SELECT user_id, sum(chg)::BIGINT AS vfr, (count(*) - sum(chg))::BIGINT AS cfr, min(delta) AS min_delta, max(delta) AS max_delta,
 (sum(CASE WHEN chg = 1 THEN delta END) // nullif(sum(chg), 0))::BIGINT AS avg_delta FROM f GROUP BY user_id"""
)
def vfrdet(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("pts", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    return T.rate_report(e, BY_USER, "pts")


@query("SELECT event_id, CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END::BIGINT AS out_pad FROM events WHERE value <> 0")
def select_route(spark, sf_dir):
    """An expression's value is the output; 0 in the first predicate drops."""
    pad = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    return _events(spark, sf_dir).where("value <> 0").select("event_id", pad.cast("long").alias("out_pad"))


@query(f"SELECT event_type, n // 7 AS chunk, count(*) AS rows, min(ts) AS first_ts FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)) GROUP BY ALL")
def rechunk(spark, sf_dir):
    return T.chunked(_events(spark, sf_dir), BY_TYPE, 7).groupBy("event_type", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"))


@query(f"SELECT event_type, n // 4 AS tile, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS ids FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)) GROUP BY ALL")
def tile(spark, sf_dir):
    t = T.tiled(_events(spark, sf_dir), BY_TYPE, 4, "event_id")
    return t.select("event_type", "tile", F.array_join(F.transform("tiles", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"SELECT event_type, event_id, n // 4 AS tile, n % 4 AS pos FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL))")
def untile(spark, sf_dir):
    t = T.untiled(T.tiled(_events(spark, sf_dir), BY_TYPE, 4, "event_id"), ["event_type"], "tiles", "event_id")
    return t.select("event_type", "event_id", "tile", F.col("pos").cast("long").alias("pos"))


@query(
    f"""WITH r AS (SELECT *, {_N} AS n, count(*) OVER (PARTITION BY event_type) AS total FROM (SELECT * FROM events WHERE ts IS NOT NULL))
SELECT event_id, (n // 4) * 3 + CASE n % 4 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS n FROM r WHERE n % 4 <> 1 AND (n // 4 + 1) * 4 <= total"""
)
def shuffleframes(spark, sf_dir):
    """The third, first and fourth of each four rows; the second is dropped, and so is a short last block."""
    return T.shuffled_frames(_events(spark, sf_dir), BY_TYPE, [2, 0, -1, 3]).select("event_id", "n")


@query(
    f"""WITH r AS (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)), t AS (SELECT *, unnest(CASE WHEN n BETWEEN 5 AND 9 THEN range(0, 3) ELSE [0] END) AS k FROM r)
SELECT event_type, event_id, CASE WHEN n BETWEEN 5 AND 9 THEN n + k * 5 WHEN n >= 10 THEN n + 10 ELSE n END AS n FROM t"""
)
def loop(spark, sf_dir):
    return T.looped(_events(spark, sf_dir), BY_TYPE, 5, 5, 2).select("event_type", "event_id", "n")


@query(f"WITH r AS (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL)) SELECT event_type, event_id, n + k AS n FROM (SELECT *, unnest(CASE WHEN n = 0 THEN range(0, 4) ELSE [3] END) AS k FROM r)")
def pad_start(spark, sf_dir):
    return T.padded(_events(spark, sf_dir), BY_TYPE, 3).select("event_type", "event_id", "n")


@query(
    """WITH p AS (SELECT event_id, event_type, epoch_us(ts) AS pts FROM (SELECT * FROM events WHERE ts IS NOT NULL)), s AS (SELECT event_type, min(pts) AS a, max(pts) - min(pts) AS len FROM p GROUP BY event_type),
o AS (SELECT event_type, a, coalesce(sum(len) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT event_id, (pts - a + off)::BIGINT AS out_pts FROM p JOIN o USING (event_type)"""
)
def concat(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("pts"))
    return T.concatenated(e, "event_type", "pts").select("event_id", "out_pts")


@query(
    """WITH a AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n, value FROM (SELECT * FROM events WHERE ts IS NOT NULL) WHERE event_type = 'click'), b AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS n, value FROM (SELECT * FROM events WHERE ts IS NOT NULL) WHERE event_type = 'view')
SELECT a.n, a.value AS first, b.value AS second FROM a JOIN b USING (n)"""
)
def hstack(spark, sf_dir):
    e = _events(spark, sf_dir)
    return T.stacked(e.where("event_type = 'click'"), e.where("event_type = 'view'"), BY_TYPE, "value")


@query(
    """SELECT m.event_id, s.value AS last_view FROM (SELECT * FROM (SELECT * FROM events WHERE ts IS NOT NULL) WHERE event_type = 'purchase') m
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM (SELECT * FROM events WHERE ts IS NOT NULL) WHERE event_type = 'view' GROUP BY user_id, ts) s ON m.user_id = s.user_id AND m.ts >= s.ts"""
)
def overlay_asof(spark, sf_dir):
    e = _events(spark, sf_dir)
    return T.asof(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), BY_USER, "value", "last_view").select("event_id", "last_view")


_GRID = """WITH x AS (SELECT *, lead(ts) OVER w AS nt, lead(value) OVER w AS nv, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id DESC) AS r FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
g AS (SELECT event_type, unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 6 HOUR)) AS ts FROM events GROUP BY event_type)"""


@query(
    _GRID
    + """ SELECT g.event_type, g.ts, x.value AS held, coalesce(x.value + (x.nv - x.value) * ((epoch_us(g.ts) - epoch_us(x.ts))::DOUBLE / nullif(epoch_us(x.nt) - epoch_us(x.ts), 0)), x.value) AS interpolated
FROM g ASOF LEFT JOIN (SELECT * FROM x WHERE r = 1) x ON g.event_type = x.event_type AND g.ts >= x.ts"""
)
def fps_resample(spark, sf_dir):
    return T.resampled(_events(spark, sf_dir), BY_TYPE, "6 hours", "value")


@query(
    f"""WITH a AS (SELECT *, abs(value - lag(value) {_W}) AS mafd FROM (SELECT * FROM events WHERE ts IS NOT NULL)), b AS (SELECT *, lag(mafd) {_W} AS pm FROM a)
SELECT event_id, mafd, CASE WHEN pm IS NOT NULL THEN least(mafd, abs(mafd - pm)) END AS score FROM b"""
)
def scdet(spark, sf_dir):
    return T.scene_scores(_events(spark, sf_dir), BY_TYPE, "value").select("event_id", "mafd", "score")


@query(
    f"""WITH s AS (SELECT *, value < 15 AS q FROM (SELECT * FROM events WHERE ts IS NOT NULL)), g AS (SELECT *, row_number() {_W} - row_number() OVER (PARTITION BY event_type, q ORDER BY ts, event_id) AS grp FROM s)
SELECT event_type, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM g WHERE q GROUP BY event_type, grp HAVING count(*) >= 3"""
)
def silencedetect(spark, sf_dir):
    return T.runs_where(_events(spark, sf_dir), BY_TYPE, F.col("value") < 15, 3)


@query(
    f"""WITH a AS (SELECT *, CASE WHEN abs(value - lag(value) {_W}) <= 5 THEN 0 ELSE 1 END AS new FROM (SELECT * FROM events WHERE ts IS NOT NULL)), g AS (SELECT *, sum(new) {_W} AS grp FROM a)
SELECT event_type, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM g GROUP BY event_type, grp HAVING count(*) >= 2"""
)
def freezedetect(spark, sf_dir):
    return T.frozen(_events(spark, sf_dir), BY_TYPE, "value", 5.0, 2)


@query(
    """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM (SELECT * FROM events WHERE ts IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM a)
SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) AS rows FROM g GROUP BY user_id, session"""
)
def discontinuity_sessions(spark, sf_dir):
    return T.sessions(_events(spark, sf_dir), BY_USER, 7200)


@query(
    """WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM (SELECT * FROM events WHERE ts IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM a) SELECT user_id, run, min(event_type) AS event_type, count(*) AS length FROM g GROUP BY user_id, run"""
)
def run_lengths(spark, sf_dir):
    return T.run_lengths(_events(spark, sf_dir), BY_USER, "event_type")


@query(f"SELECT event_id, min(value) {_W} AS low, max(value) {_W} AS high FROM (SELECT * FROM events WHERE ts IS NOT NULL)")
def cropdetect(spark, sf_dir):
    """The running bounds of a stream's values."""
    return BY_TYPE.annotated(_events(spark, sf_dir), sums={"low": (F.col("value"), "min"), "high": (F.col("value"), "max")}).select("event_id", "low", "high")


@query(f"SELECT event_id, sum(value::DECIMAL(18,4)) {_W}::DOUBLE AS total FROM (SELECT * FROM events WHERE ts IS NOT NULL)")
def running_total(spark, sf_dir):
    out = BY_TYPE.running(_events(spark, sf_dir), F.col("value").cast("decimal(18,4)"), "total")
    return out.select("event_id", F.col("total").cast("double").alias("total"))


@query(
    f"""WITH r AS (SELECT *, {_N} // 100 AS chunk FROM (SELECT * FROM events WHERE ts IS NOT NULL)), m AS (SELECT event_type, chunk, avg(value) AS m FROM r GROUP BY ALL)
SELECT event_type, chunk, min_by(event_id, (round(abs(value - m), 9), event_id)) AS event_id FROM r JOIN m USING (event_type, chunk) GROUP BY ALL"""
)
def thumbnail(spark, sf_dir):
    return T.representatives(_events(spark, sf_dir), BY_TYPE, 100, "value", "event_id")


_ORDERED = "n AS MATERIALIZED (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS pts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL)"


@query(
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, n, event_id, value AS last, true AS kept FROM n WHERE n = 1
UNION ALL SELECT n.user_id, n.n, n.event_id, CASE WHEN abs(n.value - r.last) > 20 THEN n.value ELSE r.last END, abs(n.value - r.last) > 20 FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1)
SELECT event_id FROM r WHERE kept"""
)
def mpdecimate(spark, sf_dir):
    """Rows unlike the last kept row; the state runs through each user's stream."""
    from lumenflow.session import ship_package

    ship_package(spark)
    return decimated(_events(spark, sf_dir), BY_USER, "value", 20.0).select("event_id")


@query(
    f"""WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, n, event_id, pts AS cycle, 3600.0::DOUBLE AS duration FROM n WHERE n = 1
UNION ALL SELECT n.user_id, n.n, n.event_id, r.cycle + r.duration + greatest(0.1::DOUBLE, 1.0::DOUBLE / n.n) * (n.pts - (r.cycle + r.duration)), r.duration + 0.01::DOUBLE * (n.pts - (r.cycle + r.duration)) FROM r JOIN n ON n.user_id = r.user_id AND n.n = r.n + 1)
SELECT event_id, round(cycle, 3) AS smoothed FROM r"""
)
def clock_filter(spark, sf_dir):
    """A delay-locked loop over each user's times in seconds."""
    from lumenflow.session import ship_package

    ship_package(spark)
    e = _events(spark, sf_dir).withColumn("pts", F.expr("unix_micros(cast(ts as timestamp)) / 1e6"))
    return clock_filtered(e, BY_USER, "pts", 3600.0, 0.1, 0.01).select("event_id", F.round("smoothed", 3).alias("smoothed"))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN value * 2 ELSE value END AS value FROM events")
def timeline_enable(spark, sf_dir):
    on = (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return _events(spark, sf_dir).select("event_id", F.when(on, F.col("value") * 2).otherwise(F.col("value")).alias("value"))


@query("SELECT event_type, min(value) AS low, quantile_cont(value, 0.1) AS p10, avg(value) AS mean, quantile_cont(value, 0.9) AS p90, max(value) AS high FROM events GROUP BY event_type")
def signalstats(spark, sf_dir):
    """Exact quantiles by two counts, as no task may hold all values of a stream."""
    e = _events(spark, sf_dir)
    plain = e.groupBy("event_type").agg(F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return plain.join(exact_quantiles(e, "event_type", "value", {"p10": 0.1, "p90": 0.9}), "event_type")


@query("SELECT event_type, least(greatest(floor(value / 10), 0), 15)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL")
def histogram(spark, sf_dir):
    bin_ = F.least(F.greatest(F.floor(F.col("value") / 10), F.lit(0)), F.lit(15))
    return _events(spark, sf_dir).groupBy("event_type", bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, round(corr(value, json_extract_string(props, '$.k')::DOUBLE), 6) AS phase FROM events GROUP BY ALL HAVING count(*) >= 3")
def phase_meter(spark, sf_dir):
    """Correlation of two channels; streams of a single row are left out before it, as they have none."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = _events(spark, sf_dir).select("user_id", "value", k.alias("k"))
    many = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").drop("n")
    return e.join(many, "user_id").groupBy("user_id").agg(F.round(F.corr("value", "k"), 6).alias("phase"))


@query("SELECT date_trunc('day', ts) AS segment, min(ts) AS start, max(ts) AS \"end\", count(*) AS rows, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1")
def segment_manifest(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("segment")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query(
    """SELECT event_type, w AS start, count(*) AS rows, sum((value * value)::DECIMAL(28,6))::DOUBLE AS energy FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) GROUP BY ALL"""
)
def sliding_energy(spark, sf_dir):
    """Energy in windows of 3 hours that begin each hour."""
    e = _events(spark, sf_dir).groupBy("event_type", F.window("ts", "3 hours", "1 hour").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("value") * F.col("value")).cast("decimal(28,6)")).cast("double").alias("energy")).select("event_type", F.col("w.start").alias("start"), "rows", "energy")


@query(
    f"""WITH a AS (SELECT *, value + 0.5 * coalesce(lag(value) {_W}, 0) AS echo, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL))
SELECT event_id, echo, CASE WHEN abs(value) < 10 THEN 0 ELSE value END AS gated, least(greatest(value, -80.0), 80.0)::DOUBLE AS limited, value * least(n / 100.0::DOUBLE, 1.0) AS faded FROM a"""
)
def dynamics(spark, sf_dir):
    """Echo of the row before, gate, limiter and fade-in."""
    e = BY_TYPE.annotated(_events(spark, sf_dir), before={"before": ("value", 1)}, sums={"n": (F.lit(1), "sum")}).withColumn("n", F.col("n") - 1)
    v = F.col("value")
    return e.select("event_id", (v + 0.5 * F.coalesce("before", F.lit(0.0))).alias("echo"), F.when(F.abs(v) < 10, 0.0).otherwise(v).alias("gated"), F.least(F.greatest(v, F.lit(-80.0)), F.lit(80.0)).alias("limited"), (v * F.least(F.col("n") / F.lit(100.0), F.lit(1.0))).alias("faded"))


@query("SELECT user_id, max(delta) AS longest, min(delta) AS shortest FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS delta FROM (SELECT * FROM events WHERE ts IS NOT NULL)) WHERE delta > 0 GROUP BY user_id")
def latency(spark, sf_dir):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = BY_USER.previous(_events(spark, sf_dir), before="ts").withColumn("delta", us("ts") - us("before")).where("delta > 0")
    return d.groupBy("user_id").agg(F.max("delta").alias("longest"), F.min("delta").alias("shortest"))


@query(f"SELECT event_id, n % 2 = 0 AS top_field, total - 1 - n AS flipped FROM (SELECT *, {_N} AS n, count(*) OVER (PARTITION BY event_type) AS total FROM (SELECT * FROM events WHERE ts IS NOT NULL))")
def fields_and_flip(spark, sf_dir):
    """Which field a row belongs to, and its place in the reversed stream."""
    e = BY_TYPE.numbered(_events(spark, sf_dir), "n")
    total = e.groupBy("event_type").agg((F.max("n") + 1).alias("total"))
    return e.join(total, "event_type").select("event_id", (F.col("n") % 2 == 0).alias("top_field"), (F.col("total") - 1 - F.col("n")).alias("flipped"))


@query(f"SELECT event_id, round(sin(2 * pi() * 440 * n / 8000), 9) + 0 AS sample, round(value * (sin(2 * pi() * ((5.0::DOUBLE * (n % 1600) / 8000 + 0.25) % 1)) * 0.25 + 0.75), 9) AS tremolo FROM (SELECT *, {_N} AS n FROM (SELECT * FROM events WHERE ts IS NOT NULL))")
def generated_wave(spark, sf_dir):
    """A sine beside each stream's samples, and the samples under a tremolo (5 Hz, depth a half) that runs through the stream."""
    e = BY_TYPE.numbered(_events(spark, sf_dir), "n")
    n = F.col("n")
    return e.select("event_id", (F.round(F.sin(2 * F.pi() * 440 * n / 8000), 9) + 0).alias("sample"), F.round(F.col("value") * K.tremolo_gain(n, 8000, 5.0, 0.5), 9).alias("tremolo"))


_KIND = "CASE WHEN value > 1.04::DOUBLE * (100 - value) THEN 'tff' WHEN 100 - value > 1.04::DOUBLE * value + 60 THEN 'bff' WHEN value > 45 THEN 'progressive' ELSE 'undetermined' END"


@query(
    f"""WITH k AS (SELECT event_type, event_id, ts, {_KIND} AS kind FROM events WHERE ts IS NOT NULL),
h AS (SELECT *, list_filter([kind, lag(kind) OVER w, lag(kind, 2) OVER w, lag(kind, 3) OVER w], lambda x: x IS NOT NULL AND x <> 'undetermined') AS h FROM k WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN len(list_distinct(h)) = 1 THEN h[1] END AS best, CASE WHEN len(list_distinct(h)) = 1 AND len(h) >= 3 THEN h[1] END AS strong FROM h)
SELECT event_id, kind, coalesce(last_value(strong IGNORE NULLS) OVER w, first_value(best IGNORE NULLS) OVER w, 'undetermined') AS settled FROM b WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)"""
)
def interlace_history(spark, sf_dir):
    """Types of fields made steady by the history of their stream."""
    v = F.col("value")
    kind = F.when(v > 1.04 * (100 - v), "tff").when(100 - v > 1.04 * v + 60, "bff").when(v > 45, "progressive").otherwise("undetermined")
    return T.settled(_events(spark, sf_dir).withColumn("kind", kind), BY_TYPE, "kind", "undetermined").select("event_id", "kind", "settled")


@query("SELECT event_type, least(greatest(floor(value / 20), 0), 7)::BIGINT AS x, (user_id % 8)::BIGINT AS y, count(*) AS n FROM events GROUP BY ALL")
def vectorscope(spark, sf_dir):
    """Counts over two dimensions at once."""
    x = F.least(F.greatest(F.floor(F.col("value") / 20), F.lit(0)), F.lit(7))
    return _events(spark, sf_dir).groupBy("event_type", x.cast("long").alias("x"), (F.col("user_id") % 8).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _GRID.replace("6 HOUR", "90 MINUTE").replace("'hour'", "'minute'")
    + """, a AS (SELECT g.event_type, g.ts, x.value, x.nv, (epoch_us(g.ts) - epoch_us(x.ts))::DOUBLE / nullif(epoch_us(x.nt) - epoch_us(x.ts), 0) AS share FROM g ASOF LEFT JOIN (SELECT * FROM x WHERE r = 1) x ON g.event_type = x.event_type AND g.ts >= x.ts)
SELECT event_type, ts, coalesce(CASE WHEN abs(nv - value) > 60 THEN CASE WHEN share >= 0.5 THEN nv ELSE value END ELSE value + (nv - value) * share END, value) AS value FROM a"""
)
def framerate_cuts(spark, sf_dir):
    """Values blended between rows, but not across a jump of more than 60."""
    return T.resampled(_events(spark, sf_dir), BY_TYPE, "90 minutes", "value", cut=60.0).select("event_type", "ts", F.col("interpolated").alias("value"))
