"""Queries of the further stream operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenflow.operators import streams as T
from lumenflow.operators import timing as X
from lumenflow.registry import query
from lumenflow.session import table

BY_TYPE = T.Stream(("event_type",))
BY_USER = T.Stream(("user_id",))
_E = "(SELECT * FROM events WHERE ts IS NOT NULL)"
_N = "(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query(f"WITH f AS (SELECT *, min(ts) OVER (PARTITION BY event_type) AS first FROM {_E} WHERE ts >= TIMESTAMP '2024-01-05') SELECT event_id FROM f WHERE epoch_us(ts) - epoch_us(first) < 36::BIGINT * 3600 * 1000000")
def trim_duration(spark, sf_dir):
    return X.trimmed(_events(spark, sf_dir), BY_TYPE, start="2024-01-05 00:00:00", duration=36 * 3600.0).select("event_id")


@query(f"WITH n AS (SELECT *, {_N} AS n FROM {_E}) SELECT event_id FROM n WHERE (ts >= TIMESTAMP '2024-01-20' OR n >= 50) AND (ts < TIMESTAMP '2024-01-06' OR n < 200)")
def trim_mixed(spark, sf_dir):
    """From where a time or a number is reached, while a time or a number isn't."""
    return X.trimmed(_events(spark, sf_dir), BY_TYPE, start="2024-01-20 00:00:00", end="2024-01-06 00:00:00", start_n=50, end_n=200).select("event_id")


def _fps_sql(slot: str, first: str = "") -> str:
    low = f"CASE WHEN prev IS NULL AND slot > {first} THEN {first} ELSE greatest(slot, {first}) END" if first else "slot"
    return f"""WITH s AS (SELECT *, {slot} AS slot FROM {_E}), l AS (SELECT event_type, slot, max_by(event_id, (ts, event_id)) AS event_id FROM s GROUP BY ALL),
n AS (SELECT *, lag(slot) OVER w AS prev, coalesce(lead(slot) OVER w - 1, slot) AS high FROM l WINDOW w AS (PARTITION BY event_type ORDER BY slot)), o AS (SELECT *, {low} AS low FROM n)
SELECT event_type, event_id, unnest(generate_series(low, high)) AS slot FROM o WHERE low <= high"""


@query(_fps_sql("floor(epoch_us(ts) / 5400000000.0::DOUBLE + 0.5)::BIGINT"))
def fps_near(spark, sf_dir):
    """One row for each 90 minutes, times rounded to the nearest slot; gaps repeat the last row."""
    return X.at_rate(_events(spark, sf_dir), BY_TYPE, 5400).select("event_type", "event_id", "slot")


@query(_fps_sql("ceil(epoch_us(ts) / 5400000000.0::DOUBLE)::BIGINT", "ceil(epoch_us(TIMESTAMP '2024-01-03') / 5400000000.0::DOUBLE)::BIGINT"))
def fps_up_from(spark, sf_dir):
    """Times rounded up, beginning on the third day whatever comes first."""
    return X.at_rate(_events(spark, sf_dir), BY_TYPE, 5400, "up", "2024-01-03 00:00:00").select("event_type", "event_id", "slot")


@query(f"SELECT m.event_id, s.value AS held FROM (SELECT * FROM {_E} WHERE event_type = 'click') m ASOF LEFT JOIN (SELECT ts, max_by(value, event_id) AS value FROM {_E} WHERE event_type = 'view' GROUP BY ts) s ON m.ts >= s.ts")
def fsync(spark, sf_dir):
    """One stream re-timed to the times of another."""
    e = _events(spark, sf_dir)
    one = T.Stream(("one",))
    times = e.where("event_type = 'click'").select(F.lit(1).alias("one"), "ts", "event_id")
    return X.at_times(times, e.where("event_type = 'view'").withColumn("one", F.lit(1)), one, "value", "held").select("event_id", "held")


@query(
    f"""WITH r AS (SELECT *, {_N} AS n, count(*) OVER (PARTITION BY event_type) AS total FROM {_E})
SELECT event_type, event_id, n + k + 2 AS n, k <> 0 AS copy FROM (SELECT *, unnest(generate_series(CASE WHEN n = 0 THEN -2 ELSE 0 END, CASE WHEN n = total - 1 THEN 3 ELSE 0 END)) AS k FROM r)"""
)
def pad_both_ends(spark, sf_dir):
    return X.padded_ends(_events(spark, sf_dir), BY_TYPE, 2, 3).select("event_type", "event_id", "n", "copy")


@query("SELECT event_id, ts + CASE event_type WHEN 'click' THEN INTERVAL 90 SECOND WHEN 'view' THEN INTERVAL 3600 SECOND ELSE INTERVAL 0 SECOND END AS ts FROM events")
def delay(spark, sf_dir):
    return X.delayed(_events(spark, sf_dir), "ts", {"click": 90, "view": 3600}, "event_type").select("event_id", "ts")


@query("SELECT event_id, ((ts >= TIMESTAMP '2024-01-04 12:00:00')::INT + (ts >= TIMESTAMP '2024-01-10')::INT + (ts >= TIMESTAMP '2024-01-25 06:00:00')::INT)::BIGINT AS segment FROM events WHERE ts IS NOT NULL")
def segments_at_times(spark, sf_dir):
    e = _events(spark, sf_dir).where("ts IS NOT NULL")
    return X.segmented(e, "ts", ["2024-01-04 12:00:00", "2024-01-10 00:00:00", "2024-01-25 06:00:00"]).select("event_id", "segment")


_TYPES = ("click", "purchase", "signup", "view")


@query(f"WITH r AS (SELECT event_type, value, {_N} AS n FROM {_E}) SELECT n, " + ", ".join(f"max(value) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + f" FROM r WHERE event_type IN {_TYPES} GROUP BY n HAVING count(*) = 4")
def xstack(spark, sf_dir):
    """Four streams side by side, ending with the shortest."""
    e = _events(spark, sf_dir)
    out = X.stacked_all([e.where(F.col("event_type") == t) for t in _TYPES], BY_TYPE, "value")
    return out.select("n", *[F.get("values", F.lit(i)).alias(t) for i, t in enumerate(_TYPES)])


@query(f"WITH w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS w FROM {_E}) SELECT event_id, w[(len(w) - 1) // 2 + 1] AS median FROM w")
def sliding_median(spark, sf_dir):
    return X.sliding_median(_events(spark, sf_dir), BY_USER, "value", 5).select("event_id", "median")


@query("SELECT event_type, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type")
def exact_quantiles(spark, sf_dir):
    return X.exact_quantiles(_events(spark, sf_dir), "event_type", "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query(
    f"""WITH RECURSIVE c AS (SELECT event_type, ceil(epoch_us(ts) / 3600000000.0::DOUBLE)::BIGINT AS tick, sum(length(event_id || props))::BIGINT AS came FROM {_E} GROUP BY ALL),
b AS (SELECT event_type, min(tick) AS a, max(tick) AS z, sum(came) AS total FROM c GROUP BY 1), t AS MATERIALIZED (SELECT b.event_type, k AS tick, coalesce(came, 0) AS came FROM (SELECT *, unnest(range(a, z + total::BIGINT // 24 + 2)) AS k FROM b) b LEFT JOIN c ON c.event_type = b.event_type AND c.tick = b.k),
r AS (SELECT event_type, tick, came, least(came, 24) AS gone, came - least(came, 24) AS waiting FROM t JOIN b USING (event_type) WHERE tick = a
UNION ALL SELECT t.event_type, t.tick, t.came, least(r.waiting + t.came, 24), r.waiting + t.came - least(r.waiting + t.came, 24) FROM r JOIN t ON t.event_type = r.event_type AND t.tick = r.tick + 1)
SELECT event_type, tick, came::BIGINT AS came, gone::BIGINT AS gone, waiting::BIGINT AS waiting FROM r WHERE came > 0 OR gone > 0"""
)
def byte_queue(spark, sf_dir):
    """Bytes of events let out at 24 an hour: what came, went and waits at each hour that has any."""
    e = _events(spark, sf_dir)
    size = F.octet_length(F.concat(F.col("event_id").cast("string"), F.col("props")))
    return X.drained(e, BY_TYPE, size, 3600, 24).where("came > 0 OR gone > 0")
