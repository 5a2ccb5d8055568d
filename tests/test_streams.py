import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenflow.operators import streams as T
from lumenflow.operators.ordering import annotated, carried, fitted_unit, islands, numbered, running, with_next, with_previous

SCHEMA = "k string, ts timestamp_ntz, event_id long, value double"
S = T.Stream(("k",))


def rows(n=400, seed=1):
    """A stream with most rows, ties in time, rows far apart, a stream of one row and rows without a time."""
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    out = [("hot" if rng.random() < 0.8 else rng.choice("ab"), t0 + dt.timedelta(hours=rng.randrange(0, 200)), i, float(rng.randrange(0, 40))) for i in range(n)]
    return [*out, ("one", t0, n, 1.0), ("hot", None, n + 1, 5.0)]


def streams(data):
    by = {}
    for k, ts, i, v in data:
        if ts is not None:
            by.setdefault(k, []).append((ts, i, v))
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_ordering_blocks_agree_with_a_plain_scan(spark, unit):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    args = (["k"], "ts", ["event_id"])
    n = {r.event_id: r.n for r in numbered(df, *args, "n", unit).collect()}
    total = {r.event_id: r.s for r in running(df, *args, F.col("value"), "s", "sum", unit).collect()}
    top = {r.event_id: r.s for r in running(df, *args, F.col("value"), "s", "max", unit).collect()}
    prev = {r.event_id: r.p for r in with_previous(df, *args, {"value": "p"}, unit).collect()}
    nxt = {r.event_id: r.p for r in with_next(df, *args, {"value": "p"}, unit).collect()}
    sparse = df.withColumn("x", F.when(F.col("value") > 35, F.col("value")))
    last = {r.event_id: r.c for r in carried(sparse, *args, "x", "c", unit).collect()}
    for s in streams(data).values():
        seen, held = [], None
        for j, (_, i, v) in enumerate(s):
            seen.append(v)
            held = v if v > 35 else held
            assert (n[i], total[i], top[i]) == (j, sum(seen), max(seen))
            assert prev[i] == (seen[-2] if j else None)
            assert nxt[i] == (s[j + 1][2] if j + 1 < len(s) else None)
            assert last[i] == held


@pytest.mark.parametrize("unit", ["hour", "day", "year"])
def test_runs_and_rows_further_back_agree_with_a_plain_scan(spark, unit):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    args = (["k"], "ts", ["event_id"])
    back = {r.event_id: (r.p3, r.p1, r.low) for r in annotated(df, *args, sums={"low": (F.col("value"), "min")}, before={"p3": ("value", 3), "p1": ("event_id", 1)}, unit=unit).collect()}
    runs = {r.event_id: r.island for r in islands(df, *args, ["value"], lambda a, b: F.abs(a["value"] - b["value"]) <= 8, unit=unit).collect()}
    for s in streams(data).values():
        run = 0
        for j, (_, i, v) in enumerate(s):
            run += not (j and abs(v - s[j - 1][2]) <= 8)
            assert back[i] == (s[j - 3][2] if j > 2 else None, s[j - 1][1] if j else None, min(x[2] for x in s[: j + 1]))
            assert runs[i] == run
    assert len(back) == len(runs) == sum(map(len, streams(data).values()))


def test_buckets_follow_the_volume(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    most = {u: df.where("ts IS NOT NULL").groupBy("k", F.date_trunc(u, "ts")).count().agg(F.max("count")).first()[0] for u in ("day", "hour")}
    assert fitted_unit(df, ["k"], "ts", most["day"]) == "day"
    assert fitted_unit(df, ["k"], "ts", most["day"] - 1) == "hour"
    assert S.fitted(df, 0).unit == "second"
    assert S.fitted(df.where("false")).unit == "day"


def test_one_pass_reads_and_deals_its_rows_once(spark, data):
    """The table of buckets is taken from the rows that are dealt already."""
    df = spark.read.parquet(f"{data}/events.parquet")
    out = T.scene_scores(df, T.Stream(("event_type",)), "value").select("event_id", "mafd", "score")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") + plan.count("Scan parquet") <= 2, plan


def test_decimation_keeps_rows_unlike_the_last_kept(spark):
    data = rows()
    got = {r.event_id for r in T.decimated(spark.createDataFrame(data, SCHEMA), S, "value", "event_id", 10.0).collect()}
    want = set()
    for s in streams(data).values():
        last = None
        for _, i, v in s:
            if last is None or abs(v - last) > 10:
                last = v
                want.add(i)
    assert got == want


def test_asof_takes_the_last_at_or_before(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    main, side = df.where("event_id % 3 = 0"), df.where("event_id % 3 = 1")
    got = {r.event_id: r.v for r in T.asof(main, side, S, "value", "v").collect()}
    for s in streams(data).values():
        for ts, i, _ in s:
            if i % 3 == 0:
                before = [(t, j, v) for t, j, v in s if j % 3 == 1 and t <= ts]
                assert got[i] == (max(before)[2] if before else None)


def test_tiles_and_shuffles(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    tiles = T.tiled(df, S, 4, "event_id")
    back = T.untiled(tiles, ["k"], "tiles", "event_id")
    assert back.count() == df.where("ts IS NOT NULL").count()
    dropped = T.shuffled_frames(df.where("k = 'hot'"), S, [1, -1, 0])
    n = df.where("k = 'hot' AND ts IS NOT NULL").count() // 3
    assert dropped.count() == 2 * n
    assert sorted(r.n for r in dropped.collect()) == list(range(2 * n))


def test_empty_streams(spark):
    df = spark.createDataFrame([], SCHEMA)
    for out in (T.every_nth(df, S, 2), T.frozen(df, S, "value", 1.0, 2), T.sessions(df, S, 10), T.rate_report(df.withColumn("pts", F.lit(1).cast("long")), S, "pts"), T.decimated(df, S, "value", "event_id", 1.0)):
        assert out.count() == 0


def test_clock_filter_follows_a_steady_clock(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [("a", t0 + dt.timedelta(seconds=i), i, float(i)) for i in range(200)]
    out = {r.event_id: r.smoothed for r in T.clock_filtered(spark.createDataFrame(data, SCHEMA), S, "value", "event_id", 1.0, 0.1, 0.01).collect()}
    assert all(abs(out[i] - i) < 1e-9 for i in range(200))


def test_clock_filter_smooths_a_noisy_clock(spark):
    rng = random.Random(123)
    t0 = dt.datetime(2024, 1, 1)
    data = [("a", t0 + dt.timedelta(seconds=i), i, i + rng.uniform(-0.3, 0.3)) for i in range(1000)]
    out = {r.event_id: r.smoothed for r in T.clock_filtered(spark.createDataFrame(data, SCHEMA), S, "value", "event_id", 1.0, 0.05, 0.002).collect()}
    noise = sum(abs(v - i) for _, _, i, v in data[200:]) / 800
    assert sum(abs(out[i] - i) for i in range(200, 1000)) / 800 < noise / 2
