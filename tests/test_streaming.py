import pytest
from pyspark.sql import functions as F

from lumenflow.streaming import twins as W


@pytest.fixture
def events(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    return spark.read.parquet(f"{data}/events.parquet"), spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_sessions_agree_on_what_the_watermark_passed(spark, events, tmp_path):
    batch, stream = events
    got = run(spark, W.sessions(W.with_event_time(stream, "ts", "1 hour"), ["user_id"], "ts", "30 minutes"), "sessions", tmp_path)
    want = W.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "30 minutes")
    end = batch.agg(F.max("ts").cast("timestamp")).first()[0]
    closed = want.where(F.col("end") < F.lit(end) - F.expr("interval 1 hour"))
    assert got.exceptAll(want).count() == 0
    assert closed.exceptAll(got).count() == 0


def test_dedup_and_filter(spark, events, tmp_path):
    batch, stream = events
    twice = stream.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    got = run(spark, W.deduplicated(W.filtered(W.with_event_time(twice, "ts", "40 days"), "value > 50"), ["event_id"]), "dedup", tmp_path)
    assert got.count() == batch.where("value > 50").count()


def test_stateful_chunks_and_tee(spark, events, tmp_path):
    batch, stream = events
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = run(spark, W.stateful(stream.select("event_type", "value"), "event_type", W.CountChunks(), "key string, chunk long, rows long, total double"), "chunks", tmp_path)
    want = sum(r["count"] // 3 for r in batch.groupBy("event_type").count().collect())
    assert got.count() == want and got.where("rows <> 3").count() == 0
    seen = {"a": 0, "b": 0}

    def count(name):
        return lambda df, _: seen.__setitem__(name, seen[name] + df.count())

    q = stream.writeStream.foreachBatch(W.tee(count("a"), count("b"))).option("checkpointLocation", str(tmp_path / "tee")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == {"a": batch.count(), "b": batch.count()}


def closed(df, end, delay):
    return df.where(F.col("start") + F.expr("interval 3 hours") < F.lit(end) - F.expr(f"interval {delay}"))


def test_sliding_windows_and_queues_agree_on_what_the_watermark_passed(spark, events, tmp_path):
    batch, stream = events
    whole = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    end = whole.agg(F.max("ts")).first()[0]
    cases = {
        "sliding": lambda d: W.sliding(d, ["event_type"], "ts", "3 hours", "1 hour", "value").withColumn("energy", F.round("energy", 6)),
        "queues": lambda d: W.queue_statistics(d, ["user_id"], "ts", "1 hour", "event_type = 'view'", "event_type = 'click'"),
    }
    for name, op in cases.items():
        got, want = run(spark, op(W.with_event_time(stream, "ts", "1 hour")), name, tmp_path), op(whole)
        assert got.exceptAll(want).count() == 0
        assert closed(want, end, "1 hour").exceptAll(got).count() == 0 and got.count() > 0


def test_interval_join_equals_the_batch_join(spark, events, tmp_path):
    batch, stream = events

    def sides(df):
        views = df.where("event_type = 'view'").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view"))
        buys = df.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bt"), F.col("event_id").alias("buy"))
        return buys, views

    def joined(df, stamp):
        buys, views = sides(df)
        return W.within(stamp(buys, "bt"), stamp(views, "vt"), "user_id", "bt", "vt", "6 hours").select("buy", "view")

    got = run(spark, joined(stream, lambda d, c: W.with_event_time(d, c, "40 days")), "within", tmp_path)
    want = joined(batch, lambda d, c: d.withColumn(c, F.col(c).cast("timestamp")))
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stateful_limits_changes_and_look_ahead(spark, events, tmp_path):
    batch, stream = events
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ordered = stream.select("event_type", "event_id", "value")
    rows = {}
    for r in batch.select("event_type", "event_id", "value").collect():
        rows.setdefault(r.event_type, []).append((r.event_id, r.value))
    first = run(spark, W.stateful(ordered, "event_type", W.FirstRows(), "key string, n long, event_id long"), "first", tmp_path).collect()
    assert {k: sorted(r.n for r in first if r.key == k) for k in rows} == {k: list(range(min(5, len(v)))) for k, v in rows.items()}
    kept = run(spark, W.stateful(ordered, "event_type", W.KeepChanged(), "key string, event_id long, value double"), "kept", tmp_path).collect()
    for k, v in rows.items():
        line = [r.value for r in kept if r.key == k]
        assert line and all(abs(a - b) > 20 for a, b in zip(line, line[1:], strict=False)) and len(line) < len(v)
    ahead = run(spark, W.stateful(ordered, "event_type", W.LookAhead(), "key string, event_id long, ahead double"), "ahead", tmp_path).collect()
    assert len(ahead) == sum(max(len(v) - 3, 0) for v in rows.values())
    values = dict(x for v in rows.values() for x in v)
    assert all(r.ahead in {v for _, v in rows[r.key]} for r in ahead) and len({r.event_id for r in ahead}) == len(ahead) and set(values) >= {r.event_id for r in ahead}
