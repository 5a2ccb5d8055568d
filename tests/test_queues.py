"""Queues over event time against batch plans and plain loops, over several batches and restarts."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lumenflow.operators.streams import Stream
from lumenflow.operators.timing import drained
from lumenflow.streaming import queues as Q

SCHEMA = "key string, stream string, s double, id long, end boolean, data string"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def put(folder, batch, rows):
    folder.mkdir(exist_ok=True)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    path = folder / f"{batch:03d}.json"
    path.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in rows))
    at = time.time() - 1000 + batch
    os.utime(path, (at, at))  # files are taken in order of their times


def source(spark, folder):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(170)
    return df.sparkSession.table(name).collect()


def dealt(folder, rows, batches):
    """Rows by time into so many files, one a trigger; the last moves the watermark on."""
    rows = sorted(rows, key=lambda r: r[2])
    size = -(-len(rows) // batches)
    for k in range(batches):
        put(folder, k, rows[k * size : (k + 1) * size])
    put(folder, batches, [("zz", "a", 1e6, 0, False, "")])


def sync_rows():
    rng = random.Random(1)
    rows = []
    for key, limit_at in (("p", 400.0), ("q", None)):
        for stream, step in (("a", 7.0), ("b", 3.0), ("c", 11.0)):
            s, n = rng.uniform(0, 5), 0
            while s < 600:
                if not (stream == "a" and limit_at and s > limit_at):
                    rows.append((key, stream, round(s, 3), len(rows), False, ""))
                s += step * rng.uniform(0.5, 1.5)
        if limit_at:
            rows.append((key, "a", limit_at + 5, None, True, ""))
    return rows


@pytest.mark.parametrize("batches", [1, 4])
def test_no_stream_gets_ahead_of_a_limiting_one(spark, tmp_path, batches):
    rows = sync_rows()
    dealt(tmp_path / "in", rows, batches)
    got = run(Q.synced(source(spark, tmp_path / "in").withWatermark("ts", "20 seconds"), "key", "stream", "ts", "id", "end", ("a",), 60), f"sync{batches}", tmp_path)
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    want = {tuple(r) for r in Q.synced_batch(whole, "key", "stream", "ts", "id", "end", ("a",)).collect()}
    assert {tuple(r) for r in got if r.key != "zz"} == want and len([r for r in got if r.key != "zz"]) == len(want)
    assert max(r.us for r in got if r.key == "p") <= 405_000_000 < max(r[2] * 1_000_000 for r in rows if r[0] == "p")
    if batches > 1:  # within a key rows come out in order of time
        for key in "pq":
            times = [r.us for r in got if r.key == key]
            assert times == sorted(times)


def test_a_limiting_stream_that_stays_away_holds_rows_back_for_so_long_only(spark, tmp_path):
    put(tmp_path / "in", 0, [("p", "b", float(s), s, False, "") for s in range(5, 100, 10)])
    put(tmp_path / "in", 1, [("zz", "b", 130.0, 900, False, "")])
    put(tmp_path / "in", 2, [("zz", "b", 131.0, 901, False, "")])
    got = run(Q.synced(source(spark, tmp_path / "in").withWatermark("ts", "0 seconds"), "key", "stream", "ts", "id", "end", ("a",), 60), "away", tmp_path)
    # The watermark came to 130 or 131 seconds: what is older than a minute went out.
    assert sorted(r.id for r in got if r.key == "p") == [5, 15, 25, 35, 45, 55, 65]


def plain_queue(rows, every, size):
    """(key, tick) -> bytes"""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r[2], r[3], r[5].encode()) for r in rows if r[0] == key and r[5])
        tick, queue = None, b""
        while own or queue:
            first = -(-own[0][0] // every) if own else None
            tick = first if tick is None or (not queue and first > tick + 1) else tick + 1
            while own and own[0][0] <= tick * every:
                queue += own.pop(0)[2]
            if queue:
                out[key, int(tick)] = queue[:size]
            queue = queue[size:]
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_bytes_go_out_at_a_fixed_rate(spark, tmp_path, batches):
    rng = random.Random(2)
    rows = [(rng.choice("pq"), "a", rng.randrange(0, 2000) / 2.0 + (3000 if i > 150 else 0), i, False, "x" * rng.choice([0, 1, 7]) + str(i) * rng.choice([0, 1, 6])) for i in range(200)]
    dealt(tmp_path / "in", rows, batches)
    got = run(Q.byte_ticks(source(spark, tmp_path / "in").withWatermark("ts", "10 seconds"), "key", "ts", "id", "data", 5.0, 4), f"bytes{batches}", tmp_path)
    want = plain_queue(rows, 5.0, 4)
    assert {(r.key, r.tick): bytes(r.data) for r in got} == want and len(got) == len(want)
    whole = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    sums = drained(whole, Stream(("key",), "ts", ("id",), "hour"), F.octet_length("data"), 5, 4).where("gone > 0").collect()
    assert {(r.key, r.tick): r.gone for r in sums} == {k: len(v) for k, v in want.items()}
    end = {k: max(t for q, t in want if q == k) for k in "pq"}
    assert all((r.waiting == 0) == (sum(len(v) for (q, t), v in want.items() if q == r.key and t <= r.tick) == sum(len(x[5]) for x in rows if x[0] == r.key and x[2] <= r.tick * 5)) for r in sums)
    assert all(r.waiting == 0 for r in sums if r.tick == end[r.key])


def late_query(spark, tmp_path, fail_at=None):
    def sink(name):
        def write(df, epoch):
            if fail_at == (name, epoch):
                raise RuntimeError("the sink is away")
            df.write.mode("overwrite").json(str(tmp_path / name / f"e{epoch}"))

        return write

    router = Q.LateRows("ts", 100, str(tmp_path / "marks"), sink("on_time"), sink("late"))
    q = source(spark, tmp_path / "in").writeStream.foreachBatch(router).option("checkpointLocation", str(tmp_path / "late-checkpoint")).trigger(availableNow=True).start()
    return q, router


def test_late_rows_have_a_sink_of_their_own(spark, tmp_path):
    put(tmp_path / "in", 0, [("p", "a", float(s), s, False, "") for s in (500, 10, 1000)])
    put(tmp_path / "in", 1, [("p", "a", s, i, False, "") for i, s in ((1, 899.0), (2, 900.0), (3, 2000.0), (4, None))])
    q, router = late_query(spark, tmp_path)
    q.awaitTermination(120)
    put(tmp_path / "in", 2, [("p", "a", s, i, False, "") for i, s in ((5, 1899.0), (6, 1950.0))])
    put(tmp_path / "in", 3, [("p", "a", s, i, False, "") for i, s in ((7, 1000.0), (8, 1901.0))])
    q, router = late_query(spark, tmp_path, ("late", 2))
    with pytest.raises(Exception, match="the sink is away"):
        q.awaitTermination(120)
    q, router = late_query(spark, tmp_path)  # goes on from the checkpoint, with batch 2 again
    q.awaitTermination(120)
    ids = lambda name: sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").json(str(tmp_path / name)).collect())
    assert ids("late") == [1, 4, 5, 7] and ids("on_time") == [2, 3, 6, 8, 10, 500, 1000]
    counts = {r.epoch: (r.on_time, r.late, r.watermark) for r in router.counts(spark).collect()}
    assert counts == {0: (3, 0, 900_000_000), 1: (2, 2, 1_900_000_000), 2: (1, 1, 1_900_000_000), 3: (1, 1, 1_900_000_000)}
