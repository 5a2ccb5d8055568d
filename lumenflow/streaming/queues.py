"""Queues over event time: streams kept together by limiting ones, bytes let out at a fixed rate, and late rows that are kept.

State is bounded in time, and everything goes by event-time timers, so the results of a
run don't depend on how input falls into batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

END = "__end"


class SyncQueue(StatefulProcessor):
    """Rows of several streams of a key, let out when no limiting stream is behind them.

    A row waits until every limiting stream that hasn't ended has come to its time. A
    limiting stream that ends lets no other go on: later rows are dropped, whenever
    they come. What has waited for `most_us` of event time goes out in any case, so a
    limiting stream that stays away holds nothing back for longer. Rows of a stream come
    in order; `end` marks its last one, which may be without a payload.

    `floors` are where each limiting stream is, `limit` where the first ended one ended.
    """

    def __init__(self, limiting: tuple[str, ...], most_us: int) -> None:
        self.limiting, self.most_us = limiting, most_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, stream string, id long")
        self.heads = handle.getMapState("heads", "stream string", "us long, ended boolean")
        self.limit = handle.getValueState("limit", "us long")

    def _out(self, key, waiting: list[tuple], horizon: int | None) -> pd.DataFrame:
        """Lets out what lies at or before the horizon (None: everything) and within the limit."""
        limit = self.limit.get()[0] if self.limit.exists() else None
        kept = [r for r in waiting if limit is None or r[0] <= limit]
        ready = [r for r in kept if horizon is None or r[0] <= horizon]
        rest = [r for r in kept if not (horizon is None or r[0] <= horizon)]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        ready.sort()
        return pd.DataFrame([(key[0], *r) for r in ready], columns=["key", "us", "stream", "id"], dtype=object)

    def _floor(self) -> int | None:
        """The time that all limiting streams have come to; None if all have ended."""
        floors = []
        for s in self.limiting:
            head = self.heads.getValue((s,)) if self.heads.containsKey((s,)) else None
            if head is None or not head[1]:
                floors.append(head[0] if head else -(1 << 62))
        return min(floors, default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for b in rows:
            for us, stream, id_, end in zip(b["us"].tolist(), b["stream"].tolist(), b["id"].tolist(), b["end"].tolist(), strict=True):
                if id_ is not None and id_ == id_:
                    waiting.append((int(us), stream, int(id_)))
                    self.handle.registerTimer((int(us) + self.most_us) // 1000)
                if stream in self.limiting:
                    old = self.heads.getValue((stream,)) if self.heads.containsKey((stream,)) else None
                    head = max(int(us), old[0] if old else int(us))
                    self.heads.updateValue((stream,), (head, bool(end) or bool(old and old[1])))
                    if end and (not self.limit.exists() or head < self.limit.get()[0]):
                        self.limit.update((head,))
        yield self._out(key, waiting, self._floor())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        # Rows whose timer this is, and those before them.
        yield self._out(key, waiting, expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999 - self.most_us)

    def close(self) -> None:
        pass


def synced(df: DataFrame, key: str, stream: str, ts: str, id_: str, end: str, limiting: tuple[str, ...], most: int) -> DataFrame:
    """key, us, stream, id of a stream of rows with a watermark on ts, as SyncQueue lets them out; most: seconds that a row waits at most."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(stream).alias("stream"), F.col(id_).cast("long").alias("id"), F.coalesce(F.col(end), F.lit(False)).alias("end"))
    return rows.groupBy("key").transformWithStateInPandas(SyncQueue(limiting, most * 1_000_000), "key string, us long, stream string, id long", "append", "EventTime")


def synced_batch(df: DataFrame, key: str, stream: str, ts: str, id_: str, end: str, limiting: tuple[str, ...]) -> DataFrame:
    """The same of a whole table: rows up to where the first limiting stream ends."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"), F.col(stream).alias("stream"), F.col(id_).cast("long").alias("id"), F.coalesce(F.col(end), F.lit(False)).alias("end"))
    ends = rows.where(F.col("stream").isin(*limiting)).groupBy("key", "stream").agg(F.max("us").alias("us"), F.max("end").alias("end")).where("end")
    limit = ends.groupBy(F.col("key").alias("k")).agg(F.min("us").alias("limit"))
    return rows.where("id IS NOT NULL").join(limit, F.col("key").eqNullSafe(F.col("k")), "left").where(F.col("limit").isNull() | (F.col("us") <= F.col("limit"))).select("key", "us", "stream", "id")


class ByteQueue(StatefulProcessor):
    """Bytes of a key's rows, let out at a fixed rate: up to `size` bytes of what has come by each tick of `every_us`, in order of time.

    A tick goes out when the watermark passes it, so it has all rows that count for it.
    Ticks without bytes give no row.
    """

    def __init__(self, every_us: int, size: int) -> None:
        self.every, self.size = every_us, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, data binary")
        self.ticks = handle.getValueState("tick", "tick long")  # the first that hasn't gone out

    def _tick(self, us: int) -> int:
        return -(-us // self.every)

    def _next(self, waiting: list[tuple]) -> int:
        """The tick that is to go out next: not before the first row that waits, nor again one that has gone."""
        first = self._tick(waiting[0][0])
        return max(first, self.ticks.get()[0]) if self.ticks.exists() else first

    def _await(self, waiting: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.waiting.put(waiting)
            self.handle.registerTimer(-(-self._next(waiting) * self.every // 1000))
        elif self.waiting.exists():
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for b in rows:
            waiting += [(int(us), int(i), bytes(d)) for us, i, d in zip(b["us"], b["id"], b["data"], strict=True) if d is not None and len(d)]
        self._await(sorted(waiting))
        yield pd.DataFrame([], columns=["key", "tick", "data"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left, out = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else [], []
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # All ticks that the watermark has passed, in one go.
        while left and (tick := self._next(left)) * self.every <= watermark:
            chunk, rest = b"", []
            for us, i, d in left:
                if us <= tick * self.every and len(chunk) < self.size:
                    n = self.size - len(chunk)
                    chunk, d = chunk + d[:n], d[n:]
                if d:
                    rest.append((us, i, d))
            out.append((key[0], tick, chunk))
            left = rest
            self.ticks.update((tick + 1,))
        self._await(left)
        yield pd.DataFrame(out, columns=["key", "tick", "data"], dtype=object)

    def close(self) -> None:
        pass


def byte_ticks(df: DataFrame, key: str, ts: str, id_: str, data: str, every: float, size: int) -> DataFrame:
    """key, tick and data of a stream of rows with a watermark on ts, as ByteQueue lets them out; every: seconds from tick to tick."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), F.col(id_).cast("long").alias("id"), F.col(data).cast("binary").alias("data"))
    return rows.groupBy("key").transformWithStateInPandas(ByteQueue(int(every * 1_000_000), size), "key string, tick long, data binary", "append", "EventTime")


class LateRows:
    """A foreachBatch function that gives rows behind the watermark to a sink of their own, and counts both kinds.

    The watermark is the one that Spark keeps: the latest time of the batches before,
    less the delay. Its value and the counts of each batch are written to `folder` once
    the batch's sinks are, so a batch that runs again after a failure begins with the
    same watermark. Sinks get (rows, batch number) and overwrite what an earlier try left.
    Rows without a time are late.
    """

    def __init__(self, ts: str, delay_seconds: int, folder: str, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]) -> None:
        self.ts, self.delay, self.folder, self.on_time, self.late = ts, delay_seconds, folder, on_time, late

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = self.counts(spark).where(F.col("epoch") < epoch).agg(F.max("watermark")).first()[0]
        at = F.unix_micros(F.col(self.ts).cast("timestamp"))
        behind = F.coalesce(at < F.lit(before if before is not None else -(1 << 62)), F.lit(True))
        rows = batch.withColumn("__late", behind).persist()
        try:
            self.on_time(rows.where(~F.col("__late")).drop("__late"), epoch)
            self.late(rows.where("__late").drop("__late"), epoch)
            n = rows.agg(F.count_if(~F.col("__late")).alias("on_time"), F.count_if("__late").alias("late"), F.max(at).alias("latest")).first()
            marks = [x for x in (before, n.latest - self.delay * 1_000_000 if n.latest is not None else None) if x is not None]
            row = spark.createDataFrame([(epoch, n.on_time, n.late, max(marks, default=None))], self.SCHEMA)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{epoch:09d}")
        finally:
            rows.unpersist()

    SCHEMA = "epoch long, on_time long, late long, watermark long"

    def counts(self, spark) -> DataFrame:
        """epoch, on_time, late and watermark (microseconds) behind each batch so far."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return spark.createDataFrame([], self.SCHEMA)
        return spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.folder)
