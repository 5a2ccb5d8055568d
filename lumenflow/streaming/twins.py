"""Structured Streaming twins of the batch operators.

Each takes a streaming DataFrame with a zoned event-time column and gives a
streaming DataFrame; state is bounded by the watermark. At the end of input a
twin may hold back what its watermark hasn't passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """ts with a zone, and a watermark on it."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys)


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    w = F.session_window(ts, gap).alias("w")
    return df.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows")


def sliding(df: DataFrame, keys: list[str], ts: str, size: str, hop: str, value: str) -> DataFrame:
    w = F.window(ts, size, hop).alias("w")
    return df.groupBy(*keys, w).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(value) * F.col(value)).alias("energy")).select(*keys, F.col("w.start").alias("start"), "rows", "energy")


def filtered(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))


def within(left: DataFrame, right: DataFrame, key: str, lts: str, rts: str, reach: str) -> DataFrame:
    """Pairs of rows of two streams where right comes at most `reach` before left; both sides need watermarks, so state is bounded."""
    r = right.withColumnRenamed(key, "__key")
    cond = (left[key] == F.col("__key")) & (F.col(rts) <= F.col(lts)) & (F.col(rts) >= F.col(lts) - F.expr(f"interval {reach}"))
    return left.join(r, cond).drop("__key")


def tee(*writes: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with several sinks: all are tried, and the first failure is raised after."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failed: Exception | None = None
        for w in writes:
            try:
                w(batch, epoch)
            except Exception as e:  # noqa: BLE001  raised below
                failed = failed or e
        batch.unpersist()
        if failed:
            raise failed

    return run


class CountChunks(StatefulProcessor):
    """Every `size` rows of a key become one row; what is left waits for more."""

    size = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunk", "rows long, total double, chunk long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, chunk = self.state.get() if self.state.exists() else (0, 0.0, 0)
        out = []
        for b in rows:
            for v in b["value"]:
                n, total = n + 1, total + float(v)
                if n == self.size:
                    out.append((key[0], chunk, n, total))
                    n, total, chunk = 0, 0.0, chunk + 1
        self.state.update((n, total, chunk))
        yield pd.DataFrame(out, columns=["key", "chunk", "rows", "total"])

    def close(self) -> None:
        pass


class KeepChanged(StatefulProcessor):
    """Rows that differ from the key's last kept row by more than threshold."""

    threshold = 20.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        kept = []
        for b in rows:
            for i, v in zip(b["event_id"], b["value"], strict=True):
                if last is None or abs(v - last) > self.threshold:
                    last = float(v)
                    kept.append((key[0], int(i), last))
        if last is not None:
            self.state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "event_id", "value"])

    def close(self) -> None:
        pass


class FirstRows(StatefulProcessor):
    """The first `most` rows of a key, in the order in which they come."""

    most = 5

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "rows long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.state.get()[0] if self.state.exists() else 0
        kept = []
        for b in rows:
            part = b["event_id"].iloc[: max(self.most - seen, 0)]
            kept += [(key[0], seen + n, int(i)) for n, i in enumerate(part)]
            seen = min(seen + len(b), self.most)
        self.state.update((seen,))
        yield pd.DataFrame(kept, columns=["key", "n", "event_id"])

    def close(self) -> None:
        pass


class LookAhead(StatefulProcessor):
    """Each row with the largest value of the `reach` rows behind it, once these have come; a key's state is never more than `reach` rows."""

    reach = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("waiting", "event_id long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [(int(r[0]), float(r[1])) for r in self.state.get()] if self.state.exists() else []
        for b in rows:
            waiting += zip(b["event_id"].astype(int).tolist(), b["value"].astype(float).tolist(), strict=True)
            ready = len(waiting) - self.reach
            if ready > 0:
                values = pd.Series([v for _, v in waiting])
                ahead = values[::-1].rolling(self.reach).max()[::-1].shift(-1)
                yield pd.DataFrame({"key": key[0], "event_id": [i for i, _ in waiting[:ready]], "ahead": ahead[:ready].to_numpy()})
                waiting = waiting[ready:]
        self.state.put(waiting)

    def close(self) -> None:
        pass


def queue_statistics(df: DataFrame, keys: list[str], ts: str, size: str, arrived: str, left: str) -> DataFrame:
    """What waits in a queue by windows of time: rows that came, rows that left, and how many more came than left."""
    w = F.window(ts, size).alias("w")
    came, gone = F.count_if(F.expr(arrived)), F.count_if(F.expr(left))
    return df.groupBy(*keys, w).agg(came.alias("came"), gone.alias("gone"), (came - gone).alias("waiting")).select(*keys, F.col("w.start").alias("start"), "came", "gone", "waiting")


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """A stateful operator over each key; needs the RocksDB state store."""
    return df.withColumn("key", F.col(key)).groupBy("key").transformWithStateInPandas(processor, schema, "append", "none")
