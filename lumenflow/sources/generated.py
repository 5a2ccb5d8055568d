"""A Python data source of generated waves, as an example of a registered source with partitions of its own."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class WaveSource(DataSource):
    """format("wave"): n, sample of a sine; options samples, rate, frequency, partitions."""

    @classmethod
    def name(cls) -> str:
        return "wave"

    def schema(self) -> str:
        return "n long, sample double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.samples, self.rate = int(options.get("samples", 1000)), float(options.get("rate", 8000))
        self.frequency, self.parts = float(options.get("frequency", 440)), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        step = -(-self.samples // self.parts)
        return [InputPartition((i, min(i + step, self.samples))) for i in range(0, self.samples, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import math

        a, b = partition.value
        for n in range(a, b):
            yield n, math.sin(2 * math.pi * self.frequency * n / self.rate)
