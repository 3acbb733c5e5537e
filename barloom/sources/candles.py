"""A candle source for ``spark.read.format("candles")``: replays JSON files of broker candles, one partition a file."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CandleSource(DataSource):
    """Options: ``files`` (comma-separated paths of JSON lists [time, open, high, low, close, volume]) and ``symbol``."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self) -> str:
        return "symbol string, ts timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return CandleReader(self.options)


class CandleReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [f for f in options.get("files", "").split(",") if f]
        self.symbol = options.get("symbol", "SERIES")

    def partitions(self):
        return [InputPartition(f) for f in self.files]

    def read(self, partition):
        import datetime
        import json

        with open(partition.value) as f:
            for at, *numbers in json.load(f):
                yield (self.symbol, datetime.datetime.fromisoformat(at), *map(float, numbers))
