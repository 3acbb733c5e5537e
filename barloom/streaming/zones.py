"""Fair-value gaps on a stream of bars: a list of live zones per symbol, kept as list state between batches.

A bar opens a zone where it leaves a gap to the bar two before; a zone is filled when a close goes through it, and dies of age.
The stream says for every bar what ``gap_bias_of`` says for it in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ZONE = "born long, side int, low double, high double"
#: bars seen, the last time, and the highs and lows of the last two bars
SEEN = "n long, ts long, high1 double, low1 double, high2 double, low2 double"
BIAS = "symbol string, ts timestamp, bias int, zones int"

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(zones: list[tuple], n: int, before: tuple, bar: tuple, most: int, age: int) -> tuple[list[tuple], int]:
    """(live zones, bias) after bar number ``n`` (high, low, close); ``before`` holds the bar two before (high, low) or None."""
    high, low, close = bar
    if before is not None:
        if low > before[0]:
            zones = [*zones, (n, 1, before[0], low)]
        elif high < before[1]:
            zones = [*zones, (n, -1, high, before[1])]
    zones = [z for z in zones[-most:] if n - z[0] <= age and not (close < z[2] if z[1] > 0 else close > z[3])]
    touched = [z[1] for z in zones if z[2] <= (low if z[1] > 0 else high) <= z[3]]
    return zones, touched[-1] if touched else 0


class GapZones(StatefulProcessor):
    """Zones of one symbol: at most ``most``, none older than ``age`` bars.  Bars not after the last one seen are dropped."""

    def __init__(self, most: int = 5, age: int = 60):
        self.most, self.age = most, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.zones = handle.getListState("zones", ZONE)
        self.seen = handle.getValueState("seen", SEEN)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        bars = pd.concat(list(rows)).sort_values("ts")
        zones = [tuple(z) for z in self.zones.get()] if self.zones.exists() else []
        n, last, high1, low1, high2, low2 = self.seen.get() if self.seen.exists() else (0, None, None, None, None, None)
        out = []
        for ts, high, low, close in zip(bars["ts"], bars["high"], bars["low"], bars["close"], strict=True):
            at = ts.value // 1000
            if last is not None and at <= last:
                continue
            zones, bias = advance(zones, n, None if n < 2 else (high2, low2), (high, low, close), self.most, self.age)
            out.append((key[0], ts, bias, len(zones)))
            n, last, high1, low1, high2, low2 = n + 1, at, float(high), float(low), high1, low1
        if n:
            self.seen.update((n, last, high1, low1, high2, low2))
        self.zones.clear()
        if zones:
            self.zones.put([(int(b), int(s), float(x), float(y)) for b, s, x, y in zones])
        yield pd.DataFrame(out, columns=["symbol", "ts", "bias", "zones"])

    def close(self) -> None:
        pass


def gap_biases(bars: DataFrame, most: int = 5, age: int = 60) -> DataFrame:
    """(symbol, ts, bias, zones) of a stream of bars (symbol, ts, high, low, close), whose state store must be RocksDB (ROCKS)."""
    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").transformWithStateInPandas(GapZones(most, age), outputStructType=BIAS, outputMode="Append", timeMode="None")
