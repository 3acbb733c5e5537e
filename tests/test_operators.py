"""Worked cases, causality and conservation of the operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import inference as inf
from barloom.operators import relations as rel
from barloom.operators import series as ser
from barloom.operators import trading as trd
from barloom.sources import ingest, sinks

START = dt.datetime(2024, 1, 2, 3, 45)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, closes, symbol="A", minutes=1):
    rows = [(symbol, START + dt.timedelta(minutes=minutes * k), c, c + 5, c - 1, c, 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_resample_keeps_volume_and_extremes(spark):
    out = ser.resample(bars(spark, [100.0 + k for k in range(10)]), 5).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in out] == [(100, 109, 99, 104, 50), (105, 114, 104, 109, 50)]


def test_session_day_of_the_night(spark):
    rows = [("A", dt.datetime(2024, 1, 2, 20, 0)), ("A", dt.datetime(2024, 1, 3, 3, 0))]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz")
    got = [r[0] for r in frame.orderBy("ts").select(ser.session_day(F.col("ts"))).collect()]
    assert got == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_labels_are_strictly_forward(spark):
    frame = ser.labels(bars(spark, [10.0 + k for k in range(10)]), (5,)).orderBy("ts").collect()
    assert frame[0].mfe_5 == pytest.approx((15 + 5) / 10 * 100 - 100) and frame[0].mae_5 == pytest.approx(0)
    assert frame[6].mfe_5 is None


@pytest.mark.parametrize("make", ["returns", "trailing", "volatility", "baselines", "signals"])
def test_future_bars_change_nothing(spark, make):
    rng = np.random.default_rng(1)
    path = [float(x) for x in 100 + rng.standard_normal(160).cumsum()]
    other = path[:140] + [x * 3 for x in path[140:]]

    def made(closes):
        b = bars(spark, closes)
        out = ind.signals(b, "SMA", "Bollinger", "EMA", "SuperTrend", "FVG") if make == "signals" else getattr(ser, make)(b)
        return sorted(map(str, out.where(F.col("ts") < START + dt.timedelta(minutes=140)).collect()))

    assert made(path) == made(other)


def test_recurrences_by_hand():
    x = np.array([1.0, 2, 3, 4, 5])
    assert np.isnan(ind.ema_of(x, 3)[1]) and ind.ema_of(x, 3)[2:].tolist() == [2, 3, 4]
    assert ind.rsi_of(np.arange(1.0, 20), 14)[-1] == pytest.approx(100 - 100 / 101)
    line, way = ind.supertrend_of(x + 1, x - 1, x, 3)
    assert way[-1] == 1 and line[-1] < 5


def test_asof_ties_and_missing(spark):
    at = lambda k: START + dt.timedelta(minutes=k)
    left = spark.createDataFrame([("A", at(0)), ("A", at(2)), ("A", at(5))], "symbol string, ts timestamp_ntz")
    right = spark.createDataFrame([("A", at(2), 1.0), ("A", at(2), 3.0), ("A", at(4), 2.0)], "symbol string, ts timestamp_ntz, v double")
    back = [r.v for r in rel.asof(left, right, "v").orderBy("ts").collect()]
    ahead = [r.v for r in rel.asof(left, right, "v", forward=True).orderBy("ts").collect()]
    assert back == [None, 3.0, 2.0] and ahead == [3.0, 3.0, None]


def test_stop_wins_over_target_and_gaps_fill_at_the_open():
    o, h, low, c = (np.array(x, float) for x in ([100, 100, 80], [100, 130, 90], [100, 70, 75], [100, 100, 85]))
    (trade,) = trd.walk(o, h, low, c, np.array([1, 1, 1]), sl=10, tp=10)
    assert trade[5] == "SL_GAP" and trade[4] == 80
    trades = trd.walk(o[:2], h[:2], low[:2], c[:2], np.array([1, 1]), sl=10, tp=10, fill_next=False)
    assert trades[0][5] == "SL" and trades[0][4] == 90


def test_event_trades_by_hand(spark):
    frame = bars(spark, [100.0, 101.0, 90.0, 100.0])
    got = trd.event_trades(frame, F.col("close") == 100, 3, sl=5, tp=8).orderBy("entry_ts").collect()
    assert [(r.exit_reason, r.duration_bars) for r in got] == [("SL", 2)]


def test_statistics(spark):
    for p in (0.01, 0.5, 0.975):
        z = inf.normal_quantile(p)
        assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, abs=1e-12)
        assert spark.range(1).select(inf.norm_cdf(F.lit(z))).first()[0] == pytest.approx(p, abs=1e-7)
    assert inf.expected_max_sharpe(1) == 0 and inf.expected_max_sharpe(42) == pytest.approx(2.209, abs=1e-3)
    p = spark.createDataFrame([(str(k), x) for k, x in enumerate((0.005, 0.02, 0.04, 0.2, 0.5, 0.9))], "name string, p double")
    got = {r.name: (round(r.bh, 6), round(r.holm, 6), round(r.bonferroni, 6)) for r in inf.adjust(p).collect()}
    assert got["0"] == (0.03, 0.03, 0.03) and got["1"] == (0.06, 0.1, 0.12) and got["5"] == (0.9, 1.0, 1.0)


def test_planted_edge_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, shift in (("edge", 1.5), ("none", 0.0)):
        for block in range(20):
            on = set(rng.choice(100, 6, replace=False).tolist())
            rows += [(name, str(block), float(rng.standard_normal() + shift * (k in on)), k in on, k) for k in range(100)]
    frame = spark.createDataFrame(rows, "name string, block string, label double, event boolean, pos long")
    got = {r.name: r.p for r in inf.permutation_null(frame, 99).collect()}
    assert got["edge"] <= 0.02 and got["none"] > 0.05


def test_recipes_refuse_what_they_do_not_know(spark):
    with pytest.raises(ValueError):
        inf.compile_recipe({"kind": "atomic", "col": "x", "op": "drop table", "val": 1})


def test_layouts_and_tokens(spark):
    assert ingest.detect_layout(["Date", "Strike", "Close"]) == "long" and ingest.detect_layout(["ts", "24000CE_c"]) == "wide"
    with pytest.raises(ValueError):
        ingest.detect_layout(["a", "b"])
    t = spark.createDataFrame([("NIFTY29SEP202624000CE",), ("24000PE",), ("junk",)], "s string").select(ingest.parse_token(F.col("s")).alias("x")).collect()
    assert (t[0].x.underlying, t[0].x.expiry, t[0].x.strike, t[0].x.option_type) == ("NIFTY", "29SEP2026", 24000.0, "CE")
    assert (t[1].x.strike, t[1].x.option_type, t[2].x.method) == (24000.0, "PE", "none")


def test_wide_file(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("ts,24000CE_o,24000CE_h,24000CE_l,24000CE_c,24000CE_v\n1704187800,1,2,0.5,1.5,10\n1704187860,,,,,\n")
    (row,) = ingest.load(spark, str(path)).collect()
    assert (row.strike, row.option_type, row.close, row.volume) == (24000.0, "CE", 1.5, 10.0)


def test_times(spark):
    texts = ["1704187800", "1704187800000", "20240102", "2024-01-02 09:15", "nonsense"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(ingest.to_timestamp(F.col("s"))).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 1, 2, 9, 30) and got[2] == dt.datetime(2024, 1, 2) and got[4] is None
    days = [r[0] for r in spark.createDataFrame([("29SEP2026",), ("29-Sep-26",), ("2026-09-29",), ("x",)], "s string").select(ingest.to_expiry(F.col("s"))).collect()]
    assert days[:3] == [dt.date(2026, 9, 29)] * 3 and days[3] is None


def test_sinks(spark, tmp_path):
    sinks.save_checkpoint(str(tmp_path / "c.json"), {"x": float("nan"), "y": 1})
    assert sinks.load_checkpoint(str(tmp_path / "c.json")) == {"x": None, "y": 1} and sinks.load_checkpoint(str(tmp_path / "no")) is None
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    assert sinks.replay(a, a).count() == 0 and sinks.replay(a, b).count() == 2
    assert sinks.fingerprint(a).first() == sinks.fingerprint(a.orderBy("v", ascending=False)).first()


def test_streams(spark, small, tmp_path):
    from barloom.streaming import live

    events = spark.read.parquet(f"{small}/events.parquet")
    folder = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    for name, make, mode in (("b", live.live_bars, "append"), ("c", live.live_clusters, "append"), ("e", live.running_ema, "update")):
        q = make(live.event_stream(spark, folder, events.schema)).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() > 0
    batch = events.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("b").count() <= batch
