"""Gates, effective trials, as-of joins over days and the frontier in parts, on small frames with known results."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import buyonly, gates, relations, trading


def test_asof_over_days(spark):
    rng = np.random.default_rng(0)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=int(rng.integers(0, 24 * 12)))
    left = [(k, "ab"[k % 2], at()) for k in range(120)]
    right = [("ab"[k % 2], at(), float(k) if k % 5 else None) for k in range(25)]
    a, b = spark.createDataFrame(left, "id int, symbol string, ts timestamp_ntz"), spark.createDataFrame(right, "symbol string, ts timestamp_ntz, x double")
    for forward in (False, True):
        got = {r.id: r.x for r in relations.asof(a, b, "x", forward=forward).collect()}
        for k, s, t in left:
            there = [(u, x) for z, u, x in right if z == s and x is not None and (u >= t if forward else u <= t)]
            best = (min if forward else max)((u for u, _ in there), default=None)
            assert got[k] == max((x for u, x in there if u == best), default=None)
    assert relations.asof(a, b.limit(0), "x").where("x is null").count() == len(left)


def test_frontier_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trading, "PART", 20)
    rows = [(f"c{k}", float(a), float(b), float(c)) for k, (a, b, c) in enumerate(np.random.default_rng(1).integers(0, 9, (150, 3)))]
    frame = spark.createDataFrame(rows, "cfg string, a double, b double, c double")
    got = {r.cfg for r in trading.pareto(frame, ["a", "b"], ["c"]).collect()}
    beats = lambda x, y: x[1] >= y[1] and x[2] >= y[2] and x[3] <= y[3] and x[1:] != y[1:]
    assert got == {y[0] for y in rows if not any(beats(x, y) for x in rows)}


def test_frontier_of_sums_in_any_order(spark):
    """Metrics of which every evaluation ends in other digits, as sums of doubles do when blocks come in another order."""
    rows = [(f"c{k}", k % 40 - k // 40 * 0.5, float(40 - k % 40 - k // 40 * 5), 1.0 + k // 40) for k in range(120)]
    frame = spark.createDataFrame(rows, "cfg string, a double, b double, c double")
    shaken = F.udf(lambda x: x + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    got = {r.cfg for r in trading.pareto(frame.withColumn("a", shaken("a")), ["a", "b"], ["c"]).collect()}
    assert got == {f"c{k}" for k in range(40)}


def test_effective_trials(spark):
    rng = np.random.default_rng(2)
    masks = {f"m{k}": rng.random(3000) < 0.1 for k in range(6)}
    masks |= {f"copy{k}": masks["m0"] for k in range(4)} | {"never": np.zeros(3000, bool)}
    rows = [(n, int(p), bool(x)) for n, mask in masks.items() for p, x in enumerate(mask)]
    signals = spark.createDataFrame(rows, "name string, pos long, on boolean")
    assert gates.effective_n(signals) == (11, 6)
    assert gates.effective_n(signals.limit(0)) == (0, 0)


@pytest.mark.parametrize(
    ("parts", "score", "coverage"),
    [
        ({k: 1.0 for k in gates.WEIGHTS}, 10.0, 1.0),
        ({"signal": 1.0, "oos": 1.0, "param": 0.2}, 6.0, 4 / 9),
        ({"signal": 1.0, "oos": 1.0, "stats": 0.0}, 3.0, 3.25 / 9),
        ({}, 0.0, 0.0),
    ],
)
def test_robustness_score(spark, parts, score, coverage):
    frame = spark.range(1).select(*[F.lit(parts.get(k)).cast("double").alias(k) for k in [*gates.WEIGHTS, "param_density"]])
    got = gates.robustness_score(frame).first()
    assert (got.robustness_score, got.robustness_coverage) == (pytest.approx(score), pytest.approx(coverage, abs=1e-3))


def test_data_gates(spark):
    row = spark.range(1).select(
        gates.data_ready(F.lit(50), F.lit(3), F.lit(10)).alias("ready"),
        gates.data_ready(F.lit(49), F.lit(3), F.lit(10)).alias("thin"),
        gates.expiry_guard(F.lit(True), F.lit(True)).alias("carry"),
        *[c.alias(n) for n, c in zip(("over", "blocked"), gates.iv_gate(F.lit(0.4)), strict=True)],
        gates.iv_gate(F.lit(0.4), mode="warn")[1].alias("warned"),
        gates.iv_gate(F.lit(None).cast("double"))[1].alias("unknown"),
        gates.oos_gate(F.lit(19)).alias("few"),
        gates.oos_gate(F.lit(20)).alias("enough"),
    ).first()
    assert tuple(row) == (True, False, True, True, True, False, False, "THIN_OOS", "OOS_OK")
    assert [r.s for r in gates.scope(spark.range(20).select(F.col("id").alias("s")), "s").collect()] == list(range(8))


def _bars(spark, closes, day=datetime(2024, 1, 2, 9)):
    rows = [("A", day + timedelta(minutes=k), c, c + 1.0, c - 1.0, c, 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_exits_of_long_premium(spark):
    """Stop, gap, locked profit, target, time and end of day, one path each."""
    paths = {
        "STOP": [100, 100, 90, 70.5],
        "STOP_GAP": [100, 100, 60],
        "TARGET": [100, 100, 120, 161],
        "TIME": [100] * 60,
        "END_OF_DAY": [100, 100, 101],
    }
    for k, (reason, closes) in enumerate(paths.items()):
        bars = _bars(spark, [float(c) for c in closes], datetime(2024, 1, 2 + k, 9))
        got = buyonly.exits(bars.orderBy("ts").limit(1), bars).first()
        assert got.exit_reason == reason and got.entry == 100.0
    bars = _bars(spark, [100.0, 100.0, 131.0, 114.0])
    got = buyonly.exits(bars.orderBy("ts").limit(1), bars).first()
    assert (got.exit_reason, got.exit) == ("STOP_GAP", 114.0)  # half of the risk was locked at 115


def test_exits_walk_like_the_plain_loop(spark):
    """Trail behind the candle before, locked gains and given targets, against a loop over each path."""
    rng = np.random.default_rng(12)
    for k in range(6):
        closes = (300 + np.cumsum(rng.normal(0.8, 6, 40))).round(1).tolist()
        bars = _bars(spark, closes, datetime(2024, 3, 1 + k, 9))
        rows = bars.orderBy("ts").collect()
        given = None if k % 2 else float(rows[1].open + 25)
        signal = bars.orderBy("ts").limit(1).withColumn("target", F.lit(given).cast("double"))
        got = buyonly.exits(signal, bars, hold=30, least_stop=5.0).first()
        entry = rows[1].open
        risk = max(entry - rows[0].low + 1, 5.0)
        stop, goal, before, moved, locked, pending, want = entry - risk, given or entry + 2 * risk, None, False, False, None, None
        for i, b in enumerate(rows[1:31], 1):
            stop = max(stop, pending) if pending is not None else stop
            pending = None
            if before is not None and stop >= entry:
                stop = max(stop, before)
            if b.open < stop:
                want = ("STOP_GAP", b.open, i)
            elif b.low <= stop:
                want = ("STOP", stop, i)
            elif b.high >= goal:
                want = ("TARGET", goal, i)
            elif i == 30:
                want = ("TIME", b.close, i)
            if want:
                break
            gain = b.high - entry
            if not moved and gain >= 2.5:
                pending, moved = entry, True
            if not locked and gain >= risk:
                pending, locked = max(pending or 0, entry + 0.5 * gain), True
            before = b.low
        assert (got.exit_reason, round(got.exit, 6), got.held) == (want[0], round(want[1], 6), want[2]), k


def test_a_look_ahead_is_only_in_the_variant_that_says_so(spark):
    rng = np.random.default_rng(4)
    closes = (100 + np.cumsum(rng.normal(0, 1.5, 200))).round(1).tolist()
    whole = _bars(spark, closes).withColumn("volume", F.when(F.minute("ts") % 5 == 0, 40.0).otherwise(10.0))
    cut = whole.where("ts < timestamp_ntz'2024-01-02 11:00:00'")
    for signals in (buyonly.detect, buyonly.liquidity_flush, buyonly.volatility_coil, buyonly.vwap_snap_back):
        early = {tuple(r) for r in signals(buyonly.session_features(whole)).where("ts < timestamp_ntz'2024-01-02 11:00:00'").collect()}
        assert early == {tuple(r) for r in signals(buyonly.session_features(cut)).collect()}
    loose = buyonly.liquidity_flush(buyonly.session_features(whole), volume=0.5, causal=False).count()
    assert loose >= buyonly.liquidity_flush(buyonly.session_features(whole), volume=0.5).count()
    names = [r.hypothesis for r in buyonly.availability(spark.createDataFrame([(None,)], "oi double")).where("not available").collect()]
    assert names == ["OI_VELOCITY"]


def test_status_chain_covers_every_name(spark):
    grid = list(itertools.product((49, 60), (2, 4, 9), (None, -1.0, 1.0), (-1.0, 1.0), (0.01, 0.07, 0.2, None), (0.1, 0.6), ("OOS_OK", "THIN_OOS"), (True, False)))
    frame = spark.createDataFrame(grid, "events int, days int, oos_mean double, train_mean double, p_adj double, top5 double, oos_gate string, capped boolean")
    names = {r.s for r in frame.select(gates.status().alias("s")).distinct().collect()}
    assert names == {"THIN_SAMPLE", "REJECTED", "OOS_REJECTED", "SURROGATE_REJECTED", "CAP_DOMINATED", "CONCENTRATED", "OOS_SURVIVED", "ROBUST"}


def test_sign_flips(spark):
    from barloom.operators import premium

    rng = np.random.default_rng(6)
    rows = [("edge", k, float(abs(x))) for k, x in enumerate(rng.normal(size=80))] + [("none", k, float(x - y)) for k, (x, y) in enumerate(rng.normal(size=(80, 2)))]
    rows += [("none", 1000 + k, -r[2]) for k, r in enumerate(rows) if r[0] == "none"]  # a mean of zero
    got = {r.cfg: (r.observed, r.p) for r in premium.sign_flip_test(spark.createDataFrame(rows, "cfg string, seq long, ret double"), "cfg", "ret", "seq").collect()}
    assert got["edge"][1] == pytest.approx(1 / 201) and 0.2 < got["none"][1] < 0.8


def test_combo_events(spark):
    flags = ["e_large_ret", "e_vol_shock", "e_compression", "e_expansion", "e_type_accel", "e_atm_move", "a_leads_b"]
    rows = [(s, datetime(2024, 1, 1, k), *(int(b) for b in f"{k * 37 % 128:07b}")) for s in "AB" for k in range(20)]
    frame = spark.createDataFrame(rows, ", ".join(["symbol string", "ts timestamp_ntz", *[f"{f} int" for f in flags]]))
    from barloom.operators import premium

    last: dict = {}
    for r in premium.combo_events(frame, ["a_leads_b"]).orderBy("symbol", "ts").collect():
        want = (r.e_large_ret & r.e_vol_shock, last.get(r.symbol, 0) & r.e_expansion, r.e_type_accel & (1 - r.a_leads_b), r.e_atm_move, r.e_large_ret & r.e_vol_shock & r.e_expansion)
        assert (r.ev_largeRet_volShock, r.ev_compress_expand, r.ev_typeAccel_otherStall, r.ev_atm_neighbor, r.ev_ret_vol_expand) == want
        last[r.symbol] = r.e_compression
