"""Composition scans against the plain loops, cut into short stretches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, scans


@pytest.fixture(scope="module")
def walk(spark):
    draw = random.Random(3)
    rows, now = [], 100.0
    for symbol, n in (("A", 300), ("B", 45), ("C", 4)):
        for k in range(n):
            now = max(5.0, now + draw.uniform(-2, 2))
            rows.append((symbol, datetime(2024, 1, 30) + timedelta(minutes=47 * k), now, now + draw.random(), now - draw.random(), now + draw.uniform(-0.5, 0.5), draw.randrange(4)))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, label int").repartition(5)


def arrays(frame, symbol):
    rows = sorted((r for r in frame.collect() if r.symbol == symbol), key=lambda r: r.ts)
    return [np.array([r[c] for r in rows], float) for c in ("high", "low", "close", "label")]


def column(out, symbol, name):
    return np.array([np.nan if r[name] is None else r[name] for r in sorted((r for r in out if r.symbol == symbol), key=lambda r: r.ts)], float)


@pytest.mark.parametrize("span", ["hour", "day", "year"])
def test_affine_scans(walk, span):
    made = {
        "ema": (scans.ema(walk, 7, "y", span=span).collect(), lambda h, low, c: indicators.ema_of(c, 7)),
        "wilder": (scans.wilder(walk, 5, "y", scans.true_range(), span).collect(), lambda h, low, c: indicators.wilder_of(indicators.true_range_of(h, low, c), 5)),
        "kama": (scans.kama(walk, "y", span=span).collect(), lambda h, low, c: indicators.kama_of(c)),
    }
    for name, (out, loop) in made.items():
        for symbol in "ABC":
            h, low, c, _ = arrays(walk, symbol)
            np.testing.assert_allclose(column(out, symbol, "y"), loop(h, low, c), rtol=1e-11, err_msg=f"{name} {symbol}")


def test_null_values_are_passed_over(spark, walk):
    holes = walk.withColumn("close", F.when(F.minute("ts") % 3 > 0, F.col("close")))
    out = {(r.symbol, r.ts): r.y for r in scans.ema(holes, 4, "y", span="day").collect()}
    rows = sorted((r.ts, r.close) for r in holes.collect() if r.symbol == "A" and r.close is not None)
    want = indicators.ema_of(np.array([c for _, c in rows]), 4)
    got = [out["A", t] for t, _ in rows]
    np.testing.assert_allclose([np.nan if g is None else g for g in got], want, rtol=1e-11)
    assert scans.ema(walk.limit(0), 4, "y").count() == 0 and scans.smoothed(walk.limit(0), "label", "y").count() == 0


@pytest.mark.parametrize("persist, hysteresis", [(2, 1), (3, 0), (1, 2)])
def test_smoothing_by_composed_states(walk, persist, hysteresis):
    sticky = walk.withColumn("label", F.when(F.col("label") > 1, 0).otherwise(F.col("label") + F.floor(F.hour("ts") / 8)).cast("int"))
    out = scans.smoothed(sticky, "label", "y", 4, persist, hysteresis, span="day").collect()
    for symbol in "ABC":
        raw = arrays(sticky, symbol)[3].astype(int)
        now, need, contender, run, want = raw[0], persist, None, 0, []
        for x in raw:
            if x == now:
                contender, run = None, 0
            else:
                run = run + 1 if x == contender else 1
                contender = x
                if run >= need:
                    now, need, contender, run = x, persist + hysteresis, None, 0
            want.append(now)
        assert column(out, symbol, "y").astype(int).tolist() == want


def test_carried_opinions(walk):
    told = scans.carried(walk, F.when(F.col("label") == 3, F.col("close")), "y", span="day")
    assert "label" in told.columns
    out = told.collect()
    for symbol in "AB":
        _, _, c, label = arrays(walk, symbol)
        last, want = np.nan, []
        for x, k in zip(c, label, strict=True):
            last = x if k == 3 else last
            want.append(last)
        np.testing.assert_array_equal(column(out, symbol, "y"), want)
