"""Indicators with memory and rules against plain loops over one series."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as ind

N = 320


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(12)
    c = np.round(100 + np.cumsum(rng.normal(0, 1.2, N)) + 6 * np.sin(np.arange(N) / 9), 1)
    o = np.concatenate([[100.0], c[:-1]])
    h, low = np.maximum(o, c) + np.round(rng.random(N), 1), np.minimum(o, c) - np.round(rng.random(N), 1)
    h[50:58], low[50:58] = np.linspace(h[49], h[49] - 1, 8), np.linspace(low[49], low[49] + 1, 8)  # a run of inside bars
    v = np.round(rng.gamma(2, 50, N))
    return o, h, low, c, v


@pytest.fixture(scope="module")
def bars(spark, raw):
    start = datetime(2024, 1, 2, 4)
    rows = [("A", start + timedelta(hours=k), *(float(x[k]) for x in raw)) for k in range(N)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)


def _same(got, want):
    assert len(got) == len(want)
    for k, (a, b) in enumerate(zip(got, want, strict=True)):
        assert (a is None or math.isnan(a)) == (b is None or math.isnan(b)), k
        assert a is None or math.isnan(a) or a == pytest.approx(b, rel=1e-9, abs=1e-9), k


def test_adaptive_mean(raw):
    c, want, p = raw[3], [math.nan] * N, 10
    now = want[p] = sum(c[1 : p + 1]) / p
    for i in range(p + 1, N):
        path = sum(abs(c[j] - c[j - 1]) for j in range(i - p + 1, i + 1))
        e = abs(c[i] - c[i - p]) / path if path else 0
        now = want[i] = now + (e * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (c[i] - now)
    _same(ind.kama_of(c), want)


def test_fisher(raw):
    _, h, low, _, _ = raw
    want, f = [math.nan] * 9, 0.0
    for i in range(9, N):
        mids = [(h[j] + low[j]) / 2 for j in range(i - 9, i + 1)]
        span = max(mids) - min(mids)
        x = max(-0.999, min(0.999, 2 * ((mids[-1] - min(mids)) / span - 0.5) if span else 0.0))
        f = math.log((1 + x) / (1 - x)) / 2 + f / 2
        want.append(f)
    _same(ind.fisher_of(h, low), want)


def test_filters(raw):
    c = raw[3].tolist()
    at = lambda x, k: x[k] if k >= 0 else 0.0
    smooth = [(at(c, k) + 2 * at(c, k - 1) + 2 * at(c, k - 2) + at(c, k - 3)) / 6 for k in range(N)]
    cycle: list[float] = []
    for k in range(N):
        cycle.append(0.965**2 * (smooth[k] - 2 * at(smooth, k - 1) + at(smooth, k - 2)) + 1.86 * at(cycle, k - 1) - 0.93**2 * at(cycle, k - 2))
    _same(ind.cyber_of(raw[3])[7:], cycle[7:])
    a = math.exp(-1.414 * 3.14159 / 10)
    b = 2 * a * math.cos(1.414 * 3.14159 / 10)
    high, low = [0.0, 0.0], [0.0, 0.0]
    for k in range(2, N):
        high.append((1 + 0.965**2 - 1.86 - 0.93**2) / 4 * (c[k] - 2 * c[k - 1] + c[k - 2]) + 1.86 * high[-1] - 0.93**2 * high[-2])
        low.append((1 + b + a * a) / 4 * (high[k] + high[k - 1]) + b * low[-1] - a * a * low[-2])
    trend, trigger = ind.itrend_of(raw[3])
    _same(trend[3:], [(low[k] + 2 * low[k - 1] + low[k - 2]) / 4 for k in range(3, N)])
    _same(trigger[4:], trend[3:-1])


def test_double_mean_has_a_zero_filled_inner_mean(raw):
    c = raw[3]
    one = ind.ema_of(c, 20)
    inner = [math.nan] * 19 + [one[19] / 20]
    for k in range(20, N):
        inner.append(inner[-1] + 2 / 21 * (one[k] - inner[-1]))
    dema = ind.KERNELS["dema"][1](*raw)[0]
    _same(dema[19:], [2 * one[k] - inner[k] for k in range(19, N)])


def test_connors(raw):
    c = raw[3]
    streak = [0]
    for k in range(1, N):
        way = int(c[k] > c[k - 1]) - int(c[k] < c[k - 1])
        streak.append(way * (abs(streak[-1]) + 1 if way * streak[-1] > 0 else 1))
    assert ind.streak_of(c).tolist() == streak
    d = [math.nan, *(c[k] - c[k - 1] for k in range(1, N))]
    for k in range(100, N, 7):
        rank = sum(d[j] < d[k] for j in range(k - 99, k + 1))
        assert ind.connors_of(c)[k] == pytest.approx((ind.rsi_of(c, 3)[k] + ind.rsi_of(np.array(streak, float), 2)[k] + rank) / 3)


def test_hilbert_finds_a_known_cycle():
    t = np.arange(600)
    for cycle in (14, 20, 30):
        period, _ = ind.hilbert_of(100 + 5 * np.sin(2 * np.pi * t / cycle))
        assert np.nanmedian(period[200:]) == pytest.approx(cycle, rel=0.2)
    period, _ = ind.hilbert_of(100 + np.cumsum(np.random.default_rng(1).normal(size=400)))
    there = period[~np.isnan(period)]
    assert there.min() >= 6 and there.max() <= 50 and (there[1:] / there[:-1]).max() <= 1.125 + 1e-9
    assert ind.adaptive_length(np.array([np.nan, 9.0, 200.0]), 14, 2, 50).tolist() == [14, 5, 50]


def _positions(bars, rule):
    return [r.position for r in ind.signals(bars, rule).orderBy("ts").collect()]


def _held(opinions):
    out, now = [], 0
    for x in opinions:
        now = now if x is None else x
        out.append(now)
    return out


def test_inside_bars(bars, raw):
    _, h, low, c, _ = raw
    said, k = [None], 1
    while k < N:
        run = k
        while run < N and h[run] <= h[run - 1] and low[run] >= low[run - 1]:
            said.append(None)
            run += 1
        if run < N:
            mother = k - 1
            said.append((1 if c[run] > h[mother] else -1 if c[run] < low[mother] else None) if run > k else None)
        k = run + 1
    got = _positions(bars, "InsideBar")
    assert got == _held(said) and {-1, 1} <= set(got)


def test_narrow_ranges(bars, raw):
    _, h, low, c, _ = raw
    setups = [k for k in range(6, N) if h[k] - low[k] <= min(h[j] - low[j] for j in range(k - 6, k + 1)) + 1e-12]
    said: list = [None] * N
    for s in setups:
        for k in range(s + 1, min(s + 4, N)):
            if k in setups:
                break
            if c[k] > h[s] or c[k] < low[s]:
                said[k] = 1 if c[k] > h[s] else -1
                break
    got = _positions(bars, "NR7")
    assert got == _held(said) and {-1, 1} <= set(got)


def test_volume_divergence(bars, raw):
    o, _, _, c, v = raw
    flow = [r.f for r in bars.withColumn("f", ind.cvd()).orderBy("ts").collect()]
    said: list = [0] * 40
    for k in range(40, N):
        frame = list(range(k - 39, k))
        pick = lambda best: (k - 1) if c[k - 1] == best else next(j for j in frame if c[j] == best)  # noqa: B023, E731
        lo, hi = pick(min(c[j] for j in frame)), pick(max(c[j] for j in frame))
        said.append(1 if c[k] < c[lo] and flow[k] > flow[lo] else -1 if c[k] > c[hi] and flow[k] < flow[hi] else None)
    assert _positions(bars, "CVD") == _held(said)


def test_widths(bars, raw):
    c = raw[3]
    sd = [float(np.std(c[max(0, k - 19) : k + 1])) for k in range(N)]
    mid = [float(np.mean(c[max(0, k - 19) : k + 1])) for k in range(N)]
    width = [4 * s / abs(m) for s, m in zip(sd, mid, strict=True)]
    ema = ind.ema_of(c, 30)
    wide, gate = [0] * 19, [0] * 29
    for k in range(19, N):
        frame = width[max(20, k - 99) : k + 1] if k >= 20 else []
        wide.append((1 if c[k] > mid[k] else -1) if frame and width[k] > 1.5 * min(frame) else None)
        if k >= 29:
            rank = 100 * sum(w <= width[k] + 1e-15 for w in frame) / max(len(frame), 1)
            gate.append(None if len(frame) < 20 else 0 if rank < 40 else 1 if c[k] > ema[k] else -1)
    assert _positions(bars, "BBWidth") == _held(wide)
    assert _positions(bars, "VolReg") == _held(gate)


def test_releases(bars, raw):
    _, h, low, c, v = raw
    a, e = ind.wilder_of(ind.true_range_of(h, low, c), 20), ind.ema_of(c, 20)
    on = [k >= 19 and np.mean(c[k - 19 : k + 1]) - 2 * np.std(c[k - 19 : k + 1]) > e[k] - 1.5 * a[k] and np.mean(c[k - 19 : k + 1]) + 2 * np.std(c[k - 19 : k + 1]) < e[k] + 1.5 * a[k] for k in range(N)]
    said, loud = [0] * 19, [0] * 19
    for k in range(19, N):
        side = 1 if c[k] - np.mean([(h[j] + low[j]) / 2 for j in range(k - 19, k + 1)]) > 0 else -1
        fired = on[k - 1] and not on[k]
        said.append(side if fired else None)
        loud.append(side if fired and v[k] > 2 * np.mean(v[k - 19 : k + 1]) else None)
    assert _positions(bars, "Squeeze") == _held(said)
    assert _positions(bars, "SqueezeBreak") == _held(loud)


def test_every_rule_is_causal_and_in_range(bars):
    rules = [*ind.RULES, *ind.KERNEL_RULES]
    whole = {(r.rule, r.ts): r.position for r in ind.signals(bars, *rules).collect()}
    cut = bars.where("ts < timestamp_ntz'2024-01-10 00:00:00'")
    part = {(r.rule, r.ts): r.position for r in ind.signals(cut, *rules).collect()}
    assert set(whole.values()) <= {-1, 0, 1} and len(part) == len(rules) * cut.count()
    assert all(whole[k] == p for k, p in part.items())
    assert all(p == 0 for (rule, _), p in whole.items() if rule == "HilbertDC")


def test_regimes(bars):
    labelled = ind.regimes(bars)
    assert {r.regime for r in labelled.select("regime").distinct().collect()} <= {0, 1, 2, 3}
    rows = ind.smooth_regimes(labelled, 4, 2).orderBy("ts").collect()
    now, need, run, rival, want = rows[0].regime, 4, 0, None, []
    for r in rows:
        if r.regime == now:
            run, rival = 0, None
        else:
            run, rival = (run + 1, rival) if r.regime == rival else (1, r.regime)
            if run >= need:
                now, need, run, rival = rival, 6, 0, None
        want.append(now)
    assert [r.smoothed for r in rows] == want
    f = ind.regime_features(bars)
    assert f.count() == N and f.where(" or ".join(f"f{k} is null" for k in range(10))).count() == 0
