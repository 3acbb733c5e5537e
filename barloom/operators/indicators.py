"""Indicators and signal rules.

Whatever a frame can say is a window expression; true recurrences (EMA, Wilder means, adaptive means, carried bands) run
one symbol at a time in grouped Arrow functions, on series bounded by time.  Warm-up is null.  A signal is -1, 0 or 1;
a rule without an opinion keeps the last one, and warm-up bars are flat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import day_key, guarded, ratio, series

# --- frames ----------------------------------------------------------------------------------------------------------


def _mean(value: Column, p: int, w) -> Column:
    frame = w.rowsBetween(-(p - 1), 0)
    return guarded(F.avg(value).over(frame), F.count(value).over(frame), p)


def sma(p: int, c: str = "close") -> Column:
    return _mean(F.col(c), p, series())


def wma(p: int, c: str = "close") -> Column:
    """Weights 1 to p, newest heaviest."""
    frame = F.collect_list(c).over(series().rowsBetween(-(p - 1), 0))
    total = F.aggregate(frame, F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("k")), lambda a, x: F.struct((a["s"] + x * a["k"]).alias("s"), (a["k"] + 1).alias("k")))
    return F.when(F.size(frame) == p, total["s"] / (p * (p + 1) / 2))


def bollinger(p: int = 20, m: float = 2.0) -> tuple[Column, Column, Column]:
    w = series().rowsBetween(-(p - 1), 0)
    n = F.count("close").over(w)
    mid, sd = F.avg("close").over(w), F.stddev_pop("close").over(w)
    return guarded(mid - m * sd, n, p), guarded(mid, n, p), guarded(mid + m * sd, n, p)


def stochastic(k: int = 14) -> Column:
    w = series().rowsBetween(-(k - 1), 0)
    high, low = F.max("high").over(w), F.min("low").over(w)
    return guarded(F.coalesce(ratio(F.col("close") - low, high - low) * 100, F.lit(50.0)), F.count("close").over(w), k)


def vwap() -> Column:
    """Session VWAP of the typical price."""
    w = Window.partitionBy("symbol", day_key(F.col("ts"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.coalesce(ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)), typical)


def vwap_bands(sd: float = 1.0) -> tuple[Column, Column]:
    w = Window.partitionBy("symbol", day_key(F.col("ts"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.stddev_pop((F.col("high") + F.col("low") + F.col("close")) / 3).over(w) * sd
    return vwap() - spread, vwap() + spread


def cvd() -> Column:
    """Session sum of volume signed by the candle's direction."""
    w = Window.partitionBy("symbol", day_key(F.col("ts"))).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(-F.col("volume"))).over(w)


def vwma(p: int = 20) -> Column:
    w = series().rowsBetween(-(p - 1), 0)
    return guarded(ratio(F.sum(F.col("close") * F.col("volume")).over(w), F.sum("volume").over(w)), F.count("close").over(w), p)


def cmo(p: int = 14) -> Column:
    """Needs ``change``, the close's difference."""
    w = series().rowsBetween(-(p - 1), 0)
    up, down = F.sum(F.greatest(F.col("change"), F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).over(w)
    return guarded(F.coalesce(ratio(up - down, up + down) * 100, F.lit(0.0)), F.count("change").over(w), p)


def aroon(p: int = 14) -> Column:
    """Up minus down: bars since the extreme of the last p + 1, the earlier of equal extremes counts."""
    w = series().rowsBetween(-p, 0)
    highs, lows = F.collect_list("high").over(w), F.collect_list("low").over(w)
    up, down = F.array_position(highs, F.array_max(highs)), F.array_position(lows, F.array_min(lows))
    return F.when(F.size(highs) == p + 1, (up - down) * 100.0 / p)


def choppiness(p: int = 14, total: bool = False) -> Column:
    """Of the mean (or total) true range to the frame's range; needs ``true_range``."""
    w = series().rowsBetween(-(p - 1), 0)
    of = F.sum("true_range").over(w) if total else F.avg("true_range").over(w)
    span = F.max("high").over(w) - F.min("low").over(w)
    return guarded(F.log10(F.nullif(ratio(of, span), F.lit(0.0))) / float(np.log10(p)) * 100, F.count("true_range").over(w), p)


def efficiency(p: int = 10) -> Column:
    """Kaufman's ratio of net to total movement; needs ``change``."""
    w = series().rowsBetween(-(p - 1), 0)
    return guarded(ratio(F.abs(F.col("close") - F.lag("close", p).over(series())), F.sum(F.abs("change")).over(w)), F.count("change").over(w), p)


def slope(p: int = 20, log: bool = False) -> Column:
    """Least-squares slope per bar of the close or its logarithm; needs ``bar`` (row number)."""
    w = series().rowsBetween(-(p - 1), 0)
    y = F.ln("close") if log else F.col("close")
    return guarded(ratio(F.covar_pop(y, F.col("bar")).over(w), F.var_pop("bar").over(w)), F.count("close").over(w), p)


def iv_rank(width: int = 20, history: int = 250, least: int = 100) -> Column:
    """Mid-rank percentile of ``realized_vol`` in its own history."""
    frame = F.collect_list("realized_vol").over(series().rowsBetween(-(history - 1), 0))
    under = F.size(F.filter(frame, lambda x: x < F.col("realized_vol")))
    same = F.size(F.filter(frame, lambda x: x == F.col("realized_vol")))
    return F.when(F.size(frame) >= least, (under + same / 2) / F.size(frame) * 100)


def poc(lookback: int = 60, bins: int = 24) -> Column:
    """Price of the fullest of 24 volume bins over the frame; a bar counts at its close, one without volume as 1."""
    w = series().rowsBetween(-(lookback - 1), 0)
    bars = F.collect_list(F.struct("close", "volume")).over(w)
    low, high = F.min("low").over(w), F.max("high").over(w)
    width = (high - low) / bins
    place = lambda x: F.least(F.floor(ratio(x["close"] - low, width)), F.lit(bins - 1))
    held = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(F.aggregate(bars, F.lit(0.0), lambda a, x: a + F.when(place(x) == b, F.when(x["volume"] > 0, x["volume"]).otherwise(1.0)).otherwise(0.0)).alias("v"), (-b).alias("b")))
    return F.when((F.size(bars) == lookback) & (width > 0), low + (0.5 - F.array_max(held)["b"]) * width)


# --- recurrences -----------------------------------------------------------------------------------------------------


def _smoothed(x: np.ndarray, p: int, k: float) -> np.ndarray:
    """Exponential mean with weight ``k``, seeded by the mean of the first ``p`` values; NaN before."""
    out = np.full(len(x), np.nan)
    first = np.flatnonzero(~np.isnan(x))
    if len(first) and len(x) - first[0] >= p:
        at = first[0] + p - 1
        now = out[at] = x[first[0] : at + 1].mean()
        for i in range(at + 1, len(x)):
            now += k * (x[i] - now)
            out[i] = now
    return out


def ema_of(x: np.ndarray, p: int) -> np.ndarray:
    return _smoothed(x, p, 2 / (p + 1))


def wilder_of(x: np.ndarray, p: int) -> np.ndarray:
    return _smoothed(x, p, 1 / p)


def true_range_of(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], c[:-1]))
    return np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))


def rsi_of(c: np.ndarray, p: int = 14) -> np.ndarray:
    d = np.concatenate(([np.nan], np.diff(c)))
    up, down = wilder_of(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), p), wilder_of(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), p)
    rs = np.where(down == 0, 100.0, up / np.where(down == 0, 1, down))
    return 100 - 100 / (1 + rs)


def supertrend_of(h, low, c, p: int = 10, m: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction): bands move only towards the price until it crosses them."""
    a = wilder_of(true_range_of(h, low, c), p)
    mid = (h + low) / 2
    line, way = np.full(len(c), np.nan), np.zeros(len(c))
    floor = roof = np.nan
    now = 1.0
    for i in np.flatnonzero(~np.isnan(a)):
        lo, hi = mid[i] - m * a[i], mid[i] + m * a[i]
        if not np.isnan(floor):
            now = 1.0 if c[i] > roof else -1.0 if c[i] < floor else now
            lo = max(lo, floor) if c[i - 1] > floor else lo
            hi = min(hi, roof) if c[i - 1] < roof else hi
        floor, roof = lo, hi
        line[i], way[i] = (floor if now > 0 else roof), now
    return line, way


def adx_of(h, low, c, p: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ADX, +DI, -DI) by Wilder means."""
    up, down = np.concatenate(([np.nan], np.diff(h))), np.concatenate(([np.nan], -np.diff(low)))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus[:1] = minus[:1] = np.nan
    tr = true_range_of(h, low, c)
    tr[:1] = np.nan
    a = wilder_of(tr, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        pdi, mdi = 100 * wilder_of(plus, p) / a, 100 * wilder_of(minus, p) / a
        dx = 100 * np.abs(pdi - mdi) / (pdi + mdi)
    return wilder_of(np.where(np.isnan(pdi), np.nan, np.nan_to_num(dx)), p), pdi, mdi


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` k bars ago, 0 before the series starts."""
    return np.concatenate([np.zeros(min(k, len(x))), x[: max(len(x) - k, 0)]])


def _filtered(drive: np.ndarray, first: float, second: float) -> np.ndarray:
    """y[i] = drive[i] + first * y[i-1] + second * y[i-2], from zero."""
    out = np.zeros(len(drive))
    one = two = 0.0
    for i, x in enumerate(drive.tolist()):
        one, two = x + first * one + second * two, one
        out[i] = one
    return out


def kama_of(c: np.ndarray, p: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive mean: seeded at bar p (from 0) by the mean of bars 1 to p, then moved by the squared efficiency weight."""
    out = np.full(len(c), np.nan)
    if len(c) <= p:
        return out
    path = np.cumsum(np.abs(np.diff(c, prepend=c[0])))
    total, net = path[p:] - path[:-p], np.abs(c[p:] - c[:-p])
    er = np.divide(net, total, out=np.zeros_like(net), where=total > 0)
    low = 2 / (slow + 1)
    weight = (er * (2 / (fast + 1) - low) + low) ** 2
    now = out[p] = c[1 : p + 1].mean()
    for i in range(p + 1, len(c)):
        now += weight[i - p] * (c[i] - now)
        out[i] = now
    return out


def fisher_of(h, low, p: int = 10) -> np.ndarray:
    """Fisher transform of the median price's place in its range, half of the last value added."""
    mid = (h + low) / 2
    out = np.full(len(mid), np.nan)
    if len(mid) < p:
        return out
    frames = np.lib.stride_tricks.sliding_window_view(mid, p)
    bottom, span = frames.min(1), np.ptp(frames, axis=1)
    place = np.divide(mid[p - 1 :] - bottom, span, out=np.full(len(span), 0.5), where=span > 0)
    v = np.clip(2 * place - 1, -0.999, 0.999)
    out[p - 1 :] = _filtered(np.arctanh(v), 0.5, 0.0)
    return out


def cyber_of(c: np.ndarray, alpha: float = 0.07) -> np.ndarray:
    """Two-pole high pass of a four-bar smooth, from zeros; the first seven bars are warm-up."""
    smooth = (c + 2 * _lagged(c, 1) + 2 * _lagged(c, 2) + _lagged(c, 3)) / 6
    bend = smooth - 2 * _lagged(smooth, 1) + _lagged(smooth, 2)
    out = _filtered((1 - alpha / 2) ** 2 * bend, 2 * (1 - alpha), -((1 - alpha) ** 2))
    out[:7] = np.nan
    return out


# Coefficients of the published filters.
SMOOTH_A = np.exp(-1.414 * 3.14159 / 10)
SMOOTH_B = 2 * SMOOTH_A * np.cos(1.414 * 3.14159 / 10)
HILBERT = (0.0962, 0.5769)
PERIODS = (6.0, 50.0)
GROWTH = (0.67, 1.5)


def itrend_of(c: np.ndarray, alpha: float = 0.07) -> tuple[np.ndarray, np.ndarray]:
    """(trend, trigger): a high pass, smoothed twice and averaged over four bars; the trigger is the trend a bar ago."""
    first, second = 2 * (1 - alpha), (1 - alpha) ** 2
    bend = np.zeros(len(c))
    bend[2:] = c[2:] - 2 * c[1:-1] + c[:-2]
    high = _filtered((1 + (1 - alpha / 2) ** 2 - first - second) / 4 * bend, first, -second)
    drive = (1 + SMOOTH_B + SMOOTH_A**2) / 4 * (high + _lagged(high, 1))
    drive[:2] = 0.0
    smooth = _filtered(drive, SMOOTH_B, -(SMOOTH_A**2))
    trend = (smooth + 2 * _lagged(smooth, 1) + _lagged(smooth, 2)) / 4
    trigger = _lagged(trend, 1)
    trend[:3] = trigger[:3] = np.nan
    return trend, trigger


def _quadrature(x: np.ndarray) -> np.ndarray:
    a, b = HILBERT
    return a * x + b * _lagged(x, 2) - b * _lagged(x, 4) - a * _lagged(x, 6)


def hilbert_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dominant cycle in bars, 1 where it is steady): homodyne of a Hilbert transformer, its rate of change limited."""
    smooth = np.concatenate([c[:3], (c[3:] + 2 * c[2:-1] + 2 * c[1:-2] + c[:-3]) / 6]) if len(c) > 3 else c.copy()
    settled = np.arange(len(c)) >= 6
    detrended = np.where(settled, _quadrature(smooth), 0.0)
    quad = np.where(settled, _quadrature(detrended), 0.0)
    phase = np.where(settled, _lagged(detrended, 3), 0.0)
    turned, crossed = np.where(settled, _quadrature(phase), 0.0), np.where(settled, _quadrature(quad), 0.0)
    i2, q2 = _filtered(0.2 * np.where(settled, phase - crossed, 0.0), 0.8, 0.0), _filtered(0.2 * np.where(settled, quad + turned, 0.0), 0.8, 0.0)
    before_i, before_q = _lagged(i2, 1), _lagged(q2, 1)
    real = _filtered(0.2 * np.where(settled, i2 * before_i + q2 * before_q, 0.0), 0.8, 0.0)
    imag = _filtered(0.2 * np.where(settled, i2 * before_q - q2 * before_i, 0.0), 0.8, 0.0)
    period, steady = np.full(len(c), np.nan), np.zeros(len(c))
    last = 0.0
    for i in np.flatnonzero((real != 0) & (imag != 0)):
        raw = 6.2831853 / np.arctan(imag[i] / real[i])
        if last:
            raw = max(min(raw, GROWTH[1] * last), GROWTH[0] * last)
        raw = min(max(raw, PERIODS[0]), PERIODS[1])
        now = 0.25 * raw + 0.75 * (last or raw)
        steady[i] = abs(now - (period[i - 1] if not np.isnan(period[i - 1]) else now)) < 2
        period[i] = last = now
    return period, steady


def adaptive_length(cycle: np.ndarray, base: int, least: int, most: int, part: float = 0.5) -> np.ndarray:
    """Bars to look back: a part of the cycle, rounded half up and held between bounds; ``base`` without a cycle."""
    whole = np.floor(np.nan_to_num(cycle) * part + 0.5)
    return np.where(np.isnan(cycle), base, np.clip(whole, least, most)).astype(int)


def _over(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the last ``length[i]`` values at i."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    at = np.arange(len(x))
    return sums[at + 1] - sums[np.maximum(at + 1 - length, 0)]


def adaptive_of(c: np.ndarray, settle: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cycle, steady, RSI of half a cycle by plain sums, place in bands of a cycle); null until the cycle has settled."""
    cycle, steady = hilbert_of(c)
    at = np.arange(len(c))
    change = np.diff(c, prepend=c[:1])
    short, full = adaptive_length(cycle, 14, 2, 50), adaptive_length(cycle, 20, 10, 50, 1.0)
    up, down = _over(np.maximum(change, 0), short), _over(np.maximum(-change, 0), short)
    rs = np.where(down <= 1e-12, 100.0, up / np.maximum(down, 1e-12))
    mean = _over(c, full) / full
    sd = np.sqrt(np.maximum(_over(c * c, full) / full - mean**2, 0))
    place = (c - (mean - 2 * sd)) / np.maximum(4 * sd, 1e-12)
    ready = at >= settle
    return cycle, steady, np.where(ready & (at >= short), 100 - 100 / (1 + rs), np.nan), np.where(ready & (at >= full), place, np.nan)


def streak_of(c: np.ndarray) -> np.ndarray:
    """Bars in a row that closed up (positive) or down (negative)."""
    way = np.sign(np.diff(c, prepend=c[:1]))
    at = np.arange(len(c))
    turn = np.concatenate([[True], way[1:] != way[:-1]])
    start = np.maximum.accumulate(np.where(turn, at, 0))
    return way * (at - start + 1) * (way != 0)


def connors_of(c: np.ndarray, p: int = 3, streak: int = 2, rank: int = 100) -> np.ndarray:
    """Mean of the RSI, the RSI of the streak and the percent rank of the last difference."""
    d = np.diff(c, prepend=np.nan)
    place = np.full(len(c), np.nan)
    if len(c) > rank:
        frames = np.lib.stride_tricks.sliding_window_view(d[1:], rank)
        place[rank:] = (frames < d[rank:, None]).mean(1) * 100
    return (rsi_of(c, p) + rsi_of(streak_of(c), streak) + place) / 3


def gap_bias_of(h, low, c, most: int = 5, age: int = 60) -> np.ndarray:
    """Side of the youngest live fair-value gap that the bar touches, else 0; a gap dies when closed through or old."""
    up = np.flatnonzero(low[2:] > h[:-2]) + 2
    down = np.flatnonzero((h[2:] < low[:-2]) & ~(low[2:] > h[:-2])) + 2
    born = {int(i): (1, h[i - 2], low[i]) for i in up} | {int(i): (-1, h[i], low[i - 2]) for i in down}
    out, live = np.zeros(len(c)), []
    for i in range(len(c)):
        live = (live + [(i, *born[i])] if i in born else live)[-most:]
        live = [z for z in live if i - z[0] <= age and not (z[1] > 0 and c[i] < z[2]) and not (z[1] < 0 and c[i] > z[3])]
        edge = [z[1] for z in live if z[2] <= (low[i] if z[1] > 0 else h[i]) <= z[3]]
        out[i] = edge[-1] if edge else 0
    return out


def _macd(c, fast=12, slow=26, signal=9):
    line = ema_of(c, fast) - ema_of(c, slow)
    return line, ema_of(line, signal)


#: name: function of (open, high, low, close, volume) arrays; each makes the columns named
KERNELS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "ema": (("ema_20", "ema_50"), lambda o, h, low, c, v: (ema_of(c, 20), ema_of(c, 50))),
    "ema_30": (("ema_30",), lambda o, h, low, c, v: (ema_of(c, 30),)),
    "ribbon": (("ema_5", "ema_13", "ema_34"), lambda o, h, low, c, v: tuple(ema_of(c, p) for p in (5, 13, 34))),
    "slow_ribbon": (("ema_8", "ema_21", "ema_55"), lambda o, h, low, c, v: tuple(ema_of(c, p) for p in (8, 21, 55))),
    # the inner mean starts from zeros where the outer one is not there yet
    "dema": (("dema",), lambda o, h, low, c, v: (2 * ema_of(c, 20) - ema_of(np.nan_to_num(ema_of(c, 20)), 20),)),
    "rsi": (("rsi",), lambda o, h, low, c, v: (rsi_of(c),)),
    "atr": (("atr",), lambda o, h, low, c, v: (wilder_of(true_range_of(h, low, c), 14),)),
    "macd": (("macd", "macd_signal"), lambda o, h, low, c, v: _macd(c)),
    "keltner": (("keltner_low", "keltner_high"), lambda o, h, low, c, v: (ema_of(c, 20) - 2 * wilder_of(true_range_of(h, low, c), 10), ema_of(c, 20) + 2 * wilder_of(true_range_of(h, low, c), 10))),
    "supertrend": (("supertrend", "supertrend_dir"), lambda o, h, low, c, v: supertrend_of(h, low, c)),
    "adx": (("adx", "plus_di", "minus_di"), lambda o, h, low, c, v: adx_of(h, low, c)),
    "kama": (("kama",), lambda o, h, low, c, v: (kama_of(c),)),
    "fisher": (("fisher",), lambda o, h, low, c, v: (fisher_of(h, low),)),
    "cyber": (("cyber",), lambda o, h, low, c, v: (cyber_of(c),)),
    "itrend": (("itrend", "itrend_trigger"), lambda o, h, low, c, v: itrend_of(c)),
    "adaptive": (("cycle", "cycle_steady", "adaptive_rsi", "adaptive_place"), lambda o, h, low, c, v: adaptive_of(c)),
    "connors": (("connors_rsi",), lambda o, h, low, c, v: (connors_of(c),)),
    "squeeze": (("squeeze_low", "squeeze_high"), lambda o, h, low, c, v: tuple(ema_of(c, 20) + k * 1.5 * wilder_of(true_range_of(h, low, c), 20) for k in (-1, 1))),
    "atr_10": (("atr_10",), lambda o, h, low, c, v: (wilder_of(true_range_of(h, low, c), 10),)),
    "fvg": (("fvg_bias",), lambda o, h, low, c, v: (gap_bias_of(h, low, c),)),
}


def recurrences(bars: DataFrame, *names: str) -> DataFrame:
    """``bars`` with the columns of the named kernels; one symbol's bars are one group, bounded by time."""
    made = [(k, col) for n in names for k, col in ((n, c) for c in KERNELS[n][0])]
    kept = ["symbol", "ts", "open", "high", "low", "close", "volume"]

    def run(frame):
        frame = frame.sort_values("ts").reset_index(drop=True)
        arrays = [frame[c].to_numpy(float) for c in kept[2:]]
        for n in names:
            for col, x in zip(KERNELS[n][0], KERNELS[n][1](*arrays), strict=True):
                frame[col] = [None if np.isnan(y) else float(y) for y in x]
        return frame

    schema = ", ".join(["symbol string, ts timestamp_ntz", *[f"{c} double" for c in kept[2:]], *[f"{c} double" for _, c in made]])
    return bars.select(*kept).groupBy("symbol").applyInPandas(run, schema)


# --- rules -----------------------------------------------------------------------------------------------------------


def hold(opinion: Column, warm: Column) -> Column:
    """Opinions carried on; a bar that is not warm is flat, and later bars start from there."""
    return F.coalesce(F.last(F.when(~warm, F.lit(0)).otherwise(opinion), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def above(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0).when(a > b, 1).otherwise(-1)


def fade(x: Column, low: float, high: float) -> Column:
    """Long below ``low``, short above ``high``, else as before."""
    return hold(F.when(x < low, 1).when(x > high, -1), x.isNotNull())


def follow(x: Column, level: float) -> Column:
    return hold(F.when(x > level, 1).when(x < -level, -1), x.isNotNull())


def prepare(bars: DataFrame) -> DataFrame:
    """Helper columns that rules read: change, true_range, bar, inside (as its number in a run; the run's mother bar is 1), setups, realized_vol."""
    inside = F.coalesce((F.col("high") <= F.lag("high").over(series())) & (F.col("low") >= F.lag("low").over(series())), F.lit(False))
    span = F.col("high") - F.col("low")
    narrow = (span <= F.min(span).over(series().rowsBetween(-6, 0)) + 1e-12) & (F.count(span).over(series().rowsBetween(-6, 0)) == 7)
    bars = bars.withColumns({"_mother": F.count_if(~inside).over(series()), "_setups": F.count_if(narrow).over(series()), "_setup": narrow})
    run = Window.partitionBy("symbol", "_mother").orderBy("ts")
    bars = bars.withColumns({"run": F.row_number().over(run), "mother_high": F.first("high").over(run), "mother_low": F.first("low").over(run)})
    before = F.lag("close").over(series())
    out = bars.withColumns(
        {
            "change": F.col("close") - before,
            "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            "bar": F.row_number().over(series()).cast("double"),
            "_log": F.ln(ratio(F.col("close"), before)),
        }
    )
    w = series().rowsBetween(-19, 0)
    return out.withColumn("realized_vol", guarded(F.stddev_samp("_log").over(w), F.count("_log").over(w), 20)).drop("_log")


def _breakout(width: int) -> Column:
    w = series().rowsBetween(-width, -1)
    c = F.col("close")
    return hold(F.when(c > F.max("high").over(w), 1).when(c < F.min("low").over(w), -1), F.count("close").over(w) >= width)


def _band(low: Column, high: Column) -> Column:
    c = F.col("close")
    return hold(F.when(c < low, 1).when(c > high, -1), low.isNotNull())


def _opening_range(minutes: int = 240, volume: float = 2.0) -> Column:
    """Break of the session's first ``minutes`` on high volume."""
    day = Window.partitionBy("symbol", day_key(F.col("ts")))
    start = F.min("ts").over(day)
    early = F.col("ts") < start + F.expr(f"INTERVAL {minutes} MINUTES")
    high, low = F.max(F.when(early, F.col("high"))).over(day), F.min(F.when(early, F.col("low"))).over(day)
    sure = ~early & (F.col("volume") > volume * _volume_mean())
    return hold(F.when(sure & (F.col("high") > high), 1).when(sure & (F.col("low") < low), -1), _volume_mean().isNotNull())


def _inside_bar(least: int = 1) -> Column:
    """The first bar that is not inside after ``least`` or more inside bars breaks the range of the bar before them."""
    was = lambda c: F.lag(c).over(series())
    high, low, c = was("mother_high"), was("mother_low"), F.col("close")
    ready = (F.col("run") == 1) & (was("run") > least) & (high > low)
    return hold(F.when(ready & (c > high), 1).when(ready & (c < low), -1), F.lit(True))


def _narrow_range(within: int = 3) -> Column:
    """After the narrowest bar of seven, the first close beyond it, within some bars."""
    armed = Window.partitionBy("symbol", "_setups").orderBy("ts")
    high, low, nth, c = F.first("high").over(armed), F.first("low").over(armed), F.row_number().over(armed), F.col("close")
    breaks = (F.col("_setups") > 0) & ~F.col("_setup") & (nth <= within + 1) & ((c > high) | (c < low))
    first = breaks & (F.count_if(breaks).over(armed) == 1)
    return hold(F.when(first & (c > high), 1).when(first & (c < low), -1), F.lit(True))


def _volume_mean(p: int = 20) -> Column:
    return _mean(F.col("volume"), p, series())


def _volume_spike(m: float = 2.0) -> Column:
    spike = F.col("volume") >= m * _volume_mean()
    return hold(F.when(spike, F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)), _volume_mean().isNotNull())


def _bias(mean: str) -> Column:
    return F.when(F.col("close") > F.col(mean), 1).otherwise(-1)


def _width() -> Column:
    low, mid, high = bollinger()
    return F.when(F.col("bar") > 20, (high - low) / F.greatest(F.abs(mid), F.lit(1e-12)))


def _band_width(m: float = 1.5, lookback: int = 100) -> Column:
    least = F.min(_width()).over(series().rowsBetween(-(lookback - 1), 0))
    mid = bollinger()[1]
    return hold(F.when(_width() > m * least, F.when(F.col("close") > mid, 1).otherwise(-1)), mid.isNotNull())


def _volatility_gate(gate: float = 40, lookback: int = 100, least: int = 20) -> Column:
    """Flat while the band's width is low in its own trailing rank, else with the mean; held while the rank is thin."""
    frame = F.collect_list(_width()).over(series().rowsBetween(-(lookback - 1), 0))
    rank = F.size(F.filter(frame, lambda x: x <= _width())) * 100.0 / F.size(frame)
    say = F.when(F.size(frame) >= least, F.when(rank < gate, 0).otherwise(_bias("ema_30")))
    return hold(say, F.col("ema_30").isNotNull() & bollinger()[1].isNotNull())


def _volume_divergence(lookback: int = 40) -> Column:
    """Price beyond its trailing extreme while the volume delta is on the other side of its value there."""
    w = series().rowsBetween(-(lookback - 1), -1)
    flow, c, last = cvd(), F.col("close"), F.lag("close").over(series())

    def then(extreme: Column, price: Column) -> Column:
        # of equal extremes the last bar counts, else the oldest
        return F.when(last == price, F.lag(flow).over(series())).otherwise(extreme["flow"])

    lows, highs = F.min(F.struct(c.alias("c"), F.col("bar"), flow.alias("flow"))).over(w), F.max(F.struct(c.alias("c"), (-F.col("bar")).alias("bar"), flow.alias("flow"))).over(w)
    up = (c < lows["c"]) & (flow > then(lows, lows["c"]))
    down = (c > highs["c"]) & (flow < then(highs, highs["c"]))
    return hold(F.when(up, 1).when(down, -1), F.col("bar") > lookback)


def _stochastic_cross(low: float = 20, high: float = 80, p: int = 3) -> Column:
    """%K against %D, its mean with 50 for the bars of the warm-up."""
    k = stochastic()
    d = _mean(F.coalesce(k, F.lit(50.0)), p, series())
    return hold(F.when((k < low) & (k > d), 1).when((k > high) & (k < d), -1), k.isNotNull())


def _releases() -> tuple[Column, Column]:
    """(momentum, whether a squeeze of the bands inside the channel ends at the bar)."""
    low, _, high = bollinger()
    on = (low > F.col("squeeze_low")) & (high < F.col("squeeze_high"))
    momentum = F.col("close") - _mean((F.col("high") + F.col("low")) / 2, 20, series())
    return F.when(F.col("squeeze_low").isNotNull() & low.isNotNull(), momentum), ~on & F.coalesce(F.lag(on).over(series()), F.lit(False))


def _squeeze(volume: float | None = None) -> Column:
    """Side of the momentum at the last release; with ``volume`` only releases on high volume count, once there has been any."""
    momentum, fired = _releases()
    if volume is not None:
        none = F.max("volume").over(series().rowsBetween(Window.unboundedPreceding, 0)) <= 0
        fired = fired & (none | (F.col("volume") > volume * _volume_mean()))
    warm = momentum.isNotNull() if volume is None else momentum.isNotNull() & _volume_mean().isNotNull()
    return hold(F.when(fired, F.when(momentum > 0, 1).otherwise(-1)), warm)


def _trend_regime(gate: float = 55) -> Column:
    hist, calm = F.col("macd") - F.col("macd_signal"), choppiness() < gate
    up, down = (F.col("supertrend_dir") > 0) & (hist > 0), (F.col("supertrend_dir") < 0) & (hist < 0)
    ready = choppiness().isNotNull() & F.col("supertrend").isNotNull() & hist.isNotNull()
    return F.when(ready & calm & up, 1).when(ready & calm & down, -1).otherwise(0)


def _vwap_reversion(sd: float = 1.5, far: float = 2.0, level: float = 50) -> Column:
    (lo, hi), (lower, higher), c, tired = vwap_bands(sd), vwap_bands(far), F.col("close"), cmo(5)
    return hold(F.when((c < lo) & (c > lower) & (tired < -level), 1).when((c > hi) & (c < higher) & (tired > level), -1), tired.isNotNull() & lo.isNotNull())


def _vwap_confirmed(low: float = 30, high: float = 70) -> Column:
    (lo, hi), c = vwap_bands(), F.col("close")
    return hold(F.when((c < lo) & (F.col("rsi") < low), 1).when((c > hi) & (F.col("rsi") > high), -1), F.col("rsi").isNotNull() & lo.isNotNull())


def _signed(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1)


def _vwap_slope(p: int = 5) -> Column:
    return hold(_signed(vwap() - F.lag(vwap(), p).over(series())), F.col("bar") > p)


def _macd_slope(p: int = 3) -> Column:
    hist = F.col("macd") - F.col("macd_signal")
    moved = hist - F.lag(hist, p).over(series())
    return hold(F.when((hist > 0) & (moved > 0), 1).when((hist < 0) & (moved < 0), -1), hist.isNotNull())


def _stops(p: int = 10, m: float = 3.0) -> Column:
    """Below the stop of longs short, above the stop of shorts long."""
    w = series().rowsBetween(-(p - 1), 0)
    long, short, c = F.max("high").over(w) - m * F.col("atr_10"), F.min("low").over(w) + m * F.col("atr_10"), F.col("close")
    return hold(F.when(c < long, -1).when(c > short, 1), F.col("atr_10").isNotNull())


def _stack(fast: str, middle: str, slow: str, more_up=None, more_down=None, close: bool = True) -> Column:
    up, down = (F.col(fast) > F.col(middle)) & (F.col(middle) > F.col(slow)), (F.col(fast) < F.col(middle)) & (F.col(middle) < F.col(slow))
    if close:
        up, down = up & (F.col("close") > F.col(fast)), down & (F.col("close") < F.col(fast))
    up, down = up if more_up is None else up & more_up, down if more_down is None else down & more_down
    return F.when(up, 1).when(down, -1)


def _atr_expansion(m: float = 1.5, p: int = 14) -> Column:
    part = F.when(F.col("close") > 0, 100 * F.col("atr") / F.col("close"))
    usual = _mean(F.coalesce(part, F.lit(0.0)), p, series())
    return hold(F.when(part > m * usual, _bias("ema_20")), part.isNotNull() & F.col("ema_20").isNotNull())


def _gated(gate: float = 61.8) -> Column:
    return F.when(choppiness() < gate, above(F.col("close"), F.col("ema_30"))).otherwise(0)


def _percent_b(low: float = 0.2, high: float = 0.8) -> Column:
    lo, _, hi = bollinger()
    return fade(ratio(F.col("close") - lo, hi - lo), low, high)


def _hull() -> Column:
    """Wanted: ``_raw`` = 2 * WMA(10) - WMA(20) beside the bars (see :func:`signals`)."""
    return above(F.col("close"), wma(4, "_raw"))


#: rules of frames alone: a function that gives the position column of prepared bars
RULES: dict[str, Callable[[], Column]] = {
    "SMA": lambda: above(F.col("close"), sma(20)),
    "HMA": _hull,
    "Bollinger": lambda: _band(bollinger()[0], bollinger()[2]),
    "Stochastic": _stochastic_cross,
    "VWAP": lambda: above(F.col("close"), vwap()),
    "VWAPBands": lambda: _band(*vwap_bands()),
    "VWAPDev": lambda: fade((ratio(F.col("close"), vwap()) - 1) * 100, -1, 1),
    "VWMA": lambda: above(F.col("close"), vwma()),
    "CMO": lambda: fade(cmo(), -50, 50),
    "Aroon": lambda: follow(aroon(), 0),
    "POC": lambda: above(F.col("close"), poc()),
    "PctB": _percent_b,
    "LRSlope": lambda: hold(F.nullif(F.signum(slope()).cast("int"), F.lit(0)), slope().isNotNull()),
    "DecaySlope": lambda: follow(slope(log=True) * 100, 0.05),
    "CVD": _volume_divergence,
    "VWAPRev": _vwap_reversion,
    "VWAPSlope": _vwap_slope,
    "BBWidth": _band_width,
    "Breakout": lambda: _breakout(20),
    "ORB": _opening_range,
    "InsideBar": _inside_bar,
    "NR7": _narrow_range,
    "VolSpike": _volume_spike,
    "IVRank": lambda: F.when(F.coalesce(iv_rank() <= 50, F.lit(True)), above(F.col("close"), sma(20))).otherwise(0),
}

#: rules of recurrences: (kernels, function of their columns)
KERNEL_RULES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "EMA": (("ema",), lambda: above(F.col("close"), F.col("ema_20"))),
    "DEMA": (("dema",), lambda: above(F.col("close"), F.col("dema"))),
    "Ribbon": (("ribbon",), lambda: hold(_stack("ema_5", "ema_13", "ema_34"), F.col("ema_34").isNotNull())),
    "ChandeKroll": (("atr_10",), _stops),
    "Squeeze": (("squeeze",), _squeeze),
    "SqueezeBreak": (("squeeze",), lambda: _squeeze(2.0)),
    "CRSI": (("connors",), lambda: fade(F.col("connors_rsi"), 30, 70)),
    "HilbertDC": (("adaptive",), lambda: F.when(F.col("cycle").isNull(), 0).otherwise(0)),
    "AdaptRSI": (("adaptive",), lambda: hold(F.when(F.col("cycle_steady") > 0, F.when(F.col("adaptive_rsi") < 30, 1).when(F.col("adaptive_rsi") > 70, -1)), F.col("adaptive_rsi").isNotNull())),
    "AdaptBB": (("adaptive",), lambda: hold(F.when((F.col("cycle_steady") > 0) | F.col("cycle").isNull(), F.when(F.col("adaptive_place") > 0.8, -1).when(F.col("adaptive_place") < 0.2, 1)), F.col("adaptive_place").isNotNull())),
    "Regime": (("ema_30",), _gated),
    "Chop": (("ema_30",), _gated),
    "TrendRegime": (("supertrend", "macd"), _trend_regime),
    "MACDSlope": (("macd",), _macd_slope),
    "VWAPMR": (("rsi",), _vwap_confirmed),
    "VolRate": (("ema",), lambda: hold(F.when(F.col("volume") >= 1.5 * _volume_mean(), _bias("ema_20")), _volume_mean().isNotNull() & F.col("ema_20").isNotNull())),
    "VolReg": (("ema_30",), _volatility_gate),
    "KaufER": (("ema",), lambda: hold(F.when(F.coalesce(efficiency(), F.lit(0.0)) > 0.3, _bias("ema_20")).when(F.coalesce(efficiency(), F.lit(0.0)) < 0.15, 0), F.col("ema_20").isNotNull())),
    "RSI": (("rsi",), lambda: fade(F.col("rsi"), 30, 70)),
    "MACD": (("macd",), lambda: above(F.col("macd"), F.col("macd_signal"))),
    "Keltner": (("keltner",), lambda: _band(F.col("keltner_low"), F.col("keltner_high"))),
    "SuperTrend": (("supertrend",), lambda: F.col("supertrend_dir").cast("int")),
    "ADX": (("adx", "ema"), lambda: hold(F.when(F.col("adx") >= 20, above(F.col("close"), F.col("ema_20"))), F.col("adx").isNotNull() & F.col("ema_20").isNotNull())),
    "ADXDI": (("adx",), lambda: hold(F.when(F.col("adx") >= 20, F.when(F.col("plus_di") > F.col("minus_di"), 1).otherwise(-1)), F.col("adx").isNotNull())),
    "ATRPct": (("atr", "ema"), _atr_expansion),
    "KAMA": (("kama",), lambda: above(F.col("close"), F.col("kama"))),
    "Fisher": (("fisher",), lambda: above(F.col("fisher"), F.lit(0.0))),
    "Cyber": (("cyber",), lambda: above(F.col("cyber"), F.lit(0.0))),
    "ITrend": (("itrend",), lambda: above(F.col("itrend"), F.col("itrend_trigger"))),
    "FVG": (("fvg",), lambda: F.col("fvg_bias").cast("int")),
    "TrendFollow": (("slow_ribbon", "supertrend", "adx"), lambda: hold(_stack("ema_8", "ema_21", "ema_55", (F.col("supertrend_dir") > 0) & (F.col("adx") > 25), (F.col("supertrend_dir") < 0) & (F.col("adx") > 25), close=False), F.col("ema_55").isNotNull() & F.col("adx").isNotNull())),
}


def signals(bars: DataFrame, *rules: str) -> DataFrame:
    """(symbol, ts, close, rule, position) of the named rules, kernels computed once."""
    wanted = dict.fromkeys(k for r in rules if r in KERNEL_RULES for k in KERNEL_RULES[r][0])
    base = prepare(recurrences(bars, *wanted) if wanted else bars)
    if "HMA" in rules:
        base = base.withColumn("_raw", 2 * wma(10) - wma(20))
    made = {f"_p_{r}": (KERNEL_RULES[r][1]() if r in KERNEL_RULES else RULES[r]()) for r in rules}
    wide = base.select("symbol", "ts", "open", "high", "low", "close", "volume", *[c.alias(n) for n, c in made.items()])
    pick = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_p_{r}").cast("int").alias("position")) for r in rules]))
    return wide.select("symbol", "ts", "open", "high", "low", "close", pick.alias("x")).select("symbol", "ts", "open", "high", "low", "close", "x.*")


def pair(signalled: DataFrame, one: str, other: str) -> DataFrame:
    """Both rules agree: their position, else flat."""
    w = signalled.groupBy("symbol", "ts").agg(F.max(F.when(F.col("rule") == one, F.col("position"))).alias("a"), F.max(F.when(F.col("rule") == other, F.col("position"))).alias("b"))
    return w.select("symbol", "ts", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0).alias("position"))


def regimes(bars: DataFrame, gate: float = 20, high: float = 0.6) -> DataFrame:
    """0 and 1: trend up and down, by ADX and two EMAs; 2 and 3: volatile and quiet, by the rank of ATR in 100 bars before."""
    base = prepare(recurrences(bars, "adx", "ema", "atr")).withColumn("vol", F.when(F.col("close") > 0, F.col("atr") / F.col("close")))
    frame = F.collect_list(F.coalesce("vol", F.lit(float("inf")))).over(series().rowsBetween(-100, -1))
    rank = F.when(F.size(frame) > 0, F.size(F.filter(frame, lambda x: x < F.col("vol"))) / F.size(frame)).otherwise(0.5)
    up = F.coalesce(F.col("ema_20") >= F.col("ema_50"), F.lit(False))
    kind = F.when(choppiness().isNull() | F.col("adx").isNull() | F.col("vol").isNull(), 3).when(F.col("adx") >= gate, F.when(up, 0).otherwise(1)).when(rank >= high, 2).otherwise(3)
    return base.select("symbol", "ts", "close", kind.alias("regime"))


def regime_features(bars: DataFrame) -> DataFrame:
    """(symbol, ts, f0 to f9): scale-free inputs of a regime model, neutral values where an indicator is not warm."""
    base = prepare(recurrences(bars, "adx", "atr", "ema", "macd", "rsi"))
    low, mid, high = bollinger()
    unit = F.coalesce("atr", F.lit(1e-9))
    minutes = F.hour("ts") * 60 + F.minute("ts")
    made = [
        F.coalesce(choppiness(), F.lit(62.0)) / 100,
        F.coalesce("adx", F.lit(20.0)) / 100,
        F.least(F.lit(2.0), F.coalesce(ratio(high - low, F.abs(mid)), F.lit(0.0)) * 10),
        F.least(F.lit(0.05), unit / F.coalesce(F.nullif("close", F.lit(0.0)), F.lit(1.0))) * 20,
        F.coalesce("rsi", F.lit(50.0)) / 100,
        F.coalesce(F.col("macd") - F.col("macd_signal"), F.lit(0.0)) / unit,
        F.coalesce(F.col("ema_20") - F.col("ema_50"), F.lit(0.0)) / unit,
        F.when(_volume_mean(50) > 0, F.least(F.lit(3.0), F.col("volume") / _volume_mean(50))).otherwise(1.0),
        (minutes - 555) / 375,
        F.lit(1.0),
    ]
    return base.select("symbol", "ts", *[c.alias(f"f{k}") for k, c in enumerate(made)])


def smooth_regimes(labelled: DataFrame, persist: int = 5, hysteresis: int = 2) -> DataFrame:
    """``labelled`` (symbol, ts, regime) with ``smoothed``: a new regime counts once it has lasted ``persist`` bars, and
    after the first change ``hysteresis`` bars more."""

    def run(frame):
        frame = frame.sort_values("ts").reset_index(drop=True)
        raw = frame["regime"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
        out, now, need = raw.copy(), raw[0], persist
        for a, b in zip(start, np.append(start[1:], len(raw)), strict=True):
            out[a:b] = now
            if raw[a] != now and b - a >= need:
                out[a + need - 1 : b] = now = raw[a]
                need = persist + hysteresis
        frame["smoothed"] = out
        return frame

    return labelled.select("symbol", "ts", "regime").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp_ntz, regime int, smoothed int")
