"""Operators on bar series: resampling, grids, clusters, features, labels, events, states.

All take ``symbol`` and ``ts``; windows order one symbol's bars.  A bar is at most one row per symbol and grain, so such
a partition is bounded by time.  Missing values are null, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths

IST = "INTERVAL 330 MINUTES"


def series(*more: str):
    """The window of one symbol's bars in time order."""
    return Window.partitionBy("symbol", *more).orderBy("ts")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def guarded(value: Column, count: Column, least: int) -> Column:
    """``value`` where the frame holds at least ``least`` values."""
    return F.when(count >= least, value)


# --- clock -----------------------------------------------------------------------------------------------------------


def local(ts: Column) -> Column:
    """Exchange wall clock: UTC plus five and a half hours."""
    return ts + F.expr(IST)


def day_key(ts: Column) -> Column:
    return F.to_date(local(ts))


def minute_of_day(ts: Column) -> Column:
    return F.hour(local(ts)) * 60 + F.minute(local(ts))


def floor_to_session(ts: Column) -> Column:
    return (F.date_trunc("day", local(ts)).cast("timestamp_ntz") - F.expr(IST)).cast("timestamp_ntz")


def session_day(ts: Column, anchor: str = "session") -> Column:
    """Day of a bar; with the session anchor 19:00 to 06:00 is one night session that belongs to the evening's day."""
    if anchor == "wall":
        return day_key(ts)
    if anchor != "session":
        raise ValueError("anchor is wall or session")
    return F.when(minute_of_day(ts) < 360, F.date_sub(day_key(ts), 1)).otherwise(day_key(ts))


def bucket15(ts: Column) -> Column:
    return (F.floor(minute_of_day(ts) / 15) * 15).cast("int")


def minutes_of(text: str) -> int:
    hours, minutes = text.split(":")[:2]
    return int(hours) * 60 + int(minutes)


#: Trading hours by exchange.
SESSIONS = {"NSE": ("09:15", "15:30"), "MCX": ("09:00", "23:30"), "NCDEX": ("10:00", "17:00")}
MCX = "GOLD|SILVER|CRUDE|NATURALGAS|COPPER|ZINC|ALUMINIUM|LEAD|NICKEL"
NCDEX = "GUAR|CASTOR|COTTON|JEERA|DHANIYA|TURMERIC|SOY"


def exchange_of(symbol: Column) -> Column:
    name = F.upper(symbol)
    return F.when(name.rlike(f"^({MCX})"), "MCX").when(name.rlike(f"^({NCDEX})"), "NCDEX").otherwise("NSE")


def session_mask(ts: Column, start: str, end: str) -> Column:
    return minute_of_day(ts).between(minutes_of(start), minutes_of(end))


def window_mask(ts: Column, windows: list[tuple[str, str]]) -> Column:
    """Inside any half-open intraday window; no windows let everything pass."""
    out = F.lit(not windows)
    for start, end in windows:
        out = out | ((minute_of_day(ts) >= minutes_of(start)) & (minute_of_day(ts) < minutes_of(end)))
    return out


def expiry_mask(ts: Column, expiry: Column) -> Column:
    return F.coalesce(day_key(ts) != expiry, F.lit(True))


def dte_mask(ts: Column, expiry: Column, least: int, most: int) -> Column:
    return F.coalesce(F.datediff(expiry, day_key(ts)).between(least, most), F.lit(True))


def all_masks(*masks: Column | None) -> Column:
    out = F.lit(True)
    for m in masks:
        if m is not None:
            out = out & F.coalesce(m, F.lit(True))
    return out


# --- resampling and grids --------------------------------------------------------------------------------------------


def resample(bars: DataFrame, minutes: int, anchor: str = "session") -> DataFrame:
    """Coarser bars: first, max, min, last, sum; buckets stand on the wall clock, daily ones on the session day."""
    if minutes >= 1440:
        key = session_day(F.col("ts"), anchor).cast("timestamp_ntz")
    else:
        key = (F.window(local(F.col("ts")), f"{minutes} minutes")["start"] - F.expr(IST)).cast("timestamp_ntz")
    return (
        bars.groupBy("symbol", key.alias("bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_bars"),
        )
        .withColumnRenamed("bucket", "ts")
    )


def frequency(bars: DataFrame) -> DataFrame:
    """Median gap in minutes per symbol and the nearest of the usual bar sizes."""
    gaps = bars.select("symbol", ((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(series()).cast("timestamp"))) / 60).alias("gap"))
    med = gaps.where("gap > 0").groupBy("symbol").agg(F.expr("median(gap)").alias("gap"))
    known = F.array(*[F.struct(F.abs(F.col("gap") - k).alias("d"), F.lit(k).alias("k")) for k in (1, 2, 3, 5, 10, 15, 30, 60)])
    return med.select("symbol", F.round("gap", 4).alias("gap"), F.array_min(known)["k"].alias("minutes"))


def session_grid(bars: DataFrame, step: str = "1 hour") -> DataFrame:
    """Every ``step`` between a day's first and last bar; never across a night."""
    days = bars.groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return days.select("day", F.explode(F.expr(f"sequence(a, b, INTERVAL {step})")).alias("ts"))


def align_to_grid(bars: DataFrame, step: str = "1 hour") -> DataFrame:
    """Bars on the full grid of their day; prices stay null where no bar is, ``present`` says which are real.

    The grid is joined per symbol and day that the symbol traded on, so nothing is multiplied beyond the grid itself.
    """
    one = bars.withColumn("day", F.to_date("ts"))
    days = one.select("symbol", "day").distinct()
    grid = days.join(session_grid(bars, step), "day")
    return grid.join(one.drop("day").withColumn("present", F.lit(True)), ["symbol", "ts"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def keep_last(bars: DataFrame, order: str) -> DataFrame:
    """One bar per symbol and ts: the one with the greatest ``order``."""
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    return bars.groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), order).alias("last")).select("symbol", "ts", "last.*")


def clusters(events: DataFrame, gap: str = "3 minutes", keys: tuple[str, ...] = ("symbol",), run_rows: int = paths.RUN_ROWS) -> DataFrame:
    """Event clusters per key: start, end, size; a pause longer than ``gap`` starts a new one.

    Time is cut into runs of about ``run_rows`` events.  A run's first event looks back to the last one of the run before, and
    clusters are numbered after those that began in earlier runs, so one may reach over several.
    """
    order = paths.seconds_of(events, "ts")
    edges = paths.run_edges(events.select(order.alias("at")), "at", run_rows)
    rows = paths.with_entry(events.select(*keys, "ts", paths.run_of(order, edges).alias("run")), keys, F.max("ts"))
    w = Window.partitionBy(*keys, "run").orderBy("ts")
    before = F.coalesce(F.lag("ts").over(w), "came")
    fresh = F.coalesce((F.col("ts") - before) > F.expr(f"INTERVAL {gap}"), F.lit(True)).cast("int")
    marked = rows.select(*keys, "run", "ts", fresh.alias("fresh")).withColumn("own", F.sum("fresh").over(w))
    parts = marked.groupBy(*keys, "run", "own").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count(F.lit(1)).alias("n"))
    counts = parts.groupBy(*keys, "run").agg(F.max("own").alias("_began"))
    earlier = F.coalesce(F.sum("_began").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("run").alias("_of_run"), earlier.alias("_offset"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "run")])
    placed = parts.join(offsets, same).withColumn("cluster", F.col("own") + F.col("_offset"))
    return placed.groupBy(*keys, "cluster").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"))


def mask_persistence(flags: DataFrame, flag: str, least: int) -> DataFrame:
    """``kept``: the flag where its run lasts at least ``least`` bars."""
    change = (F.col(flag) != F.lag(flag, 1, None).over(series())).cast("int")
    runs = flags.withColumn("_run", F.sum(F.coalesce(change, F.lit(0))).over(series()))
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "_run"))
    return runs.withColumn("kept", F.col(flag) & (size >= least)).drop("_run")


# --- features --------------------------------------------------------------------------------------------------------


def returns(bars: DataFrame, spans: tuple[int, ...] = (1, 2, 3, 5, 10, 15)) -> DataFrame:
    """return_w in percent, and accelerations of them."""
    c = F.col("close")
    out = bars.withColumns({f"return_{n}": (ratio(c, F.lag("close", n).over(series())) - 1) * 100 for n in spans})
    if {1, 2, 3, 10} <= set(spans):
        out = out.withColumns(
            {
                "accel_1_2": F.col("return_1") - F.col("return_2"),
                "accel_1_3": F.col("return_1") - F.col("return_3"),
                "accel_3_10": F.col("return_3") - F.col("return_10") * 0.3,
            }
        )
    return out


def streaks(frame: DataFrame) -> DataFrame:
    """Runs of the sign of return_1: up_bars, down_bars, streak (0 where the return is 0 or missing)."""
    sign = F.coalesce(F.signum("return_1"), F.lit(0.0))
    change = F.coalesce((sign != F.lag(sign).over(series())).cast("int"), F.lit(1))
    runs = frame.withColumn("_change", change).withColumn("_island", F.sum("_change").over(series()))
    length = F.row_number().over(series("_island"))
    return runs.withColumns(
        {"up_bars": F.when(sign > 0, length).otherwise(0), "down_bars": F.when(sign < 0, length).otherwise(0), "streak": F.when(sign != 0, length).otherwise(0)}
    ).drop("_change", "_island")


def candles(bars: DataFrame) -> DataFrame:
    """Geometry of each candle; a candle without range has no ratios."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - low
    return bars.withColumns(
        {
            "range": span,
            "body": c - o,
            "body_pct": ratio(c - o, o) * 100,
            "upper_wick": h - F.greatest(o, c),
            "lower_wick": F.least(o, c) - low,
            "close_location": ratio(c - low, span),
            "body_to_range": ratio(F.abs(c - o), span),
        }
    )


def trailing(frame: DataFrame, width: int = 120, least: int = 20) -> DataFrame:
    """Mean, high and low of the prior ``width`` bars, where the close stands in them, and the volume's z-score."""
    w = series().rowsBetween(-width, -1)
    n = F.count("close").over(w)
    mean, high, low = (guarded(f(x).over(w), n, least) for f, x in ((F.avg, "close"), (F.max, "high"), (F.min, "low")))
    vol = guarded(ratio(F.col("volume") - F.avg("volume").over(w), F.stddev_samp("volume").over(w)), F.count("volume").over(w), least)
    out = frame.withColumns({"rolling_mean": mean, "rolling_high": high, "rolling_low": low, "volume_zscore": vol})
    c = F.col("close")
    return out.withColumns(
        {
            "distance_from_mean": ratio(c - F.col("rolling_mean"), F.col("rolling_mean")) * 100,
            "distance_from_high": ratio(c - F.col("rolling_high"), F.col("rolling_high")) * 100,
            "distance_from_low": ratio(c - F.col("rolling_low"), F.col("rolling_low")) * 100,
            "range_position": ratio(c - F.col("rolling_low"), F.col("rolling_high") - F.col("rolling_low")),
        }
    )


def volatility(frame: DataFrame) -> DataFrame:
    """Three average ranges by name (plain, true), realised volatility, expansion and contraction of the range."""
    prior = F.lag("close").over(series())
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prior), F.abs(F.col("low") - prior))
    out = frame.withColumns({"true_range": true, "_r": ratio(F.col("close"), prior) - 1, "range": F.col("high") - F.col("low")})
    w14, w10, w20 = (series().rowsBetween(-n, -1) for n in (14, 10, 20))
    mean10 = guarded(F.avg("range").over(w10), F.count("range").over(w10), 5)
    return out.withColumns(
        {
            "atr_range": guarded(F.avg("range").over(w14), F.count("range").over(w14), 5),
            "atr_true": guarded(F.avg("true_range").over(w14), F.count("true_range").over(w14), 5),
            "range_expansion": ratio(F.col("range"), mean10),
            "range_contraction": ratio(mean10, F.col("range")),
            "realized_vol_20": guarded(F.stddev_samp("_r").over(w20), F.count("_r").over(w20), 10),
        }
    ).drop("_r")


def percentile_of(value: str, width: int = 120, least: int = 20, inclusive: bool = True) -> Column:
    """Percent of the frame's values that are at or below the current one."""
    frame = F.collect_list(value).over(series().rowsBetween(-(width - 1) if inclusive else -width, 0 if inclusive else -1))
    below = F.size(F.filter(frame, lambda x: x <= F.col(value)))
    return F.when(F.size(frame) >= least, ratio(below * 100.0, F.size(frame)))


def volume_flags(frame: DataFrame) -> DataFrame:
    """Shock, confirmation and divergence of volume and price; needs return_1, volume_zscore, range_expansion."""
    r, z, x = F.col("return_1"), F.col("volume_zscore"), F.col("range_expansion")
    change = (ratio(F.col("volume"), F.lag("volume").over(series())) - 1) * 100
    flag = lambda on: F.coalesce(on, F.lit(False)).cast("int")
    return frame.withColumns(
        {
            "volume_change": change,
            "volume_shock": flag(z > 2),
            "price_volume_confirmation": flag((r > 0) & (z > 1)),
            "price_volume_divergence": flag((r > 0) & (z < -1)),
            "volume_without_price": flag((z > 2) & (F.abs(r) < 0.5)),
            "price_without_volume": flag((x > 2) & (z < 0)),
        }
    )


def baselines(frame: DataFrame) -> DataFrame:
    """RSI of simple means over 14 bars, 20-bar mean and band position, 5-bar rate of change, cumulative VWAP deviation."""
    change = F.col("close") - F.lag("close").over(series())
    w14, w20 = series().rowsBetween(-13, 0), series().rowsBetween(-19, 0)
    past = series().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = frame.withColumns({"_up": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_down": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), "_pv": typical * F.col("volume")})
    up, down = F.avg("_up").over(w14), F.avg("_down").over(w14)
    mean, sd, n = F.avg("close").over(w20), F.stddev_samp("close").over(w20), F.count("close").over(w20)
    vwap = ratio(F.sum("_pv").over(past), F.sum("volume").over(past))
    return out.withColumns(
        {
            "rsi_14": guarded(100 - ratio(F.lit(100.0), 1 + ratio(up, down)), F.count("_up").over(w14), 14),
            "ma_20": guarded(mean, n, 20),
            "bb_pos": guarded(ratio(F.col("close") - mean, sd * 2), n, 20),
            "roc_5": (ratio(F.col("close"), F.lag("close", 5).over(series())) - 1) * 100,
            "vwap_deviation": (ratio(F.col("close"), vwap) - 1) * 100,
        }
    ).drop("_up", "_down", "_pv")


def momentum(frame: DataFrame) -> DataFrame:
    """Means of prior returns, their change and sign flip, gap, pullback from the 6-bar high; needs return_1."""
    out = frame.withColumns({f"momentum_{n}": guarded(F.avg("return_1").over(series().rowsBetween(-n, -1)), F.count("return_1").over(series().rowsBetween(-n, -1)), min(n, 5)) for n in (1, 3, 5, 10)})
    before = F.lag("momentum_5").over(series())
    prior = F.lag("close").over(series())
    return out.withColumns(
        {
            "momentum_change": F.col("momentum_5") - before,
            "momentum_reversal": F.coalesce(F.col("momentum_5") * before < 0, F.lit(False)).cast("int"),
            "gap": (ratio(F.col("open"), prior) - 1) * 100,
            "pullback": ratio(F.max("high").over(series().rowsBetween(-5, 0)) - F.col("close"), F.max("high").over(series().rowsBetween(-5, 0))) * 100,
            "cumulative_return_5": guarded(F.sum("return_1").over(series().rowsBetween(-5, -1)), F.count("return_1").over(series().rowsBetween(-5, -1)), 5),
        }
    )


# --- labels ----------------------------------------------------------------------------------------------------------


def labels(bars: DataFrame, spans: tuple[int, ...] = (1, 3, 5, 10, 15, 30), by_session: bool = False) -> DataFrame:
    """Forward return and best and worst excursion in percent, strictly after the bar; a short window gives null."""
    frame = bars.withColumn("_day", day_key(F.col("ts"))) if by_session else bars
    w = series("_day") if by_session else series()
    out = {}
    for n in spans:
        ahead = w.rowsBetween(1, n)
        whole = F.count("close").over(ahead)
        out[f"fwd_ret_{n}"] = (ratio(F.lead("close", n).over(w), F.col("close")) - 1) * 100
        out[f"mfe_{n}"] = guarded((ratio(F.max("high").over(ahead), F.col("close")) - 1) * 100, whole, n)
        out[f"mae_{n}"] = guarded((ratio(F.min("low").over(ahead), F.col("close")) - 1) * 100, whole, n)
    return frame.withColumns(out).drop("_day")


def return_path(frame: DataFrame, mask: Column, spans: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per horizon over masked bars: n, mean, median, win rate, 90th percentile of the excursions."""
    long = frame.where(mask).select(F.explode(F.array(*[F.struct(F.lit(n).alias("horizon"), F.col(f"fwd_ret_{n}").alias("r"), F.col(f"mfe_{n}").alias("best"), F.col(f"mae_{n}").alias("worst")) for n in spans])).alias("x")).select("x.*")
    return long.where("r is not null").groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("r").alias("mean"),
        F.expr("percentile(r, 0.5)").alias("median"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        F.expr("percentile(best, 0.9)").alias("mfe_p90"),
        F.expr("percentile(worst, 0.1)").alias("mae_p10"),
    )


def path_class(profile: DataFrame) -> DataFrame:
    """One word for a path from its means at the short and the long horizon."""
    wide = profile.groupBy().agg(*[F.max(F.when(F.col("horizon") == n, F.col("mean"))).alias(f"m{n}") for n in (1, 3, 5, 10)])
    short, long = F.col("m1"), F.col("m10")
    kind = (
        F.when((F.abs(short) < 0.05) & (F.abs(long) < 0.05), "NOISE")
        .when((short > 0) & (long < 0), "MEAN_REVERSION")
        .when((short > 0) & (short >= 0.6 * long), "FAST_SPIKE")
        .when(long > 0, "SLOW_BURN")
        .otherwise("STOP_FIRST")
    )
    return wide.select(kind.alias("path_class"))


# --- events, sequences, states ---------------------------------------------------------------------------------------


def atomic_events(frame: DataFrame) -> DataFrame:
    """Large return (z of return_5 in the prior 120), volume shock, compression, expansion."""
    w = series().rowsBetween(-120, -1)
    z = guarded(ratio(F.col("return_5") - F.avg("return_5").over(w), F.stddev_samp("return_5").over(w)), F.count("return_5").over(w), 20)
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = frame.withColumn("z_ret5", z)
    out = out.withColumns(
        {"e_large_ret": on(F.abs("z_ret5") > 2.5), "e_vol_shock": on(F.col("volume_zscore") > 2), "e_expansion": on(F.col("range_expansion") > 2), "e_compression": on(F.col("range_expansion") < 0.5)}
    )
    before = F.lag("e_compression").over(series())
    return out.withColumns({"ev_compress_expand": on((before == 1) & (F.col("e_expansion") == 1)), "ev_large_vol": F.col("e_large_ret") * F.col("e_vol_shock")})


def bar_state(r: Column) -> Column:
    return F.when(r > 1, "strong_up").when(r > 0.2, "weak_up").when(r < -1, "strong_down").when(r < -0.2, "weak_down").when(r.isNotNull(), "flat")


def sequences(frame: DataFrame) -> DataFrame:
    """States of the two and three bars before, as one string each; null until they exist."""
    state = frame.withColumn("state", bar_state(F.col("return_1")))
    s = [F.lag("state", k).over(series()) for k in (3, 2, 1)]
    return state.withColumns({"seq2": F.when(s[1].isNotNull(), F.concat_ws("|", s[1], s[2])), "seq3": F.when(s[0].isNotNull(), F.concat_ws("|", *s))})


def vol_states(frame: DataFrame) -> DataFrame:
    """Quintile of the range among the trailing 120 bars and the volume's third, as one state id (causal)."""
    out = frame.withColumns({"range_pct": percentile_of("range"), "vol_pct": percentile_of("volume")})
    q = F.when(F.col("range_pct").isNotNull(), F.least(F.floor(F.col("range_pct") / 20), F.lit(4)).cast("int"))
    v = F.when(F.col("vol_pct") < 33, "low").when(F.col("vol_pct") > 66, "high").when(F.col("vol_pct").isNotNull(), "mid")
    return out.withColumns({"b_range": q, "b_vol": v, "state_id": F.concat_ws("/", q.cast("string"), v)})


def divergence(frame: DataFrame, spread: str, threshold: float) -> DataFrame:
    """Wide spread, and wide spread that is closing against the bar before (causal)."""
    before = F.lag(spread).over(series())
    on = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return frame.withColumns(
        {"ev_divergence": on(F.abs(spread) >= threshold), "ev_convergence": on((F.abs(before) > threshold) & (F.abs(spread) < F.abs(before)))}
    )


def feature_quality(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Missing share of every column, its tier, and how many distinct values it has."""
    tests = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns]
    long = frame.select(F.explode(F.array(*tests)).alias("x")).select("x.*")
    out = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("valid"), F.countDistinct("v").alias("distinct"), F.var_samp("v").alias("variance"))
    missing = 1 - F.col("valid") / F.col("n")
    return out.select("feature", "n", "valid", "distinct", F.round(missing, 6).alias("missing"), tier_of(missing).alias("tier"), (F.coalesce(F.col("variance") > 0, F.lit(False))).alias("usable"))


def tier_of(missing: Column) -> Column:
    return F.when(missing < 0.2, "FULL").when(missing < 0.4, "LIMITED").when(missing < 0.6, "WEAK").when(missing < 0.8, "RESTRICTED").otherwise("DISABLED")


def health(bars: DataFrame) -> DataFrame:
    """Counts of what is wrong with a symbol's bars, and a status."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = h.isNull() | low.isNull() | (h < low) | (h < F.greatest(o, c)) | (low > F.least(o, c)) | c.isNull() | o.isNull()
    out = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(bad).alias("bad_bars"),
        (F.count(F.lit(1)) - F.countDistinct("ts")).alias("repeated"),
        F.countDistinct(F.to_date("ts")).alias("days"),
        F.avg((F.col("volume") > 0).cast("double")).alias("volume_coverage"),
    )
    status = F.when(F.col("bad_bars") > 0, "BAD_OHLC").when(F.col("repeated") > 0, "DUPLICATES").when(F.col("n_bars") < 200, "SHORT").otherwise("OK")
    return out.withColumn("status", status)
