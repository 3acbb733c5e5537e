"""Long-premium rules: causal session features, regimes, detectors and exits.

Every window is cut by symbol and day, so no statistic crosses a night.  A statistic is null until its frame holds
enough bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio

TRENDING, CHOPPY, COMPRESSING, UNKNOWN = "TRENDING", "CHOPPY", "COMPRESSING", "UNKNOWN"


def _session():
    return Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")


def _over(agg, value: Column, width: int, least: int, until: int = 0) -> Column:
    """``agg`` over the ``width`` bars that end ``until`` bars ago, null below ``least`` values."""
    w = _session().rowsBetween(-(width - 1) - until, -until)
    return F.when(F.count(value).over(w) >= least, agg(value).over(w))


def _rank(value: str, width: int, least: int) -> Column:
    """Share of the frame's values that are not above the bar's own, in percent."""
    frame = F.collect_list(value).over(_session().rowsBetween(-(width - 1), 0))
    under = F.size(F.filter(frame, lambda x: x <= F.col(value)))
    return F.when(F.size(frame) >= least, under * 100.0 / F.size(frame))


def session_features(bars: DataFrame, er_window: int = 30) -> DataFrame:
    """``bars`` (symbol, ts, open, high, low, close, volume) with session VWAP, dispersion, range, volume and swing columns."""
    so_far = _session().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    before = F.lag("close").over(_session())
    out = bars.withColumns(
        {
            "vwap": F.coalesce(ratio(F.sum(typical * F.coalesce("volume", F.lit(0.0))).over(so_far), F.sum(F.coalesce("volume", F.lit(0.0))).over(so_far)), typical),
            "true_range": F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            "moved": F.abs(F.col("close") - before),
        }
    )
    out = out.withColumns({"vwap_dev": F.abs(F.col("close") - F.col("vwap")), "range_pct": F.when(F.col("close") > 0, (_over(F.max, F.col("high"), 20, 5) - _over(F.min, F.col("low"), 20, 5)) / F.col("close") * 100)})
    out = out.withColumns({"vwap_sigma": _over(F.stddev_samp, F.col("vwap_dev"), 60, 20), "vol_med": _over(lambda v: F.percentile(v, F.lit(0.5)), F.col("volume"), 20, 5)})
    net = F.abs(F.col("close") - F.lag("close", er_window).over(_session()))
    return out.withColumns(
        {
            "vwap_z": F.when(F.col("vwap_sigma") > 0, F.col("vwap_dev") / F.col("vwap_sigma")),
            "atr_pct": F.when(F.col("close") > 0, _over(F.avg, F.col("true_range"), 20, 5) / F.col("close") * 100),
            "range_pctile": _rank("range_pct", 120, 30),
            "vol_ratio": F.when(F.col("vol_med") > 0, F.col("volume") / F.col("vol_med")),
            "vol_pctile": _rank("volume", 120, 20),
            "eff_ratio": ratio(net, _over(F.sum, F.col("moved"), er_window, 5)),
            "swing_high": _over(F.max, F.col("high"), 30, 10, until=2),
            "swing_low": _over(F.min, F.col("low"), 30, 10, until=2),
        }
    ).drop("moved")


def regimes(features: DataFrame, trend: float = 0.45, wide: float = 70.0) -> DataFrame:
    """``features`` with regime and the detector that it permits (null: none)."""
    known = F.col("eff_ratio").isNotNull() & F.col("range_pctile").isNotNull()
    regime = F.when(~known, UNKNOWN).when(F.col("eff_ratio") >= trend, TRENDING).when(F.col("range_pctile") >= wide, CHOPPY).otherwise(COMPRESSING)
    permitted = F.when(F.col("regime") == COMPRESSING, "VOLATILITY_COIL").when(F.col("regime") == TRENDING, "LIQUIDITY_FLUSH")
    return features.withColumn("regime", regime).withColumn("permitted", permitted)


def _reversal(bullish: bool) -> Column:
    """A bar beyond the last one's extreme that closes back past its open, its middle and the last close."""
    middle, last = (F.col("high") + F.col("low")) / 2, lambda c: F.lag(c).over(_session())
    if bullish:
        return (F.col("low") < last("low")) & (F.col("close") > F.greatest("open", middle, last("close"))) & last("close").isNotNull()
    return (F.col("high") > last("high")) & (F.col("close") < F.least("open", middle, last("close"))) & last("close").isNotNull()


def _signals(frame: DataFrame, name: str, up: Column, down: Column) -> DataFrame:
    way = F.when(up, "CE").when(down, "PE")
    return frame.withColumn("direction", way).where(F.col("direction").isNotNull()).select("symbol", "ts", F.lit(name).alias("hypothesis"), "direction", "high", "low", "close")


def volatility_coil(features: DataFrame, width: int = 20, tight: float = 30.0, volume: float = 2.0) -> DataFrame:
    """A tight and narrowing range, then a break of it on high volume."""
    made = features.withColumns({"coil_high": _over(F.max, F.col("high"), width, 5), "coil_low": _over(F.min, F.col("low"), width, 5)})
    ago = lambda c, k: F.lag(c, k).over(_session())
    armed = (F.col("range_pctile") <= tight) & (ago("coil_high", 1) - ago("coil_low", 1) < ago("coil_high", 4) - ago("coil_low", 4)) & (F.col("vol_ratio") >= volume)
    return _signals(made, "VOLATILITY_COIL", armed & (F.col("close") > ago("coil_high", 1)), armed & (F.col("close") < ago("coil_low", 1)))


def liquidity_flush(features: DataFrame, volume: float = 1.8, causal: bool = True, ahead: int = 2) -> DataFrame:
    """A false break of a swing level that reverses on volume.

    ``causal`` asks the close to be back inside the last bar's level; otherwise the next ``ahead`` bars may also show it,
    which no live engine can know.
    """
    last = lambda c: F.lag(c).over(_session())
    inside_up, inside_down = F.coalesce(F.col("close") > last("swing_low"), F.lit(False)), F.coalesce(F.col("close") < last("swing_high"), F.lit(False))
    if not causal:
        w = _session().rowsBetween(1, ahead)
        inside_up = inside_up | F.coalesce(F.min("low").over(w) > F.col("swing_low"), F.lit(False))
        inside_down = inside_down | F.coalesce(F.max("high").over(w) < F.col("swing_high"), F.lit(False))
    loud = F.col("vol_ratio") >= volume
    up = (F.col("low") < F.col("swing_low")) & inside_up & _reversal(True) & loud
    down = (F.col("high") > F.col("swing_high")) & inside_down & _reversal(False) & loud
    return _signals(features, "LIQUIDITY_FLUSH", up, down)


def vwap_snap_back(features: DataFrame, z: float = 2.0) -> DataFrame:
    """A close ``z`` sigmas away from the VWAP that reverses; the VWAP is the target."""
    far = F.col("vwap_z") >= z
    return _signals(features, "VWAP_SNAP_BACK", far & (F.col("close") < F.col("vwap")) & _reversal(True), far & (F.col("close") > F.col("vwap")) & _reversal(False))


def oi_velocity(underlying: DataFrame, quotes: DataFrame, lookback: int = 20, drop_bars: int = 5, drop: float = 8.0) -> DataFrame:
    """Price goes through the strike with the most open interest, and that interest falls.

    ``underlying`` is (symbol, ts, high, low, close), ``quotes`` (ts, option_type, strike, oi).  A strike's interest is its
    largest of the ``lookback`` quotes before; equal walls are the lower strike.  Without open interest the result is
    empty.  The wall is one row per type and time, made before any window orders it.
    """
    oi = quotes.where("oi is not null").groupBy("option_type", "strike", "ts").agg(F.sum("oi").alias("oi"))
    w = Window.partitionBy("option_type", "strike").orderBy("ts").rowsBetween(-lookback, -1)
    held = oi.withColumn("held", F.when(F.count("oi").over(w) >= 5, F.max("oi").over(w)))
    top = F.max(F.when(F.col("held").isNotNull(), F.struct("held", (-F.col("strike")).alias("k"))))
    walls = held.groupBy("option_type", "ts").agg(top.alias("top")).select("option_type", "ts", (-F.col("top.k")).alias("wall"), F.col("top.held").alias("wall_oi"))
    line = Window.partitionBy("option_type").orderBy("ts")
    walls = walls.withColumns({"last_wall": F.lag("wall").over(line), "then": F.lag("wall_oi", drop_bars).over(line)})
    both = walls.where((F.col("wall") != F.col("last_wall")) & ((F.col("then") - F.col("wall_oi")) / F.col("then") * 100 >= drop)).join(underlying, "ts")
    up = (F.col("option_type") == "CE") & (F.greatest("high", "close") > F.col("last_wall"))
    down = (F.col("option_type") == "PE") & (F.least("low", "close") < F.col("last_wall"))
    return _signals(both, "OI_VELOCITY", up, down)


def detect(features: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """All detectors' signals: symbol, ts, hypothesis, direction, high, low, close of the trigger bar."""
    out = volatility_coil(features).unionByName(liquidity_flush(features)).unionByName(vwap_snap_back(features))
    return out if quotes is None else out.unionByName(oi_velocity(features, quotes))


def availability(quotes: DataFrame) -> DataFrame:
    """(hypothesis, available, reason): the open-interest detector needs quotes that carry it."""
    there = quotes.agg((F.count("oi") > 0).alias("oi"))
    names = F.explode(F.array(*[F.lit(n) for n in ("VOLATILITY_COIL", "OI_VELOCITY", "LIQUIDITY_FLUSH", "VWAP_SNAP_BACK")]))
    needs = F.col("hypothesis") == "OI_VELOCITY"
    return there.select("oi", names.alias("hypothesis")).select("hypothesis", (~needs | F.col("oi")).alias("available"), F.when(needs & ~F.col("oi"), "NOT_APPLICABLE").alias("reason"))


def exits(signals: DataFrame, bars: DataFrame, hold: int = 45, buffer: float = 1.0, least_stop: float = 30.0, breakeven: float = 2.5, target: float = 2.0, lock: float = 0.5, trail: float = 0.0) -> DataFrame:
    """Replay of long entries: symbol, ts, entry, exit_ts, exit, exit_reason, held, points.

    ``bars`` are the premium's bars.  The entry is the open of the bar after the signal; the first stop lies ``buffer``
    below the trigger's low, at least ``least_stop`` and half a point below the entry.  A bar's stop rises to the entry once a
    bar before it was ``breakeven`` points above, and to ``lock`` of the gain of the first bar that gained the risk.  From
    the entry on it also follows ``trail`` below the low of the candle before.  It never falls.  A bar that opens below its
    stop fills at the open (STOP_GAP); a stop comes before the target, which is ``target`` risks or the signal's own price in
    a column ``target``, where there is one; after ``hold`` bars the close counts (TIME), as does the session's last one
    (END_OF_DAY).  Each signal meets at most ``hold`` bars of its own session, so the work goes by the signals.
    """
    numbered = bars.withColumns({"day": F.to_date("ts"), "nth": F.row_number().over(_session())})
    last = numbered.groupBy("symbol", "day").agg(F.max("nth").alias("last"))
    given = F.col("target").cast("double") if "target" in signals.columns else F.lit(None).cast("double")
    at = signals.select("symbol", "ts", F.col("low").alias("trigger_low"), given.alias("given")).join(numbered.select("symbol", "ts", "day", "nth"), ["symbol", "ts"]).withColumnRenamed("nth", "at")
    path = numbered.select("symbol", "day", "nth", F.col("ts").alias("bar_ts"), "open", "high", "low", "close")
    met = at.join(path, ["symbol", "day"]).where((F.col("nth") > F.col("at")) & (F.col("nth") <= F.col("at") + hold)).join(last, ["symbol", "day"])
    whole = Window.partitionBy("symbol", "ts")
    w = whole.orderBy("nth")
    met = met.withColumn("entry", F.first("open").over(w))
    gain = F.col("high") - F.col("entry")
    met = met.withColumns({"risk": F.greatest(F.col("entry") - F.col("trigger_low") + buffer, F.lit(least_stop), F.lit(0.5)), "seen": F.coalesce(F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("entry")) - F.col("entry")})
    met = met.withColumn("paid", F.min(F.when(gain >= F.col("risk"), F.col("nth"))).over(whole))
    met = met.withColumn("paid_gain", F.max(F.when(F.col("nth") == F.col("paid"), gain)).over(whole))
    armed = F.when(F.col("seen") >= breakeven, F.col("entry")).otherwise(F.col("entry") - F.col("risk"))
    met = met.withColumn("base", F.greatest(armed, F.when(F.col("nth") > F.col("paid"), F.col("entry") + lock * F.col("paid_gain"))))
    behind = F.when(F.col("base") >= F.col("entry"), F.lag("low").over(w) - trail)
    met = met.withColumn("behind", behind)
    stop = F.greatest("base", F.max("behind").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    met = met.withColumns({"stop": stop, "goal": F.coalesce("given", F.col("entry") + target * F.col("risk"))})
    reason = (
        F.when(F.col("open") < F.col("stop"), "STOP_GAP")
        .when(F.col("low") <= F.col("stop"), "STOP")
        .when(F.col("high") >= F.col("goal"), "TARGET")
        .when(F.col("nth") == F.col("at") + hold, "TIME")
        .when(F.col("nth") == F.col("last"), "END_OF_DAY")
    )
    price = F.when(F.col("exit_reason") == "STOP_GAP", F.col("open")).when(F.col("exit_reason") == "STOP", F.col("stop")).when(F.col("exit_reason") == "TARGET", F.col("goal")).otherwise(F.col("close"))
    done = met.withColumn("exit_reason", reason).where("exit_reason is not null").withColumn("exit", price)
    first = done.groupBy("symbol", "ts").agg(F.min_by(F.struct("entry", F.col("bar_ts").alias("exit_ts"), "exit", "exit_reason", (F.col("nth") - F.col("at")).alias("held")), "nth").alias("x"))
    return first.select("symbol", "ts", "x.*", (F.col("x.exit") - F.col("x.entry")).alias("points"))
