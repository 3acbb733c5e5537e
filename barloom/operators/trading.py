"""Backtests, costs and trade metrics.

An event's exit depends on the bars after it alone, so events are walked in parallel over an array of the next bars.  Only
the position machine, where one trade blocks the next, runs symbol by symbol in a grouped Arrow function.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths
from .series import bucket15, ratio, series

# --- event backtest --------------------------------------------------------------------------------------------------


def event_trades(bars: DataFrame, mask: Column, hold: int = 5, sl: float = 50.0, tp: float = 50.0, cost: float = 0.0, direction: int = 1) -> DataFrame:
    """One trade per masked bar: entry at its close, stop first, then target, else the last close of ``hold`` bars.

    Levels are percent of the entry.  ``cost`` is a round trip in percent.  Events without a later bar give no trade.
    """
    ahead = F.collect_list(F.struct("ts", "high", "low", "close")).over(series().rowsBetween(1, hold))
    c = F.col("close")
    up, down = (c * (1 + tp / 100), c * (1 - sl / 100)) if direction > 0 else (c * (1 + sl / 100), c * (1 - tp / 100))
    rows = bars.withColumn("_ahead", ahead).where(mask & (F.size("_ahead") > 0) & (c > 0))
    over, under = (F.array_position(F.transform("_ahead", f), F.lit(True)) for f in (lambda x: x["high"] >= up, lambda x: x["low"] <= down))
    stop, target = (under, over) if direction > 0 else (over, under)
    rows = rows.withColumns({"_stop": stop, "_target": target})
    hit_stop = (F.col("_stop") > 0) & ((F.col("_target") == 0) | (F.col("_stop") <= F.col("_target")))
    hit_target = ~hit_stop & (F.col("_target") > 0)
    bars_held = F.when(hit_stop, F.col("_stop")).when(hit_target, F.col("_target")).otherwise(F.size("_ahead").cast("long"))
    last = F.element_at("_ahead", bars_held.cast("int"))
    price = F.when(hit_stop, c * (1 - direction * sl / 100)).when(hit_target, c * (1 + direction * tp / 100)).otherwise(last["close"])
    gross = (ratio(price, c) - 1) * 100 * direction
    return rows.select(
        "symbol",
        F.col("ts").alias("entry_ts"),
        last["ts"].alias("exit_ts"),
        c.alias("entry_price"),
        price.alias("exit_price"),
        F.when(hit_stop, "SL").when(hit_target, "TP").otherwise("TIME").alias("exit_reason"),
        bars_held.alias("duration_bars"),
        gross.alias("gross"),
        (gross - cost).alias("net"),
    )


def exit_grid(bars: DataFrame, mask: Column, configs: list[tuple[int, float, float]]) -> DataFrame:
    """Mean net, win rate and trades of every (hold, stop, target), all from one pass over the bars."""
    longest = max(h for h, _, _ in configs)
    ahead = F.collect_list(F.struct("high", "low", "close")).over(series().rowsBetween(1, longest))
    rows = bars.withColumn("_ahead", ahead).where(mask & (F.size("_ahead") > 0) & (F.col("close") > 0))
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("hold"), F.lit(float(s)).alias("sl"), F.lit(float(t)).alias("tp")) for h, s, t in configs]))
    each = rows.select("symbol", "close", "_ahead", grid.alias("x")).select("symbol", "close", F.slice("_ahead", 1, F.col("x.hold")).alias("b"), "x.*")
    each = each.withColumns(
        {
            "_s": F.array_position(F.transform("b", lambda x: x["low"] <= F.col("close") * (1 - F.col("sl") / 100)), F.lit(True)),
            "_t": F.array_position(F.transform("b", lambda x: x["high"] >= F.col("close") * (1 + F.col("tp") / 100)), F.lit(True)),
        }
    )
    stop = (F.col("_s") > 0) & ((F.col("_t") == 0) | (F.col("_s") <= F.col("_t")))
    net = F.when(stop, -F.col("sl")).when(F.col("_t") > 0, F.col("tp")).otherwise((ratio(F.element_at("b", -1)["close"], F.col("close")) - 1) * 100)
    return each.withColumn("net", net).groupBy("hold", "sl", "tp").agg(F.count(F.lit(1)).alias("n"), F.avg("net").alias("expectancy"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


# --- position machine ------------------------------------------------------------------------------------------------


def walk(o, h, low, c, position, sl=None, tp=None, trail=None, max_bars=None, fill_next=True, cost=0.0):
    """Trades of one series: (entry bar, exit bar, side, entry, exit, reason, net percent).

    Signals act at the next open (or the same close); a stop wins over a target; a bar that opens beyond a level fills at
    its open and says so; an opposite signal reverses.
    """
    out = []
    side, price, since, peak = 0, 0.0, 0, 0.0

    def leave(i, at, why):
        nonlocal side
        out.append((since, i, side, price, at, why, (at / price - 1) * 100 * side - cost))
        side = 0

    for i in range(len(c)):
        wanted = position[i - 1] if fill_next and i else 0 if fill_next else position[i]
        entry = o[i] if fill_next else c[i]
        if side and fill_next and wanted != side:
            leave(i, entry, "SIGNAL")
        if side and i > since:
            worst, best = (low[i], h[i]) if side > 0 else (h[i], low[i])
            level = None if sl is None else price * (1 - side * sl / 100)
            if trail is not None:
                moved = peak * (1 - side * trail / 100)
                level = moved if level is None else max(level, moved) if side > 0 else min(level, moved)
            goal = None if tp is None else price * (1 + side * tp / 100)
            if level is not None and (worst - level) * side <= 0:
                gap = (o[i] - level) * side < 0
                leave(i, o[i] if gap else level, "SL_GAP" if gap else "SL")
            elif goal is not None and (best - goal) * side >= 0:
                gap = (o[i] - goal) * side > 0
                leave(i, o[i] if gap else goal, "TP_GAP" if gap else "TP")
            elif max_bars is not None and i - since >= max_bars:
                leave(i, c[i], "TIME")
            else:
                peak = max(peak, best) if side > 0 else min(peak, best)
        if side and not fill_next and wanted != side:
            leave(i, c[i], "SIGNAL")
        changed = wanted and (i < 2 or wanted != (position[i - 2] if fill_next else position[i - 1]))
        if not side and changed and entry > 0:
            side, price, since, peak = int(wanted), entry, i, entry
    if side:
        leave(len(c) - 1, c[-1], "END")
    return out


def backtest(signalled: DataFrame, sl=None, tp=None, trail=None, max_bars=None, fill_next: bool = True, cost: float = 0.0) -> DataFrame:
    """Trades of every (symbol, rule) of ``signals``; one pair's bars are one group, bounded by time."""

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("ts")
        o, h, low, c = (frame[x].to_numpy(float) for x in ("open", "high", "low", "close"))
        found = walk(o, h, low, c, frame["position"].to_numpy(int), sl, tp, trail, max_bars, fill_next, cost)
        ts = frame["ts"].to_numpy()
        rows = [(frame["symbol"].iloc[0], frame["rule"].iloc[0], ts[a], ts[b], side, float(p), float(q), why, b - a, float(net)) for a, b, side, p, q, why, net in found]
        return pd.DataFrame(rows, columns=["symbol", "rule", "entry_ts", "exit_ts", "side", "entry_price", "exit_price", "exit_reason", "duration_bars", "net"])

    schema = "symbol string, rule string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, entry_price double, exit_price double, exit_reason string, duration_bars long, net double"
    return signalled.groupBy("symbol", "rule").applyInPandas(run, schema)


# --- costs and sizing ------------------------------------------------------------------------------------------------


def round_trip_cost(price: Column, lot: int = 50, brokerage: float = 20.0, exchange: float = 0.0005, stt: float = 0.000625, stamp: float = 0.00003, gst: float = 0.18, slippage: float = 0.0) -> Column:
    """Percent of the entry: two orders, exchange and tax on turnover, GST on fees, slippage on both sides."""
    turnover = price * lot
    fees = 2 * brokerage + 2 * exchange * turnover
    return ratio(fees * (1 + gst) + (stt + stamp) * turnover + 2 * slippage * turnover, turnover) * 100


def break_even_win_rate(sl: Column, tp: Column, cost: Column) -> Column:
    return ratio(sl + cost, sl + tp)


def size_lots(equity: Column, atr: Column, risk: float = 0.01) -> Column:
    """Units whose ATR costs ``risk`` of the equity."""
    return F.floor(F.coalesce(ratio(equity * risk, atr), F.lit(0.0)))


# --- metrics ---------------------------------------------------------------------------------------------------------


def trade_metrics(trades: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per ``key``: counts, means, profit factor (null without losers), Sharpe and Sortino per trade, drawdown.

    The drawdown is of the added returns in ``order``, a number; it comes from runs of trades that merge, so no window holds
    a whole ledger.
    """
    r = F.col(value)
    falls = paths.paths(trades, key, value, order).select(F.col(key).alias("_key"), "max_drawdown")
    gain, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r < 0, -r))
    told = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(r > 0).alias("wins"),
        F.count_if(r < 0).alias("losses"),
        F.avg(r).alias("expectancy"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
        ratio(gain, loss).alias("profit_factor"),
        (ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.count(F.lit(1)))).alias("trade_sharpe"),
        ratio(F.avg(r), F.stddev_samp(F.when(r < 0, r))).alias("sortino"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
    )
    joined = told.join(falls, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return joined.select(*told.columns[:-2], "max_drawdown", "best", "worst")


def daily_sharpe(trades: DataFrame, key: str, value: str, day: str) -> DataFrame:
    """Annualised Sharpe of daily sums."""
    days = trades.groupBy(key, day).agg(F.sum(value).alias("_d"))
    return days.groupBy(key).agg(F.count(F.lit(1)).alias("days"), (ratio(F.avg("_d"), F.stddev_samp("_d")) * float(np.sqrt(252))).alias("daily_sharpe"))


def concentration(trades: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Share of the total that the best 1, 5 and 10 trades hold, and the mean without the best 5.

    Only a key's best ten are ever ranked, every task's own before the shuffle; the rest is in the totals.
    """
    w = Window.partitionBy(key).orderBy(F.desc(value), tie)
    best = trades.select(F.col(key).alias("_key"), F.col(value).alias("_v"), F.row_number().over(w).alias("_k")).where(F.col("_k") <= 10)
    top = lambda k: F.sum(F.when(F.col("_k") <= k, F.col("_v")))
    tops = best.groupBy("_key").agg(*[top(k).alias(f"_top{k}") for k in (1, 5, 10)], F.count(F.when(F.col("_k") <= 5, F.col("_v"))).alias("_five"))
    told = trades.groupBy(key).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n")).join(tops, F.col(key).eqNullSafe(F.col("_key")))
    shares = [ratio(F.col(f"_top{k}"), F.col("_sum")).alias(f"top{k}") for k in (1, 5, 10)]
    return told.select(key, *shares, ratio(F.col("_sum") - F.col("_top5"), F.col("_n") - F.col("_five")).alias("mean_without_best5"))


def streak_stats(trades: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Longest runs of winners and losers, in ``order``, a number."""
    return paths.paths(trades, key, value, order).select(key, "max_wins", "max_losses")


def clustering(trades: DataFrame, key: str, value: str, order: str, run_rows: int = paths.RUN_ROWS) -> DataFrame:
    """Correlation of a trade with the one before it, in ``order``, a number; runs look back to the last trade of the run before."""
    edges = paths.run_edges(trades, order, run_rows)
    rows = trades.select(key, F.col(order).alias("_order"), F.col(value).alias("_v"), paths.run_of(F.col(order), edges).alias("run"))
    # ties in order are ordered by value
    told = paths.with_entry(rows, [key], F.max(F.struct("_order", "_v")))
    before = F.coalesce(F.lag("_v").over(Window.partitionBy(key, "run").orderBy("_order", "_v")), F.col("came._v"))
    return told.withColumn("_b", before).groupBy(key).agg(F.corr("_v", "_b").alias("autocorrelation"))


def distribution(trades: DataFrame, key: str, value: str) -> DataFrame:
    """Moments by explicit sums (population skewness, raw kurtosis) and percentiles."""
    r, n = F.col(value), F.count(value)
    # about the sample deviation, as the built-in moments are about the population's
    skew, kurt = F.skewness(r) * F.pow((n - 1) / n, 1.5), (F.kurtosis(r) + 3) * F.pow((n - 1) / n, 2.0)
    return trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), skew.alias("skew"), kurt.alias("kurtosis"), *[F.expr(f"percentile({value}, {q})").alias(f"p{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)]
    )


def heatmap(trades: DataFrame, ts: str, value: str) -> DataFrame:
    """Trades by 15-minute bucket of the exchange day."""
    return trades.groupBy(bucket15(F.col(ts)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("net"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))


def profile_cells(trades: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every combination of the keys and of their parts (a cube): n, mean, win rate, class by sample size."""
    out = trades.cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("win_rate"))
    return out.withColumn("tier", sample_tier(F.col("n")))


def sample_tier(n: Column) -> Column:
    return F.when(n < 10, "INSUFFICIENT").when(n < 30, "EXPLORATORY").otherwise("RANKABLE")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share."""
    p = ratio(k, n)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def cap_dominance(trades: DataFrame, key: str) -> DataFrame:
    """Share of exits by reason."""
    n = F.count(F.lit(1))
    by = lambda why: (F.count_if(F.col("exit_reason") == why) / n).alias(f"share_{why.lower()}")
    return trades.groupBy(key).agg(n.alias("n"), by("SL"), by("TP"), by("TIME"))


# --- boards ----------------------------------------------------------------------------------------------------------


def board(metrics: DataFrame, objective: str = "expectancy") -> DataFrame:
    """Rank by the objective, then trades, then key; rows without trades last.  One row per configuration, so it is small."""
    w = Window.orderBy(F.desc(F.col("n") > 0), F.desc_nulls_last(objective), F.desc("n"), "cfg")
    return metrics.withColumn("rank", F.row_number().over(w))


def once(frame: DataFrame) -> DataFrame:
    """``frame`` worked out once: kept in the folder of checkpoints, or by the executors where none is named."""
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame.persist()


#: configurations that one task thins out
PART = 5000


def pareto(metrics: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """Configurations that no other is at least as good as in everything and better in something.

    Parts of about PART rows are thinned out first, each by itself; only what is best in its part is compared with all.
    Metrics are worked out once and kept: sums of doubles end in other digits when blocks come in another order, and a
    row that is worked out twice would beat itself.
    """
    metrics = once(metrics)
    parts = max(1, -(-metrics.count() // PART))
    if parts > 1:
        dealt = metrics.withColumn("_part", F.pmod(F.xxhash64(*metrics.columns), F.lit(parts)).cast("int"))

        def thin(frame):
            x = np.concatenate([frame[up].to_numpy(float), -frame[down].to_numpy(float)], axis=1)
            keep = [not ((x >= row).all(1) & (x > row).any(1)).any() for row in x]
            return frame[keep].drop(columns="_part")

        metrics = dealt.groupBy("_part").applyInPandas(thin, metrics.schema)
    a, b = metrics.alias("a"), metrics.alias("b")
    as_good, better = F.lit(True), F.lit(False)
    for c in up:
        as_good, better = as_good & (F.col(f"b.{c}") >= F.col(f"a.{c}")), better | (F.col(f"b.{c}") > F.col(f"a.{c}"))
    for c in down:
        as_good, better = as_good & (F.col(f"b.{c}") <= F.col(f"a.{c}")), better | (F.col(f"b.{c}") < F.col(f"a.{c}"))
    return a.join(b, as_good & better, "left_anti")


def shrunk_sharpe(sharpe: Column, n: Column, k: float = 30.0) -> Column:
    return sharpe * ratio(n.cast("double"), n + k)


FILTERS = ("min_events", "positive", "profit_factor", "drawdown", "sharpe")


def filter_log(metrics: DataFrame, least: int = 30) -> DataFrame:
    """How many configurations come into each filter and how many pass, in order."""
    tests = [F.col("n") >= least, F.col("expectancy") > 0, F.coalesce(F.col("profit_factor") > 1, F.lit(True)), F.col("max_drawdown") < 500, F.col("trade_sharpe") > 0.5]
    marks, before = [], F.lit(True)
    for k, (name, test) in enumerate(zip(FILTERS, tests, strict=True)):
        now = before & F.coalesce(test, F.lit(False))
        marks.append(F.struct(F.lit(k).alias("step"), F.lit(name).alias("filter"), before.cast("long").alias("came"), now.cast("long").alias("passed")))
        before = now
    return metrics.select(F.explode(F.array(*marks)).alias("x")).select("x.*").groupBy("step", "filter").agg(F.sum("came").alias("came"), F.sum("passed").alias("passed"))
