"""Audits that compute again what the engine said: on histories cut off at sampled times, by other formulas, and on ledgers.

A feature that looks ahead changes when the future is taken away.  Every sampled bar gets a copy of its symbol's history up to
it, the features are computed once more over all copies in one job, and the value at the cut is held against the one that
was computed with the future there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio


def histories(bars: DataFrame, cut: Column, days: int | None = None) -> DataFrame:
    """The bars up to each bar for which ``cut`` holds, in one frame: the symbol is named after the cut, ``cut_symbol`` and
    ``cut_ts`` say which one it is.

    ``days`` bounds the history.  Bars meet cuts by symbol and day, so one symbol's bars are spread over its days.
    """
    day = F.date_trunc("day", "ts")
    first = bars.groupBy("symbol").agg(F.min(day).alias("_first"))
    cuts = bars.where(F.coalesce(cut, F.lit(False))).select("symbol", F.col("ts").alias("cut_ts")).distinct().join(first, "symbol")
    start = F.col("_first") if days is None else F.greatest("_first", F.date_trunc("day", "cut_ts") - F.make_interval(days=F.lit(days)))
    reach = cuts.select("symbol", "cut_ts", F.explode(F.sequence(start, F.date_trunc("day", "cut_ts"), F.expr("INTERVAL 1 DAY"))).alias("_day"))
    both = bars.withColumn("_day", day).join(reach, ["symbol", "_day"]).where(F.col("ts") <= F.col("cut_ts")).drop("_day")
    return both.withColumn("cut_symbol", F.col("symbol")).withColumn("symbol", F.concat_ws("|", "symbol", F.col("cut_ts").cast("string")))


def lookahead(bars: DataFrame, compute: Callable[[DataFrame], DataFrame], columns: Sequence[str], cut: Column, days: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(feature, checked, deviations, worst): values at sampled bars that change when the bars after them are gone.

    ``compute`` makes ``columns`` from bars, symbol by symbol; ``checked`` counts sampled bars where either value is there.
    A value deviates by more than ``tolerance``, relative above 1, or by being null on one side.  With ``days``, features of
    longer memory deviate too.
    """
    at = [F.col(c).cast("double").alias(c) for c in columns]
    cut_rows = histories(bars, cut, days)
    names = cut_rows.select("symbol", F.col("ts").alias("_ts"), "cut_symbol", "cut_ts").where(F.col("_ts") == F.col("cut_ts")).drop("_ts").distinct()
    again = compute(cut_rows.drop("cut_symbol", "cut_ts")).select("symbol", "ts", *at).join(names, "symbol").where(F.col("ts") == F.col("cut_ts"))
    again = again.select(F.col("cut_symbol").alias("symbol"), "ts", F.array(*columns).alias("_again"))
    whole = compute(bars).select("symbol", "ts", *at).select("symbol", "ts", F.array(*columns).alias("_whole"))
    each = again.join(whole, ["symbol", "ts"], "left").select(F.posexplode(F.arrays_zip("_again", "_whole")).alias("_k", "v"))
    a, b = F.col("v._again"), F.col("v._whole")
    gap = F.abs(a - b)
    off = F.coalesce(gap > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)), a.isNull() != b.isNull())
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_k") + 1)
    return each.groupBy(name.alias("feature")).agg(
        F.count_if(a.isNotNull() | b.isNotNull()).alias("checked"), F.count_if(off).alias("deviations"), F.coalesce(F.max(gap), F.lit(0.0)).alias("worst")
    )


def selectors(chain: DataFrame, ranked: DataFrame, cut: Column, width: int = 60, least: int = 20, span: int = 30) -> DataFrame:
    """(ts, contracts, volume_mismatches, momentum_mismatches) at sampled times: ranks against ranks made from raw bars.

    ``ranked`` has (ts, symbol, volume_rank, momentum_rank).  The second way numbers each contract's bars back from the
    sampled time and adds up the first ``width`` before it; only contracts that print at the time are ranked.
    """
    raw = chain.select("symbol", "ts", "volume", "close")
    cuts = raw.where(F.coalesce(cut, F.lit(False))).select("symbol", F.col("ts").alias("cut_ts")).distinct()
    back = Window.partitionBy("symbol", "cut_ts").orderBy(F.desc("ts"))
    seen = raw.join(cuts, "symbol").where(F.col("ts") <= F.col("cut_ts")).withColumn("_back", F.row_number().over(back) - 1)
    near = F.col("_back").between(1, width)
    told = seen.groupBy("symbol", "cut_ts").agg(
        F.when(F.max("_back") >= least, F.round(F.sum(F.when(near, F.col("volume"))), 4)).alias("trail"),
        (ratio(F.max(F.when(F.col("_back") == 0, F.col("close"))), F.max(F.when(F.col("_back") == span, F.col("close")))) - 1).alias("moved"),
    )
    place = lambda c: F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("cut_ts").orderBy(F.desc_nulls_last(c))))
    mine = told.select("symbol", F.col("cut_ts").alias("ts"), place("trail").alias("_volume"), place("moved").alias("_momentum"))
    both = mine.join(ranked.select("symbol", "ts", "volume_rank", "momentum_rank"), ["symbol", "ts"], "left")
    return both.groupBy("ts").agg(
        F.count(F.lit(1)).alias("contracts"),
        F.count_if(~F.col("_volume").eqNullSafe(F.col("volume_rank"))).alias("volume_mismatches"),
        F.count_if(~F.col("_momentum").eqNullSafe(F.col("momentum_rank"))).alias("momentum_mismatches"),
    )


def ledger(trades: DataFrame, universe: DataFrame, identity: Sequence[str] = ("symbol",)) -> DataFrame:
    """(trades, no_identity, bad_time, outsiders, off_bar, status) of a ledger with (symbol, entry_ts, exit_ts, entry_price).

    Outsiders trade a symbol that ``universe`` (symbol, ts, close) doesn't have; ``off_bar`` entries aren't a close of it.
    A ledger passes if it has no fault; an empty one passes.
    """
    symbols = universe.select(F.col("symbol").alias("_symbol")).distinct()
    closes = universe.select(F.col("symbol").alias("_s"), F.col("ts").alias("_t"), F.col("close").alias("_close"))
    told = trades.join(symbols, F.col("symbol") == F.col("_symbol"), "left").join(closes, (F.col("symbol") == F.col("_s")) & (F.col("entry_ts") == F.col("_t")), "left")
    missing = F.lit(False)
    for c in identity:
        missing = missing | F.col(c).isNull()
    out = told.agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(missing).alias("no_identity"),
        F.count_if(~F.coalesce(F.col("exit_ts") > F.col("entry_ts"), F.lit(False))).alias("bad_time"),
        F.count_if(F.col("symbol").isNotNull() & F.col("_symbol").isNull()).alias("outsiders"),
        F.count_if(F.col("_symbol").isNotNull() & ~F.col("entry_price").eqNullSafe(F.col("_close"))).alias("off_bar"),
    )
    clean = F.col("no_identity") + F.col("bad_time") + F.col("outsiders") + F.col("off_bar") == 0
    return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))


def pool_sum(pooled: DataFrame, parts: DataFrame, value: str, tolerance: float = 1e-6) -> DataFrame:
    """(pooled, parts, status): whether the ledgers of the parts add up to the pooled one; null values count as 0."""
    total = lambda frame, name: frame.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))
    both = total(pooled, "pooled").withColumn("_k", F.lit(1)).join(total(parts, "parts").withColumn("_k", F.lit(1)), "_k").drop("_k")
    close = F.abs(F.col("pooled") - F.col("parts")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col("pooled")))
    return both.withColumn("status", F.when(close, "PASS").otherwise("FAIL"))
