"""Premium features per contract, events made of several flags, divergence outcomes and sign-flip surrogates.

Frames look back only; what a bar is compared with ends at the bar before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths
from .series import ratio, series


def _flag(x: Column) -> Column:
    return F.coalesce(x.cast("int"), F.lit(0))


def premium_features(frame: DataFrame, width: int = 120, least: int = 20) -> DataFrame:
    """``frame`` (bars with return_1, return_5, accel_1_3) with breakout, reversal, shock, rank and persistence columns.

    volume_ratio is volume against the median of the frame before; volume_persistence counts bars in a row above 1.2;
    premium_percentile and premium_zscore place the size of the last return among those before, with the population's deviation.
    """
    before = lambda c: F.lag(c).over(series())
    past = series().rowsBetween(-width, -1)
    size = F.abs("return_1")
    many = F.count(size).over(past) >= least
    spread = F.stddev_pop(size).over(past)
    out = frame.withColumns(
        {
            "range_ratio": ratio(F.col("high") - F.col("low"), before(F.col("high") - F.col("low"))),
            "volume_ratio": F.when(F.count("volume").over(past) >= least, ratio(F.col("volume"), F.percentile("volume", F.lit(0.5)).over(past))),
            "premium_percentile": F.when(many & size.isNotNull(), F.size(F.filter(F.collect_list(size).over(past), lambda x: x <= size)) * 100.0 / F.count(size).over(past)),
            "premium_zscore": F.when(many, ratio(size - F.avg(size).over(past), spread)),
            "premium_accel": F.col("accel_1_3") - before("accel_1_3"),
            "premium_decel": -F.col("accel_1_3"),
            "premium_shock": _flag(size > 3),
            "premium_mean_reversion": _flag((F.col("return_1") * before("return_1") < 0) & (F.abs(before("return_1")) > 1)),
            "alternating": _flag(((F.col("return_1") > 0) != (before("return_1") > 0)) & ((before("return_1") > 0) != (F.lag("return_1", 2).over(series()) > 0))),
        }
    )
    out = out.withColumn("premium_breakout", _flag((F.col("range_ratio") > 2) & (F.abs("return_5") > 1.5))).withColumn("premium_expansion", _flag(F.col("range_ratio") > 2))
    loud = F.coalesce(F.col("volume_ratio") > 1.2, F.lit(False))
    out = out.withColumn("_island", F.count_if(~loud).over(series()))
    run = F.count_if(loud).over(Window.partitionBy("symbol", "_island").orderBy("ts"))
    return out.withColumn("volume_persistence", F.when(loud, run).otherwise(0)).drop("_island")


def combo_events(frame: DataFrame, leads: list[str] | None = None) -> DataFrame:
    """Events of two or three flags (e_large_ret, e_vol_shock, e_compression, e_expansion, e_type_accel, e_atm_move).

    The compression of compress-then-expand is that of the contract's own last bar.
    """
    on = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    quiet = reduce(lambda a, b: a & b, [~on(c) for c in leads], F.lit(True)) if leads else F.lit(True)
    coiled = F.coalesce(F.lag("e_compression").over(series()) == 1, F.lit(False))
    return frame.withColumns(
        {
            "ev_largeRet_volShock": _flag(on("e_large_ret") & on("e_vol_shock")),
            "ev_compress_expand": _flag(coiled & on("e_expansion")),
            "ev_typeAccel_otherStall": _flag(on("e_type_accel") & quiet),
            "ev_atm_neighbor": _flag(on("e_atm_move")),
            "ev_ret_vol_expand": _flag(on("e_large_ret") & on("e_vol_shock") & on("e_expansion")),
        }
    )


def convergence(frame: DataFrame, spreads: list[str], threshold: float = 1.5) -> DataFrame:
    """``ev_convergence``: a spread was beyond the threshold a bar ago and is smaller now, so the event is known at its bar."""
    was = lambda c: F.abs(F.lag(c).over(series()))
    hit = [F.coalesce((was(c) > threshold) & (F.abs(c) < was(c)), F.lit(False)) for c in spreads]
    return frame.withColumn("ev_convergence", _flag(reduce(lambda a, b: a | b, hit, F.lit(False))))


def catchup(frame: DataFrame, spreads: list[str], threshold: float = 2.0) -> DataFrame:
    """``ev_catchup_setup``: one side moved by at least the threshold more than the other."""
    hit = [F.coalesce(F.abs(c) >= threshold, F.lit(False)) for c in spreads]
    return frame.withColumn("ev_catchup_setup", _flag(reduce(lambda a, b: a | b, hit, F.lit(False))))


def catchup_outcomes(frame: DataFrame, mask: Column, label: str, move: float = 0.5) -> DataFrame:
    """(n, catch_up, keeps_lagging, reversal): shares of the events' labels above, between and below plus and minus ``move``."""
    y = F.col(label)
    seen = frame.where(F.coalesce(mask, F.lit(False)) & y.isNotNull())
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return seen.agg(F.count(F.lit(1)).alias("n"), share(y > move).alias("catch_up"), share((y <= move) & (y >= -move)).alias("keeps_lagging"), share(y < -move).alias("reversal"))


def oi_shocks(chain: DataFrame, width: int = 120, least: int = 20, rank: float = 95.0, coverage: float = 0.5) -> DataFrame:
    """``chain`` with oi_percentile and e_oi_shock, from open interest up to the bar before; all null and 0 where it is too sparse.

    As published, the last value before the bar is ranked in the frame that ends with it.
    """
    there = chain.agg(F.coalesce(F.avg(F.col("oi").isNotNull().cast("double")), F.lit(0.0)).alias("_there"))
    past = series().rowsBetween(-width, -1)
    last = F.lag("oi").over(series())
    place = F.size(F.filter(F.collect_list("oi").over(past), lambda x: x <= last)) * 100.0 / F.count("oi").over(past)
    ranked = chain.withColumn("_rank", F.when((F.count("oi").over(past) >= least) & last.isNotNull(), place))
    out = ranked.join(F.broadcast(there)).withColumn("oi_percentile", F.when(F.col("_there") >= coverage, F.col("_rank")))  # one row is broadcast
    return out.withColumn("e_oi_shock", _flag(F.col("oi_percentile") >= rank)).drop("_rank", "_there")


def top_share(trades: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.01, 0.05, 0.1), run_rows: int = paths.RUN_ROWS) -> DataFrame:
    """Share of the absolute result that the largest ``shares`` of a key's trades make (at least one trade).

    Null results are left out.  Trades of one size are one row with a count.  Sizes are cut into runs, largest first; a size gives as many trades as are
    still wanted after those of the runs and sizes before it.
    """
    sized = trades.select(key, F.abs(value).alias("_size")).where(F.col("_size").isNotNull()).groupBy(key, "_size").agg(F.count(F.lit(1)).alias("_c"))
    sized = sized.withColumn("_place", -F.col("_size"))
    rows = sized.withColumn("run", paths.run_of(F.col("_place"), paths.run_edges(sized, "_place", run_rows)))
    parts = rows.groupBy(F.col(key).alias("_key"), F.col("run").alias("_run")).agg(F.sum("_c").alias("_n"))
    whole = Window.partitionBy("_key")
    parts = parts.withColumns({"_ahead": F.coalesce(F.sum("_n").over(whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_n").over(whole)})
    inside = F.sum("_c").over(Window.partitionBy(key, "run").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    placed = rows.withColumn("_inside", inside).join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("run") == F.col("_run")))
    taken = lambda s: F.least(F.greatest(F.greatest(F.lit(1), F.ceil(F.col("_all") * s)) - F.col("_ahead") - F.col("_inside"), F.lit(0)), F.col("_c"))
    total = F.sum(F.col("_size") * F.col("_c"))
    return placed.groupBy(key).agg(*[ratio(F.sum(F.col("_size") * taken(s)), total).alias(f"top{round(s * 100)}pct") for s in shares])


def sign_flip_test(trades: DataFrame, key: str, value: str, order: str, n: int = 200) -> DataFrame:
    """(key, observed, p): how often a mean with random signs is at least the observed one, the observed one counted.

    A sign is a bit of a hash of the trade and the repetition; a task adds up all repetitions of its trades before the
    shuffle, so what is moved is one row for each key, repetition and task.
    """
    signs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(F.xxhash64(F.col(order), k) % 2 == 0, F.col(value)).otherwise(-F.col(value)))
    flipped = trades.select(key, value, F.posexplode(F.concat(F.array(F.col(value)), signs)).alias("rep", "x"))
    means = flipped.groupBy(key, "rep").agg(F.avg("x").alias("m"))
    seen = means.where("rep = 0").select(key, F.col("m").alias("observed"))
    return means.where("rep > 0").join(seen, key).groupBy(key).agg(F.max("observed").alias("observed"), ((1 + F.count_if(F.col("m") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))
