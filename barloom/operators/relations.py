"""Joins across contracts: as-of, option types, strikes, breadth, lead and lag, contract selection.

Self joins are on time and one more key with few values per time (strikes of an expiry), or between neighbours by rank;
as-of joins are one union and a running last value inside each day, with what earlier days end with carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio, series


def asof(left: DataFrame, right: DataFrame, value: str, keys: tuple[str, ...] = ("symbol",), forward: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before its ts (with ``forward``: the next at or after).

    Rows without a partner get null; a right row at the same ts counts; of several there the greatest value counts.
    Rows meet inside a day, so one long series is many tasks; a day begins with the last value of the days before it,
    which are one row each.
    """
    day, kind = F.to_date("ts").alias("_day"), right.schema[value].dataType
    way, edge = (F.desc, F.min_by) if forward else (F.asc, F.max_by)
    a = left.withColumns({"_side": F.lit(2), "_value": F.lit(None).cast(kind)}).withColumn("_day", day)
    b = right.where(F.col(value).isNotNull()).groupBy(*keys, "ts").agg(F.max(value).alias("_value")).select("*", F.lit(1).alias("_side"), day)
    ends = b.groupBy(*keys, "_day").agg(edge("_value", "ts").alias("_value"))
    days = left.select(*keys, day, F.lit(None).cast(kind).alias("_value")).distinct().unionByName(ends).groupBy(*keys, "_day").agg(F.max("_value").alias("_value"))
    carried = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(way("_day")).rowsBetween(Window.unboundedPreceding, -1))
    starts = days.withColumn("_value", carried).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_day").orderBy(F.least("_side", F.lit(1)), way("ts"), "_side")
    found = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, found).where("_side = 2").drop("_side", "_value", "_day")


def type_pairs(chain: DataFrame) -> DataFrame:
    """Call and put of one strike, expiry and time side by side, with the differences of their returns and volumes.

    ``chain`` has return_5 and accel_1_3; leads are 1 where one side moves and the other does not follow yet.
    """
    side = lambda kind, mark: chain.where(F.col("option_type") == kind).select(
        "ts", "expiry", "strike", *[F.col(c).alias(f"{c}_{mark}") for c in ("close", "volume", "return_5", "accel_1_3")]
    )
    both = side("CE", "a").join(side("PE", "b"), ["ts", "expiry", "strike"])
    flag = lambda on: F.coalesce(on, F.lit(False)).cast("int")
    ra, rb = F.col("return_5_a"), F.col("return_5_b")
    return both.withColumns(
        {
            "type_ret_diff": ra - rb,
            "type_price_ratio": ratio(F.col("close_a"), F.col("close_b")),
            "type_vol_ratio": ratio(F.col("volume_a"), F.col("volume_b")),
            "ev_a_leads_b": flag((ra > 1) & (rb < 0.5)),
            "ev_a_accel_b_stall": flag((F.col("accel_1_3_a") > 1) & (F.abs("accel_1_3_b") < 0.5)),
        }
    )


def strike_pairs(chain: DataFrame, measures: tuple[str, ...] = ("return_5", "volume")) -> DataFrame:
    """All pairs of lower and higher strike of one time, expiry and type, kept long: measure differences.

    The pairs of one key are as many as an expiry has strikes, squared; the key is the time, so no key grows with the data.
    """
    low = chain.select("ts", "expiry", "option_type", F.col("strike").alias("strike_a"), *[F.col(m).alias(f"{m}_a") for m in measures])
    high = chain.select("ts", "expiry", "option_type", F.col("strike").alias("strike_b"), *[F.col(m).alias(f"{m}_b") for m in measures])
    both = low.join(high, ["ts", "expiry", "option_type"]).where("strike_a < strike_b")
    return both.select("ts", "expiry", "option_type", "strike_a", "strike_b", *[(F.col(f"{m}_a") - F.col(f"{m}_b")).alias(f"{m}_diff") for m in measures])


def adjacent_strikes(chain: DataFrame) -> DataFrame:
    """Each strike against the next one up: price ratio, return spread; one window, no self join."""
    w = Window.partitionBy("ts", "expiry", "option_type").orderBy("strike")
    return chain.select(
        "ts", "expiry", "option_type", "strike", F.lead("strike").over(w).alias("next_strike"), ratio(F.col("close"), F.lead("close").over(w)).alias("price_ratio"), (F.col("return_5") - F.lead("return_5").over(w)).alias("ret_spread")
    ).where("next_strike is not null")


def breadth(chain: DataFrame) -> DataFrame:
    """Per time: contracts, mean return_5 and share of risers per type, and the difference of the types."""
    by = lambda kind, value: F.avg(F.when(F.col("option_type") == kind, value))
    r = F.col("return_5")
    up = F.when(r.isNotNull(), (r > 0).cast("double"))
    out = chain.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"), by("CE", r).alias("ce_ret"), by("PE", r).alias("pe_ret"), by("CE", up).alias("ce_up"), by("PE", up).alias("pe_up")
    )
    return out.withColumns({"ret_diff": F.col("ce_ret") - F.col("pe_ret"), "up_diff": F.col("ce_up") - F.col("pe_up")})


def cross_section(chain: DataFrame) -> DataFrame:
    """Per time: dispersion, concentration of volume, share of risers, and the mean's change against the time before.

    Concentration is the sum of squared shares of the volume, in whole hundredths: sums of whole numbers don't hang on their order.
    """
    whole = F.round(F.col("volume") * 100).cast("long")
    concentration = ratio(F.sum((whole * whole).cast("decimal(38,0)")).cast("double"), F.pow(F.sum(whole).cast("double"), F.lit(2.0)))
    out = chain.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"), concentration.alias("concentration"), F.stddev_samp("return_1").alias("dispersion"), F.avg("return_1").alias("chain_momentum"), F.avg((F.col("return_1") > 0).cast("double")).alias("up_frac")
    )
    return out


def volume_rank(chain: DataFrame) -> DataFrame:
    """Contracts of one time ranked by their trailing 60-bar volume (20 bars at least), ties share the best rank."""
    w = series().rowsBetween(-60, -1)
    total = F.when(F.count("volume").over(w) >= 20, F.sum("volume").over(w))
    out = chain.withColumn("trailing_volume", F.round(total, 4))
    return out.withColumn("volume_rank", F.when(F.col("trailing_volume").isNotNull(), F.rank().over(Window.partitionBy("ts").orderBy(F.desc_nulls_last("trailing_volume")))))


def momentum_rank(chain: DataFrame, span: int = 30) -> DataFrame:
    """Contracts of one time ranked by their change over ``span`` bars, ties share the best rank; null without that many."""
    out = chain.withColumn("_moved", ratio(F.col("close"), F.lag("close", span).over(series())) - 1)
    rank = F.rank().over(Window.partitionBy("ts").orderBy(F.desc_nulls_last("_moved")))
    return out.withColumn("momentum_rank", F.when(F.col("_moved").isNotNull(), rank)).drop("_moved")


def average_rank(frame: DataFrame, column: str, into: str, keys: tuple[str, ...]) -> DataFrame:
    """Rank from 1 with ties at their mean rank."""
    w, same = Window.partitionBy(*keys).orderBy(column), Window.partitionBy(*keys, column)
    return frame.withColumn(into, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def parity_atm(chain: DataFrame) -> DataFrame:
    """Per time the strike where call and put are closest in price; ties go to the lower strike."""
    ce = chain.where("option_type = 'CE'").select("ts", "strike", F.col("close").alias("ce"))
    pe = chain.where("option_type = 'PE'").select("ts", "strike", F.col("close").alias("pe"))
    both = ce.join(pe, ["ts", "strike"])
    return both.groupBy("ts").agg(F.min_by("strike", F.struct(F.abs(F.col("ce") - F.col("pe")), "strike")).alias("atm"))


def nearest_strike(levels: DataFrame, ladder: list[float]) -> DataFrame:
    """``levels`` (ts, level) with the nearest strike of a ladder (configuration); ties go to the lower one."""
    cells = F.array(*[F.struct(F.abs(F.col("level") - float(k)).alias("d"), F.lit(float(k)).alias("k")) for k in sorted(ladder)])
    return levels.withColumn("nearest", F.array_min(cells)["k"])


def strike_step(chain: DataFrame) -> DataFrame:
    """Median gap between neighbouring listed strikes per expiry."""
    strikes = chain.select("expiry", "strike").distinct()
    gap = F.col("strike") - F.lag("strike").over(Window.partitionBy("expiry").orderBy("strike"))
    return strikes.select("expiry", gap.alias("gap")).where("gap > 0").groupBy("expiry").agg(F.expr("median(gap)").alias("step"))


def straddle(chain: DataFrame) -> DataFrame:
    """Proxy underlying per time: mean of the types' closes, extremes of both, volumes added."""
    by = lambda kind: F.avg(F.when(F.col("option_type") == kind, F.col("close")))
    out = chain.groupBy("ts").agg(by("CE").alias("ce"), by("PE").alias("pe"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))
    return out.withColumn("close", F.coalesce((F.col("ce") + F.col("pe")) / 2, "ce", "pe"))


def select_contracts(signals: DataFrame, chain: DataFrame, target_steps: int = 1, max_steps: int = 3, step: float = 100.0) -> DataFrame:
    """For every signal (ts, level, option_type) the listed contract nearest to ``target_steps`` in the money.

    Never out of the money, never deeper than ``max_steps``; ties go to the strike nearer to the level, then the symbol.
    """
    pairs = signals.join(chain.select("ts", "option_type", "symbol", "strike", F.col("close").alias("price")), ["ts", "option_type"])
    depth = F.when(F.col("option_type") == "CE", F.col("level") - F.col("strike")).otherwise(F.col("strike") - F.col("level")) / step
    fits = pairs.withColumn("depth", depth).where(F.col("depth").between(0, max_steps))
    best = F.struct(F.abs(F.round("depth") - target_steps).alias("a"), F.abs(F.col("strike") - F.col("level")).alias("b"), F.col("symbol").alias("c"))
    return fits.groupBy("ts", "option_type", "level").agg(F.min_by(F.struct("symbol", "strike", "price"), best).alias("x")).select("ts", "option_type", "level", "x.*")


def lead_lag(frame: DataFrame, lags: tuple[int, ...] = (1, 2, 3), threshold: float = 1.0, least: int = 20) -> DataFrame:
    """Every ordered pair of symbols and lag: the target's forward return after the source has moved.

    ``frame`` has return_1 and fwd_ret_5.  The lag counts common timestamps.  Symbols of one time meet on the time, so
    the pairs are bounded by the contracts of a chain.
    """
    a = frame.select("ts", F.col("symbol").alias("source"), F.col("return_1").alias("moved"))
    b = frame.select("ts", F.col("symbol").alias("target"), F.col("fwd_ret_5").alias("fwd"))
    both = a.join(b, "ts").where("source <> target")
    w = Window.partitionBy("source", "target").orderBy("ts")
    both = both.withColumns({f"_r{k}": F.lead("fwd", k).over(w) for k in lags})
    later = both.select("source", "target", "moved", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_r{k}").alias("r")) for k in lags])).alias("x"))
    kept = later.where(F.abs("moved") > threshold).select("source", "target", "x.*").where("r is not null")
    return kept.groupBy("source", "target", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.expr("percentile(r, 0.5)").alias("median"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate")
    ).where(F.col("n") >= least)


def beta(frame: DataFrame, reference: DataFrame, width: int = 60, least: int = 20) -> DataFrame:
    """Trailing slope of a symbol's return on the reference's (ts, ref), and what the slope does not explain."""
    w = series().rowsBetween(-width, -1)
    both = frame.join(reference, "ts")
    slope = F.when(F.count("ref").over(w) >= least, ratio(F.covar_pop("return_1", "ref").over(w), F.var_pop("ref").over(w)))
    return both.withColumn("beta", slope).withColumn("resp_spread", F.col("return_1") - F.col("beta") * F.col("ref"))


def expiry_spreads(chain: DataFrame) -> DataFrame:
    """Same strike and type in neighbouring expiries of one time: price spread."""
    w = Window.partitionBy("ts", "strike", "option_type").orderBy("expiry")
    return chain.withColumn("next_close", F.lead("close").over(w)).where("next_close is not null").withColumn("expiry_spread", F.col("next_close") - F.col("close"))


def pooled_levels(ledger: DataFrame) -> DataFrame:
    """Contract, expiry and overall results in one pass of grouping sets: level, keys, n, net."""
    out = ledger.groupingSets([["expiry", "symbol"], ["expiry"], []], "expiry", "symbol").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("net").alias("net")
    )
    level = F.when(F.col("gid") == 0, "contract").when(F.col("gid") == 1, "expiry").otherwise("all")
    return out.select(level.alias("level"), "expiry", "symbol", "n", "net")


def semi(chain: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of listed symbols only."""
    return chain.join(universe.select("symbol"), "symbol", "left_semi")


def unlisted(expected: DataFrame, chain: DataFrame) -> DataFrame:
    """Expected symbols that have no row."""
    return expected.select("symbol").distinct().join(chain.select("symbol"), "symbol", "left_anti")


def moneyness(chain: DataFrame, levels: DataFrame) -> DataFrame:
    """Distance of a strike from the level (ts, level) in percent, its band and half-percent bucket."""
    pct = (ratio(F.col("strike"), F.col("level")) - 1) * 100
    band = F.when(F.abs(pct) <= 1, "ATM").when((pct > 0) == (F.col("option_type") == "CE"), "OTM").otherwise("ITM")
    return chain.join(levels, "ts").withColumns({"moneyness": pct, "band": band, "bucket": F.floor(pct * 2) / 2})


def instrument_id(symbol: Column, expiry: Column, strike: Column, option_type: Column) -> Column:
    return F.concat_ws("|", symbol, expiry, strike.cast("string"), option_type)
