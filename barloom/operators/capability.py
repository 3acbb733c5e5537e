"""What a chain's data can support: facts of its snapshots, the contracts worth a search, modules, fields and horizons.

Everything comes from partial aggregates by snapshot or by contract; no pass keeps more than one row of either.  "At least two
different values" is asked as least against greatest value, so no set is ever built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio

# Names and thresholds of the reports.
AVAILABLE, PARTIAL, UNAVAILABLE, INSUFFICIENT = "AVAILABLE", "PARTIAL", "UNAVAILABLE", "INSUFFICIENT"
IDENTITY = ("symbol", "expiry", "strike", "option_type", "ts")
FIELDS = ("open", "high", "low", "close", "volume", "oi", "bid", "ask")
CONTRACT = ("symbol", "expiry", "strike", "option_type")
SCOPE_COLUMNS = (*CONTRACT, "ts", "day")
UNKNOWN = ("", "nan", "UNKNOWN")
WHOLE, SOME = 0.8, 0.2


def _known(frame: DataFrame, column: str) -> Column:
    """True where a number is there; a column the frame lacks, a null or a NaN is not."""
    if column not in frame.columns:
        return F.lit(False)
    x = F.col(column).cast("double")
    return x.isNotNull() & ~F.isnan(x)


def chain_facts(chain: DataFrame) -> DataFrame:
    """One row: counts of contracts, expiries, strikes, option types, snapshots and days, whole snapshots (all contracts quoted)
    and their share, missing closes, repeated (ts, symbol) rows, first and last ts, has_bidask, has_oi.

    An empty chain gives one row of zeros.  Null strikes and types are no value of their own.
    """
    cells = chain.groupBy("ts", *CONTRACT).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~_known(chain, "close")).alias("missing"),
        F.max(_known(chain, "bid") | _known(chain, "ask")).alias("quoted"),
        F.max(_known(chain, "oi")).alias("open_interest"),
    )
    contracts = cells.groupBy(*CONTRACT).agg(F.lit(1).alias("one"))
    told = contracts.agg(*[F.countDistinct(c).alias(n) for c, n in (("symbol", "n_contracts"), ("expiry", "n_expiries"), ("strike", "n_strikes"), ("option_type", "n_option_types"))])
    by_symbol = cells.groupBy("ts", "symbol").agg(*[F.sum(c).alias(c) for c in ("rows", "missing")], *[F.max(c).alias(c) for c in ("quoted", "open_interest")])
    snapshots = by_symbol.groupBy("ts").agg(
        F.count("symbol").alias("width"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.sum(F.col("rows") - 1).alias("repeated"), F.max("quoted").alias("quoted"), F.max("open_interest").alias("open_interest")
    )
    # one row, however long the chain
    seen = snapshots.crossJoin(F.broadcast(told)).agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.count_if(F.col("width") == F.col("n_contracts")).alias("whole_snapshots"),
        F.countDistinct(F.to_date("ts")).alias("n_days"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("missing", "missing_closes"), ("repeated", "repeated_rows"))],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.coalesce(F.max(c), F.lit(False)).alias(n) for c, n in (("quoted", "has_bidask"), ("open_interest", "has_oi"))],
    )
    out = told.crossJoin(F.broadcast(seen))
    return out.withColumn("completeness", F.coalesce(F.round(ratio(F.col("whole_snapshots"), F.col("snapshots")), 4), F.lit(0.0)))


def modules(facts: DataFrame, least_snapshots: int = 500, least_days: int = 6) -> DataFrame:
    """(module, status, reason) of the one row of ``chain_facts``."""
    c = F.col
    data = (c("n_contracts") >= 1) & (c("snapshots") > 10)
    deep, out_of = c("snapshots") >= least_snapshots, F.concat(F.lit("only "), c("snapshots").cast("string"), F.lit(f" snapshots (< {least_snapshots})"))
    only = lambda column, what: F.concat(F.lit("only "), c(column).cast("string"), F.lit(f" {what}"))
    tests = [(n, data, F.lit("no identifiable contracts/timestamps/prices")) for n in ("OPTION_DATA", "CHAIN_STRUCTURE")]
    tests += [(n, deep, out_of) for n in ("RAW_PRICE", "VOLUME", "LEAD_LAG", "SEQUENCE", "CHAIN_STATE")]
    tests += [
        ("OPTION_TYPE_RELATIONSHIP", c("n_option_types") >= 2, only("n_option_types", "option type(s)")),
        ("STRIKE_RELATIONSHIP", c("n_strikes") >= 2, only("n_strikes", "strike(s)")),
        ("EXPIRY_RELATIONSHIP", c("n_expiries") >= 2, only("n_expiries", "expir(ies)")),
        ("EXECUTABLE_MODEL", c("has_bidask"), F.lit("no bid/ask fields; RESEARCH_PRICE_MODEL only")),
        ("OOS_VALIDATION", c("n_days") >= least_days, only("n_days", "day(s); VALIDATION_INSUFFICIENT_DATA")),
    ]
    rows = [F.struct(F.lit(n).alias("module"), F.when(ok, AVAILABLE).otherwise(UNAVAILABLE).alias("status"), F.when(ok, "").otherwise(why).alias("reason")) for n, ok, why in tests]
    return facts.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def universe(chain: DataFrame) -> DataFrame:
    """Every contract with its rows and closes; it is searchable with one known close, however illiquid or far from the money."""
    out = chain.groupBy(*CONTRACT).agg(F.count(F.lit(1)).alias("rows"), F.count_if(_known(chain, "close")).alias("closes"), F.sum("volume").alias("volume"))
    named = F.coalesce(~F.col("symbol").isin(*UNKNOWN), F.lit(False))
    return out.withColumn("searchable", named & (F.col("closes") > 0))


def priority(chain: DataFrame, strikes: int = 3, expiry: str | None = None) -> DataFrame:
    """``universe`` (of one expiry if given) with strike_rank by traded volume, ties to the lower strike, and first: whether
    the contract is tried before the others.

    It orders the search and removes nothing.  Without any strike, contracts rank by their own volume and twice as many are first.
    """
    picked = universe(chain if expiry is None else chain.where(F.col("expiry") == expiry))
    # one row for each strike of the ladder
    ladder = picked.where(F.col("strike").isNotNull()).groupBy("strike").agg(F.sum("volume").alias("_v"))
    ranked = ladder.select("strike", F.row_number().over(Window.orderBy(F.desc_nulls_last("_v"), "strike")).alias("strike_rank"))
    own = F.row_number().over(Window.orderBy(F.desc_nulls_last("volume"), "symbol", "expiry", "option_type"))
    none = picked.agg(F.count("strike").alias("_with_strike"))
    out = picked.withColumn("_own", own).join(F.broadcast(ranked), "strike", "left").crossJoin(F.broadcast(none))
    first = F.when(F.col("_with_strike") > 0, F.col("strike_rank") <= strikes).otherwise(F.col("_own") <= max(2, strikes * 2))
    return out.withColumn("first", F.coalesce(first, F.lit(False))).select(*picked.columns, "strike_rank", "first")


def _graded(n: Column, least: int) -> Column:
    return F.when(n >= least, AVAILABLE).when(n > 0, PARTIAL).otherwise(UNAVAILABLE)


def capability_map(chain: DataFrame, key: str, least: int = 50, identity: Sequence[str] = IDENTITY, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(key, capability, status): parts of the contracts' identity, fields by coverage, and how many snapshots hold two
    contracts, expiries or option types.  A column the chain lacks is unavailable; a null key is a key of its own."""
    n = F.count(F.lit(1))
    marks, aggregates = [], []
    for c in identity:
        if c in chain.columns:
            text = F.col(c).cast("string")
            aggregates.append((F.count_if(text.isNull() | text.isin(*UNKNOWN)) / n).alias(f"_bad_{c}"))
            bad = F.col(f"_bad_{c}")
            status = F.when(bad == 0, AVAILABLE).when(bad < SOME, PARTIAL).otherwise(INSUFFICIENT)
        else:
            status = F.lit(UNAVAILABLE)
        marks.append((f"identity:{c}", status))
    for c in fields:
        if c in chain.columns:
            aggregates.append((F.count_if(_known(chain, c)) / n).alias(f"_got_{c}"))
            got = F.col(f"_got_{c}")
            status = F.when(got >= WHOLE, AVAILABLE).when(got >= SOME, PARTIAL).otherwise(INSUFFICIENT)
        else:
            status = F.lit(UNAVAILABLE)
        marks.append((f"field:{c}", status))
    pairs = {"cross_contract": F.concat_ws("|", *[F.col(c).cast("string") for c in CONTRACT]), "cross_expiry": F.col("expiry"), "cepe": F.col("option_type")}
    two = lambda x: (F.min(x) < F.max(x))
    snapshots = chain.groupBy(key, "ts").agg(*[two(x).alias(f"_{p}") for p, x in pairs.items()])
    shared = snapshots.groupBy(F.col(key).alias("_key")).agg(*[F.count_if(F.col(f"_{p}")).alias(f"_{p}") for p in pairs])
    marks += [(f"overlap:{p}", _graded(F.col(f"_{p}"), least)) for p in pairs]
    rows = F.array(*[F.struct(F.lit(name).alias("capability"), status.alias("status")) for name, status in marks])
    told = chain.groupBy(key).agg(n.alias("_n"), *aggregates).join(shared, F.col(key).eqNullSafe(F.col("_key")))
    return told.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def temporal_coverage(chain: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Per key: rows, days, contracts, mean, median, least and most rows of a contract, gaps of the time axis beyond ``gap``."""
    per = chain.groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per.groupBy(key).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("contracts"), F.round(F.avg("_n"), 1).alias("rows_per_contract"), F.expr("median(_n)").alias("median_rows"), F.min("_n").alias("least_rows"), F.max("_n").alias("most_rows")
    )
    # a row for each time of a key, whatever the number of contracts
    axis = chain.groupBy(key, "ts").agg(F.lit(1).alias("_one")).withColumn("_before", F.lag("ts").over(Window.partitionBy(key).orderBy("ts")))
    times = axis.groupBy(F.col(key).alias("_key")).agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count_if(F.col("ts") > F.col("_before") + F.expr(f"INTERVAL {gap}")).alias("gaps"))
    return sizes.join(times, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def horizon_eligibility(frame: DataFrame, masks: Mapping[str, Column], spans: Sequence[int] = (1, 3, 5, 10, 15, 30), least: int = 50, label: str = "fwd_ret_{}") -> DataFrame:
    """(name, span, status, marked, events, coverage, positive_rate, median, mean) of every mask and horizon.

    Nothing is padded: events are marked rows with a known label.  A horizon without a column is unavailable.  The median is
    that of labels rounded to four digits, so its counts are bounded by the labels' range.
    """
    known = [s for s in spans if label.format(s) in frame.columns]
    hits = F.filter(F.array(*[F.when(F.coalesce(m, F.lit(False)), F.lit(n)) for n, m in masks.items()]), lambda x: x.isNotNull())
    values = F.array(*[F.struct(F.lit(s).alias("span"), (F.col(label.format(s)) if s in known else F.lit(None)).cast("double").alias("y")) for s in spans])
    narrow = frame.select(hits.alias("_names"), values.alias("_values")).where(F.size("_names") > 0)
    long = narrow.select(F.explode("_names").alias("name"), "_values").select("name", F.explode("_values").alias("x")).select("name", "x.*")
    y = F.when(F.isnan("y"), None).otherwise(F.col("y"))
    told = long.withColumns({"y": y, "_r": F.round(y, 4)}).groupBy("name", "span").agg(
        F.count(F.lit(1)).alias("marked"), F.count("y").alias("events"), F.avg((F.col("y") > 0).cast("double")).alias("positive_rate"), F.expr("median(_r)").alias("median"), F.avg("y").alias("mean")
    )
    # masks that no row meets have their rows too
    wanted = frame.sparkSession.createDataFrame([(n, s, s in known) for n in masks for s in spans], "name string, span int, known boolean")
    out = wanted.join(told, ["name", "span"], "left").fillna(0, ["marked", "events"])
    status = F.when(~F.col("known"), UNAVAILABLE).when(F.col("events") >= least, AVAILABLE).otherwise(INSUFFICIENT)
    return out.select("name", "span", status.alias("status"), "marked", "events", F.coalesce(ratio(F.col("events"), F.col("marked")), F.lit(0.0)).alias("coverage"), "positive_rate", "median", "mean")


# --- which features a track may look at ------------------------------------------------------------------------------

# Columns made by ranking contracts, and families by what they may see.
SELECTORS = ("sel_vol_rank", "sel_mom_rank", "sel_vol_trail", "sel_mom_trail")
SCOPES = ("SCOPE_SIDE", "SCOPE_EXPIRY", "SCOPE_STRIKE", "SCOPE_CONTRACT")
RANKED = ("SEL_VOL_RANK", "SEL_MOM_RANK")


def _all_in(columns: Column, allowed: Sequence[str]) -> Column:
    return F.forall(columns, lambda c: c.isin(*allowed))


def spec_track(family: Column, columns: Column, families: Sequence[str], own: Sequence[str]) -> Column:
    """A for hypotheses of ``families`` on the contract's ``own`` columns alone, BOTH for scopes and selectors, else B."""
    alone = family.isin(*families) & _all_in(columns, own)
    return F.when(F.coalesce(alone, F.lit(False)), "A").when(family.isin(*SCOPES, *RANKED), "BOTH").otherwise("B")


def child_track(parent: Column, leg: Column, own: Sequence[str]) -> Column:
    """The stricter one of the parent's track and what the leg's columns allow."""
    return F.when(F.coalesce((parent != "B") & _all_in(leg, own), F.lit(False)), "A").otherwise("B")


def allows(track: Column, columns: Column, own: Sequence[str], scopes: Sequence[str] = SCOPE_COLUMNS) -> Column:
    """Whether a track may resolve ``columns``: track A sees own, selector and identity columns only, others all."""
    return (track != "A") | _all_in(columns, [*own, *SELECTORS, *scopes])
