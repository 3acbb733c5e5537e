"""Validation of candidates: folds, groups, windows and splits as aggregates, ladders and gates as CASE expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inference import adjust

# Thresholds and weights of the gates.
MIN_SESSIONS, MIN_EXPIRIES, MIN_CONTRACTS = 50, 3, 10
MAX_SCOPE = 8
WEIGHTS = {"signal": 1.5, "sample": 1.5, "param": 1.0, "time": 1.0, "contract": 1.0, "oos": 1.5, "exit": 0.5, "concentration": 0.5, "best_event": 0.25, "stats": 0.25}


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


# --- folds and families ----------------------------------------------------------------------------------------------


def fold_stability(folds: DataFrame, key: str, least: int = 5) -> DataFrame:
    """(key, folds, live_folds, win_folds, fold_win_rate, thin_folds) of ``folds`` (key, n, expectancy); live ones have ``least`` trades."""
    live = _yes((F.col("n") >= least) & F.col("expectancy").isNotNull())
    out = folds.groupBy(key).agg(F.count(F.lit(1)).alias("folds"), F.count_if(live).alias("live_folds"), F.count_if(live & (F.col("expectancy") > 0)).alias("win_folds"))
    return out.withColumns({"fold_win_rate": F.when(F.col("live_folds") > 0, F.col("win_folds") / F.col("live_folds")), "thin_folds": F.col("folds") - F.col("live_folds")})


def hierarchical_fdr(pvalues: DataFrame, alpha: float = 0.10) -> DataFrame:
    """``pvalues`` (name, family, p) with p_adj, family_p_adj and passed: adjusted over all, and the families' least p over families.

    A null p counts as 1.
    """
    filled = pvalues.withColumn("p", F.coalesce("p", F.lit(1.0)))
    all_ = adjust(filled).select("name", "family", "p", F.col("bh").alias("p_adj"))
    families = adjust(filled.groupBy("family").agg(F.min("p").alias("p")).withColumnRenamed("family", "name"))
    both = all_.join(families.select(F.col("name").alias("family"), F.col("bh").alias("family_p_adj")), "family")
    return both.withColumn("passed", (F.col("family_p_adj") < alpha) & (F.col("p_adj") < alpha))


def discovery_tier(dsr: Column, fold_win_rate: Column, oos: Column, events: Column, paper: Column, least: int = 50, dsr_least: float = 0.95, rate_least: float = 0.6) -> tuple[Column, Column]:
    """(tier, reasons): PAPER and VALIDATED without reasons against, else LEAD with enough events, else REJECTED."""
    against = [
        F.when(events < least, F.concat(F.lit("events "), events.cast("string"))),
        F.when(~_yes(dsr >= dsr_least), F.lit("dsr")),
        F.when(~_yes(rate_least <= fold_win_rate), F.lit("fold_win_rate")),
        F.when(~_yes(oos > 0), F.lit("oos_expectancy")),
    ]
    reasons = F.filter(F.array(*against), lambda x: x.isNotNull())
    clean = F.size(reasons) == 0
    return F.when(clean & _yes(paper), "PAPER").when(clean, "VALIDATED").when(events >= least, "LEAD").otherwise("REJECTED"), reasons


def effective_n(signals: DataFrame, key: str = "name", limit: float = 0.99, buckets: int = 1024, most: int = 3000) -> tuple[int, int]:
    """(candidates, effective ones) of ``signals`` (key, pos, on): equal masks once, then strongly correlated ones once.

    A mask is known by the digest of its places, and by how many fall into each of ``buckets`` parts of the series.
    Clusters are formed greedily, busiest mask first, on the driver over the densities of at most ``most`` masks drawn
    by digest; beyond that the share of clusters is carried on to all.
    """
    import numpy as np

    size = signals.agg(F.max("pos")).first()[0]
    if size is None:
        return 0, 0
    n = signals.select(key).distinct().count()
    bucket = F.floor(F.col("pos") * buckets / (size + 1)).cast("int")
    places = signals.where("on").select(key, bucket.alias("b"), F.xxhash64("pos").alias("h"))
    cells = places.groupBy(key, "b").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"))
    masks = cells.groupBy(key).agg(F.sum("h").alias("digest"), F.sum("c").alias("events"), F.sort_array(F.collect_list(F.struct("b", "c"))).alias("density"))
    once = masks.groupBy("digest", "events").agg(F.min("density").alias("density"))
    total = once.count()
    rows = once.orderBy(F.xxhash64("digest", "events")).limit(most).collect()
    rows.sort(key=lambda r: (-r["events"], r["digest"]))
    heads: list = []
    for r in rows:
        x = np.zeros(buckets)
        x[[d["b"] for d in r["density"]]] = [d["c"] for d in r["density"]]
        x -= x.mean()
        norm = np.linalg.norm(x)
        x = x / norm if norm else x
        if not heads or np.abs(np.stack(heads) @ x).max() < limit:
            heads.append(x)
    return n, max(1, round(len(heads) * total / max(len(rows), 1))) if rows else min(n, 1)


# --- groups, windows, splits -----------------------------------------------------------------------------------------


def verdict(share: Column, least: float = 0.5) -> Column:
    return F.when(share.isNull(), "UNTESTABLE").when(share >= least, "PASS").otherwise("FAIL")


def generalization(events: DataFrame, dimensions: list[str], label: str, least: int = 5) -> DataFrame:
    """(dimension, groups, positive, positive_share, sign_agreement, status): in how many groups of each dimension the mean label is positive.

    Groups with fewer than ``least`` labels count as not positive; fewer than two groups are untestable.  All
    dimensions are made in one pass.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    cells = events.select(F.col(label).alias("y"), pairs).where("value is not null and value not in ('UNKNOWN', '')").groupBy("dimension", "value").agg(F.count("y").alias("n"), F.avg("y").alias("m"))
    good = _yes((F.col("n") >= least) & (F.col("m") > 0))
    out = cells.groupBy("dimension").agg(F.count(F.lit(1)).alias("groups"), F.count_if(good).alias("positive"))
    share = F.when(F.col("groups") >= 2, F.col("positive") / F.col("groups"))
    return out.withColumns({"positive_share": share, "sign_agreement": (F.col("positive") == 0) | (F.col("positive") == F.col("groups")), "status": verdict(share)})


def session_windows(events: DataFrame, label: str, windows: int = 4, least: int = 5) -> DataFrame:
    """(window, from_minute, to_minute, n, mean, positive): the observed session cut at quantiles of the minute of day."""
    timed = events.withColumn("minute", F.hour("ts") * 60 + F.minute("ts") + F.second("ts") / 60.0)
    cuts = timed.agg(F.percentile("minute", F.array(*[F.lit(k / windows) for k in range(windows + 1)])).alias("q"))
    parts = cuts.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.struct(F.floor(F.col("q")[k]).alias("a"), F.floor(F.col("q")[k + 1]).alias("b"))))).select((F.col("pos") + 1).alias("window"), "col.a", "col.b")
    # four rows: a minute on a cut belongs to both windows
    met = timed.join(F.broadcast(parts), F.floor("minute").between(F.col("a"), F.col("b")))
    out = met.groupBy("window", F.col("a").alias("from_minute"), F.col("b").alias("to_minute")).agg(F.count(label).alias("n"), F.avg(label).alias("mean"))
    return out.withColumn("positive", _yes((F.col("n") >= least) & (F.col("mean") > 0)))


def entry_perturbation(frame: DataFrame, mask: Column, label: str, shift: int = 1) -> DataFrame:
    """(base, shifted): the mean label of the events, and of the bars ``shift`` before them."""
    moved = frame.withColumns({"_on": _yes(mask), "_y": F.lag(label, shift).over(Window.partitionBy("symbol").orderBy("ts"))})
    return moved.where("_on").agg(F.coalesce(F.avg(label), F.lit(0.0)).alias("base"), F.coalesce(F.avg("_y"), F.lit(0.0)).alias("shifted"))


def split_integrity(frame: DataFrame, splits: DataFrame, horizon: str = "15 minutes") -> DataFrame:
    """(status, violations, checked): rows of the train part whose label, ``horizon`` later, lies on a day of a later part.

    ``splits`` is (day, part) with train, validation, test and embargo; it has a row for each day.
    """
    own = splits.select(F.col("day"), F.col("part").alias("own"))
    reached = splits.select(F.col("day").alias("label_day"), F.col("part").alias("reached"))
    dated = frame.select(F.to_date("ts").alias("day"), F.to_date(F.col("ts") + F.expr(f"INTERVAL {horizon}")).alias("label_day"))
    days = dated.groupBy("day", "label_day").agg(F.count(F.lit(1)).alias("n")).join(own, "day", "left").join(reached, "label_day", "left")
    late = _yes((F.col("own") == "train") & F.col("reached").isin("validation", "test"))
    out = days.agg(F.coalesce(F.sum(F.when(late, F.col("n")).otherwise(0)), F.lit(0)).alias("violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("checked"))
    return out.select(F.when(F.col("violations") == 0, "PASS").otherwise("FAIL").alias("status"), "violations", "checked")


# --- gates on data and configuration ---------------------------------------------------------------------------------


def data_ready(sessions: Column, expiries: Column, contracts: Column) -> Column:
    return (sessions >= MIN_SESSIONS) & (expiries >= MIN_EXPIRIES) & (contracts >= MIN_CONTRACTS)


def expiry_guard(carry: Column, exclude_expiry: Column) -> Column:
    """Blocked if positions are carried and expiry days left out."""
    return carry & exclude_expiry


def iv_gate(rank: Column, most: float = 0.3, mode: str = "block") -> tuple[Column, Column]:
    """(insufficient, blocked); a null rank is neither."""
    over = _yes(rank > most)
    return over, over if mode == "block" else F.lit(False)


def scope(contracts: DataFrame, order: str, most: int = MAX_SCOPE) -> DataFrame:
    """The first ``most`` contracts of a scope."""
    return contracts.orderBy(order).limit(most)


def oos_gate(n: Column, least: int = 20) -> Column:
    return F.when(n < max(6, least), "THIN_OOS").otherwise("OOS_OK")


# --- ladders ---------------------------------------------------------------------------------------------------------


def _steps() -> list[tuple[str, Column]]:
    return [
        ("L1_FEATURE_INFORMATION", F.col("FWD_expectancy") > 0),
        ("L2_EVENT_INFORMATION", F.col("events") >= 50),
        ("L3_COMBINATION_INFORMATION", F.lit(True)),
        ("L4_RETURN_PREDICTION", F.col("FWD_IS_expectancy") > 0),
        ("L5_TRADING_RULE", (F.col("IS_expectancy") > 0) & ~F.coalesce("exit_cap_dominated", F.lit(False))),
        ("L6_ROBUSTNESS", F.col("robustness_score") >= 4),
        ("L7_OOS", F.col("OOS_trading_result") == "OOS_TRADING_RULE_PASS"),
        ("L8_EXECUTION", F.col("execution_model") == "EXECUTABLE_PRICE_MODEL"),
    ]


def edge_ladder(candidates: DataFrame) -> DataFrame:
    """``candidates`` with a column for each level (all below it passed too), fails_at and edge_kind."""
    steps = _steps()
    passed = {name: reduce(lambda a, b: a & b, [_yes(s) for _, s in steps[: k + 1]]) for k, (name, _) in enumerate(steps)}
    out = candidates.withColumns(passed)
    at = lambda n: F.col(next(name for name, _ in steps if name.startswith(f"L{n}_")))
    fails = F.coalesce(*[F.when(~F.col(name), name) for name, _ in steps], F.lit("NONE_ALL_PASS"))
    kind = F.when(at(8), "EXECUTABLE_EDGE").when(at(7), "VALIDATED_OOS_EDGE").when(at(6), "ROBUST_EDGE_FOUND").when(at(5), "TRADING_EDGE_FOUND")
    kind = kind.when(at(4), "PREDICTIVE_INFORMATION_ONLY").when(at(1), "PREDICTIVE_INFORMATION_FOUND").otherwise("NO_INFORMATION")
    return out.withColumns({"fails_at": fails, "edge_kind": kind})


def discovery_category() -> Column:
    """How far a candidate got; a discovery is never a strategy by itself."""
    informed = _yes(F.col("FWD_expectancy") > 0)
    predicts = informed & _yes(F.col("FWD_IS_expectancy") > 0)
    trades = predicts & _yes(F.col("IS_expectancy") > 0)
    robust = trades & _yes(F.col("robustness_score") >= 4)
    oos = robust & _yes(F.col("OOS_trading_result") == "OOS_TRADING_RULE_PASS")
    sure = oos & _yes(F.col("mt_pass")) & _yes(F.col("execution_model") == "EXECUTABLE_PRICE_MODEL") & _yes(F.col("paper_eligible"))
    names = [(sure, "VALIDATED_EDGE"), (oos, "OOS_DISCOVERY"), (robust, "ROBUST_DISCOVERY"), (trades, "TRADING_RULE_DISCOVERY"), (predicts, "PREDICTIVE_DISCOVERY"), (informed, "INFORMATION_DISCOVERY")]
    return F.coalesce(*[F.when(c, n) for c, n in names], F.lit("NO_DISCOVERY"))


def oos_stage(expectancy: Column, events: Column, least: int, mt_pass: Column, robust: Column, paper: Column | None = None) -> Column:
    last = F.lit("OOS_MULTIPLE_TEST_PASS") if paper is None else F.when(_yes(paper), "OOS_FINAL_SURVIVOR").otherwise("OOS_MULTIPLE_TEST_PASS")
    thin = F.coalesce(events, F.lit(0)) < least
    return F.when(~_yes(expectancy > 0), "OOS_FAIL").when(thin, "OOS_RAW_POSITIVE").when(~_yes(robust), "OOS_THRESHOLD_PASS").when(~_yes(mt_pass), "OOS_ROBUST_PASS").otherwise(last)


def frontier_bucket(category: Column, unresolved: Column) -> Column:
    open_ = _yes(unresolved.isin("ENTRY_PROMISING_EXIT_UNRESOLVED", "PREDICTIVE_BUT_TRADING_RULE_UNRESOLVED"))
    early = category.isin("TRADING_RULE_DISCOVERY", "PREDICTIVE_DISCOVERY", "INFORMATION_DISCOVERY")
    out = F.when(category == "VALIDATED_EDGE", "VALIDATED_EDGE").when(open_, "PROMISING_ENTRY_EXIT_UNRESOLVED").when(category == "OOS_DISCOVERY", "PROMISING_OOS")
    return out.when(category == "ROBUST_DISCOVERY", "ROBUST_CANDIDATE").when(early, "PROMISING_ENTRY").otherwise("NO_FRONTIER")


def candidate_state(informed: Column, trades: Column, oos: Column, robust: Column, mt: Column, executable: Column, unresolved: Column) -> Column:
    """Research state from the gates' outcomes, the first that fails first."""
    order = [(~_yes(informed), "NO_SIGNAL_FOUND"), (_yes(unresolved), "SIGNAL_FOUND_EXIT_UNRESOLVED"), (~_yes(trades), "NO_SIGNAL_FOUND"), (~_yes(oos), "OOS_FAILED")]
    order += [(~_yes(robust), "ROBUSTNESS_FAILED"), (~_yes(mt), "MULTIPLE_TESTING_FAILED"), (~_yes(executable), "EXECUTION_FAILED")]
    return F.coalesce(*[F.when(c, n) for c, n in order], F.lit("VALIDATED_EDGE"))


def status(events: str = "events", days: str = "days", oos: str = "oos_mean", train: str = "train_mean", p: str = "p_adj", top: str = "top5", gate: str = "oos_gate", capped: str = "capped") -> Column:
    """The weakest dimension names the status."""
    n, d, o, t, q = (F.col(c) for c in (events, days, oos, train, p))
    agree = ((t > 0) & (o > 0)) | ((t < 0) & (o < 0))
    rules = [
        ((n < 50) | (d < 3) | (F.col(gate) == "THIN_OOS"), "THIN_SAMPLE"),
        (o.isNull(), "REJECTED"),
        (o <= 0, "OOS_REJECTED"),
        (~_yes(agree), "REJECTED"),
        (~_yes(q < 0.10), "SURROGATE_REJECTED"),
        (F.col(capped), "CAP_DOMINATED"),
        (F.col(top) >= 0.5, "CONCENTRATED"),
        (d < 5, "THIN_SAMPLE"),
        (q < 0.05, "OOS_SURVIVED"),
    ]
    return F.coalesce(*[F.when(_yes(c), name) for c, name in rules], F.lit("ROBUST"))


def robustness_score(components: DataFrame) -> DataFrame:
    """``components`` (columns of WEIGHTS, 0 to 1, null if untested; param_density) with robustness_score and robustness_coverage.

    Untested parts leave the denominator; weak parts cap the score, a failed OOS or surrogate test most;
    one that is missing only lowers the coverage.
    """
    tested = {k: F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()}
    weight = reduce(lambda a, b: a + b, tested.values())
    points = reduce(lambda a, b: a + b, [F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(k))) * w, F.lit(0.0)) for k, w in WEIGHTS.items()])
    score = F.coalesce(points / F.nullif(weight, F.lit(0.0)) * 10, F.lit(0.0))
    weak = lambda k, x: _yes(F.col(k) < x)
    caps = [
        (weak("param", 0.3) | weak("signal", 0.3) | (F.col("param").isNotNull() & weak("param_density", 0.3)), 6.0),
        (weak("exit", 0.3) | weak("best_event", 0.3), 7.0),
        (_yes(F.col("stats") <= 0) & weak("param", 0.4), 5.0),
        (_yes(F.col("oos") <= 0) | _yes(F.col("stats") <= 0), 3.0),
    ]
    for when, most in caps:
        score = F.when(when, F.least(score, F.lit(most))).otherwise(score)
    return components.withColumns({"robustness_score": F.round(score, 2), "robustness_coverage": F.round(weight / sum(WEIGHTS.values()), 3)})
