"""Statistics that know how many trials were made: deflated Sharpe, multiple testing, folds, permutation and bootstrap."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths
from .series import ratio

EULER = 0.5772156649015329


def norm_cdf(x: Column) -> Column:
    """Normal distribution function, absolute error below 1e-7 (polynomial of Abramowitz and Stegun, 26.2.17)."""
    # The published coefficients.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on erf; for driver-side constants."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (low, mid)
    return (low + high) / 2


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    """Expected best of ``trials`` Sharpe ratios without skill; 0 below two trials."""
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * normal_quantile(1 - 1 / trials) + EULER * normal_quantile(1 - 1 / (trials * math.e)))


def moments(trades: DataFrame, key: str, value: str) -> DataFrame:
    """n, Sharpe per trade, skewness and raw kurtosis about the sample deviation, in one aggregate."""
    n, part = F.count(value), (F.count(value) - 1) / F.count(value)
    skew, kurt = F.skewness(value) * F.pow(part, 1.5), (F.kurtosis(value) + 3) * F.pow(part, 2.0)
    return trades.groupBy(key).agg(n.alias("n"), ratio(F.avg(value), F.stddev_samp(value)).alias("sr"), skew.alias("skew"), kurt.alias("kurt"))


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: float = 0.0) -> Column:
    spread = F.sqrt(F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12)))
    return norm_cdf((sr - benchmark) * F.sqrt(n - 1) / spread)


def deflated_sharpe(trades: DataFrame, key: str, value: str, trials: int, variance: float) -> DataFrame:
    """Probability that a Sharpe ratio beats the best of ``trials`` without skill."""
    bar = expected_max_sharpe(trials, variance)
    return moments(trades, key, value).withColumn("dsr", probabilistic_sharpe(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurt"), bar))


def _meet(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``few``, which has one row per ``on``; nulls of it meet."""
    renamed = few.select(*[F.col(c).alias(f"_of_{c}") for c in on], *[c for c in few.columns if c not in on])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on])
    return rows.join(renamed, same).drop(*[f"_of_{c}" for c in on])


def adjust(pvalues: DataFrame, keys: list[str] | None = None, run_rows: int = paths.RUN_ROWS) -> DataFrame:
    """``pvalues`` (name, p) with Benjamini-Hochberg, Holm and Bonferroni adjustments, within ``keys`` if given.

    The p-values are cut into runs of about ``run_rows``.  A rank is the place in its run after the counts of the runs before;
    the least later and the greatest earlier term of a step procedure come from the run itself and from one figure of each
    other run, so no window holds all hypotheses.  Hypotheses without a p take no part; their adjustments are null.
    """
    keys = keys or []
    edges = paths.run_edges(pvalues.where("p is not null"), "p", run_rows)
    whole = pvalues.withColumn("_run", F.when(F.col("p").isNotNull(), paths.run_of(F.col("p"), edges)).otherwise(-1))
    tested = whole.where("_run >= 0")
    group = [*keys, "_run"]
    over_runs = Window.partitionBy(*(keys or [F.lit(0)]))  # one row per run
    before = over_runs.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    after = over_runs.orderBy("_run").rowsBetween(1, Window.unboundedFollowing)
    counts = tested.groupBy(*group).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.select(*group, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"), F.sum("_c").over(over_runs).alias("_n"))
    inside = Window.partitionBy(*group).orderBy("p", "name")
    ranked = tested.withColumn("_at", F.row_number().over(inside))
    ranked = _meet(ranked, counts, group)
    k, n, p = F.col("_offset") + F.col("_at"), F.col("_n"), F.col("p")
    ranked = ranked.withColumns({"_bh": p * n / k, "_holm": F.least(F.lit(1.0), p * (n - k + 1))})
    ends = ranked.groupBy(*group).agg(F.min("_bh").alias("_low"), F.max("_holm").alias("_high"))
    ends = ends.select(*group, F.min("_low").over(after).alias("_later"), F.max("_high").over(before).alias("_earlier"))
    bh = F.least(F.lit(1.0), F.min("_bh").over(inside.rowsBetween(0, Window.unboundedFollowing)), F.col("_later"))
    holm = F.greatest(F.max("_holm").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    none = [F.lit(None).cast("double").alias(c) for c in ("bh", "holm", "bonferroni")]
    out = _meet(ranked, ends, group).select(*pvalues.columns, bh.alias("bh"), holm.alias("holm"), F.least(F.lit(1.0), p * n).alias("bonferroni"))
    return out.unionByName(whole.where("_run < 0").select(*pvalues.columns, *none))


def splits(days: DataFrame, fractions: tuple[float, float, float] = (0.5, 0.2, 0.3), embargo: int = 1) -> DataFrame:
    """Days as train, validation, test in order; the first ``embargo`` days of a later part belong to none.

    ``days`` (day) has one row per day, so its one window is small.
    """
    w = Window.orderBy("day")
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    at = F.row_number().over(w) - 1
    a, b = F.floor(n * fractions[0]), F.floor(n * (fractions[0] + fractions[1]))
    part = F.when(at < a, "train").when(at < a + embargo, "embargo").when(at < b, "validation").when(at < b + embargo, "embargo").otherwise("test")
    return days.select("day", part.alias("part"))


def purged_folds(days: DataFrame, folds: int = 4, purge: int = 1, embargo: int = 1) -> DataFrame:
    """Anchored folds: (fold, day, role); a fold trains on all days before its test but the purged ones."""
    w = Window.orderBy("day")
    numbered = days.select("day", (F.row_number().over(w) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    width = F.floor(F.col("n") / (folds + 1))
    each = numbered.select("day", "at", width.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    start, stop = F.col("fold") * F.col("w"), (F.col("fold") + 1) * F.col("w")
    role = F.when(F.col("at") < start - purge, "train").when((F.col("at") >= start + embargo) & (F.col("at") < stop), "test")
    return each.withColumn("role", role).where("role is not null").select("fold", "day", "role")


def walk_forward(days: DataFrame, train: int = 8, test: int = 3) -> DataFrame:
    """Rolling folds of ``train`` days followed by ``test`` days: (fold, day, role)."""
    w = Window.orderBy("day")
    numbered = days.select("day", (F.row_number().over(w) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    fold = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - train - test) / test), F.lit(-1)).cast("int"), F.lit(1)))
    each = numbered.where(F.col("n") >= train + test).select("day", "at", fold.alias("fold"))
    inside = F.col("at") - F.col("fold") * test
    return each.where((inside >= 0) & (inside < train + test)).select("fold", "day", F.when(inside < train, "train").otherwise("test").alias("role"))


def permutation_null(events: DataFrame, n_perm: int = 200, seed: int = 7) -> DataFrame:
    """p per ``name``: the event mask is rolled inside its blocks, all permutations in one job.

    ``events`` has name, block, label, event (boolean) and pos (0-based place in the block).  p = (1 + hits) / (1 + n).
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("name", "block"))
    sized = events.withColumn("size", size)
    hits = sized.where("event").select("name", "block", "pos", "size", F.explode(F.sequence(F.lit(0), F.lit(n_perm))).alias("perm"))
    shift = F.when(F.col("perm") == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(seed), "perm", "block"), F.col("size")))
    moved = hits.select("name", "block", "perm", F.pmod(F.col("pos") + shift, F.col("size")).alias("pos"))
    got = moved.join(sized.select("name", "block", "pos", "label"), ["name", "block", "pos"]).groupBy("name", "perm").agg(F.avg("label").alias("mean"))
    seen = got.where("perm = 0").select("name", F.col("mean").alias("observed"))
    both = got.where("perm > 0").join(seen, "name")
    return both.groupBy("name").agg(F.max("observed").alias("observed"), ((1 + F.count_if(F.abs("mean") >= F.abs("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))


def bootstrap_ci(trades: DataFrame, key: str, value: str, reps: int = 200, block: int = 10, alpha: float = 0.05, seed: int = 3) -> DataFrame:
    """Percentile interval of the mean by circular blocks: per ``key`` (low, high), one group a task, repetitions inside.

    Blocks of ``block`` neighbours are drawn after the values have been summed by block, so a group holds sums only.
    """
    numbered = trades.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1)
    sums = numbered.groupBy(key, F.floor(F.col("_k") / block).alias("b")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("b")
        rng = np.random.default_rng([seed, *str(frame[key].iloc[0]).encode()])
        s, n = frame["s"].to_numpy(float), frame["n"].to_numpy(float)
        means = [s[pick].sum() / n[pick].sum() for pick in (rng.integers(0, len(s), len(s)) for _ in range(reps))]
        low, high = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({key: [frame[key].iloc[0]], "low": [low], "high": [high]})

    return sums.groupBy(key).applyInPandas(run, f"{key} string, low double, high double")


def information_coefficient(frame: DataFrame, features: list[str], label: str, key: str) -> DataFrame:
    """Pearson correlation of each feature with the label, over all rows and per ``key``, kept long."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    long = frame.select(key, F.col(label).alias("y"), each.alias("v")).select(key, "y", "v.*").where("x is not null and y is not null")
    return long.groupingSets([["feature", key], ["feature"]], "feature", key).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("ic"))


def hypotheses(frame: DataFrame, masks: dict[str, Column], label: str, part: Column) -> DataFrame:
    """All hypotheses of a round in one pass: per name and part n, mean label, win rate."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(m, F.lit(False)).alias("on")) for n, m in masks.items()]))
    long = frame.where(F.col(label).isNotNull()).select(part.alias("part"), F.col(label).alias("y"), each.alias("h")).where("h.on").select("h.name", "part", "y")
    return long.groupBy("name", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.avg((F.col("y") > 0).cast("double")).alias("win_rate"))


# --- recipes ---------------------------------------------------------------------------------------------------------


def compile_recipe(recipe: dict) -> Column:
    """A portable predicate as a Column: kinds atomic, scope, selector, combo (AND of parent and leg)."""
    kind = recipe.get("kind")
    if kind == "combo":
        return compile_recipe(recipe["parent"]) & compile_recipe(recipe["leg"])
    tests = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v}
    if kind not in ("atomic", "scope", "selector") or recipe.get("op") not in tests:
        raise ValueError(f"not a recipe: {recipe}")
    return F.coalesce(tests[recipe["op"]](F.col(recipe["col"]), F.lit(recipe["val"])), F.lit(False))


# --- grids -----------------------------------------------------------------------------------------------------------


def grid(spark, dims: dict[str, list]) -> DataFrame:
    """Every combination of the dimensions' values, with a key; one explode per dimension."""
    out = spark.range(1).select()
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.withColumn("cfg", F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in dims]))


def halton(n: int, dims: int) -> list[tuple[float, ...]]:
    """Low-discrepancy points in the unit cube."""
    primes = (2, 3, 5, 7, 11, 13, 17, 19)[:dims]

    def place(i: int, base: int) -> float:
        out, f = 0.0, 1.0
        while i:
            f /= base
            out += f * (i % base)
            i //= base
        return out

    return [tuple(place(i, b) for b in primes) for i in range(1, n + 1)]
