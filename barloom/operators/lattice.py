"""Neighbourhoods of parameter configurations on the lattice that their values span.

Every axis is numbered by its distinct values, so neighbours are unit steps of whole numbers: a configuration is exploded to
the places around it and meets what lies there by an equi-join.  No pair of configurations is ever tried that isn't one.

Null scores are configurations without a result: they are no neighbours and have no neighbourhood; repeated configurations
count each.  Axes with a null value put the configuration aside.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio


def coordinates(results: DataFrame, axes: Sequence[str]) -> DataFrame:
    """``results`` with ``at_<axis>``: the place of its value among the axis' distinct values, from 1."""
    out = results
    for axis in axes:
        values = results.select(axis).where(F.col(axis).isNotNull()).distinct()
        places = values.withColumn(f"at_{axis}", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(axis)))
        out = out.join(places, axis)
    return out


def _places(axes: Sequence[str], steps: Sequence[tuple[int, ...]], names: Sequence[str]) -> Column:
    """A row for every step away: its name in ``axis`` and the place it leads to."""
    at = [f"at_{a}" for a in axes]
    return F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), *[(F.col(c) + d).alias(c) for c, d in zip(at, step, strict=True)]) for n, step in zip(names, steps, strict=True)]))


def neighbourhoods(results: DataFrame, axes: Sequence[str], score: str, strong: float = 1.0, reach: int = 1) -> DataFrame:
    """``axes``, score and, over all configurations within ``reach`` steps on every axis (itself among them): neighbours,
    positive_density, strong_density, median, worst, best, deviation, drop (best less median), stability (the score's fall to
    the median, as a share of it) and knife_edge (less than 40 % positive)."""
    placed = coordinates(results.select(*axes, F.col(score).cast("double").alias("_score")), axes).where(F.col("_score").isNotNull())
    at = [f"at_{a}" for a in axes]
    steps = list(product(range(-reach, reach + 1), repeat=len(axes)))
    own = placed.select(*axes, F.col("_score").alias("_own"), *at).distinct()
    there = own.select(*axes, "_own", _places(axes, steps, [""] * len(steps)).alias("_place")).select(*axes, "_own", "_place.*").join(placed.select(*at, "_score"), at)
    s = F.col("_score")
    out = there.groupBy(*axes, "_own").agg(
        F.count(F.lit(1)).alias("neighbours"), F.avg((s > 0).cast("double")).alias("positive_density"), F.avg((s > strong).cast("double")).alias("strong_density"),
        F.expr("median(_score)").alias("median"), F.min(s).alias("worst"), F.max(s).alias("best"), F.stddev_samp(s).alias("deviation"),
    )
    return out.withColumns(
        {"drop": F.col("best") - F.col("median"), "stability": F.coalesce(ratio(F.col("_own") - F.col("median"), F.abs("_own")), F.lit(0.0)), "knife_edge": F.col("positive_density") < 0.4}
    ).withColumnRenamed("_own", score)


def sensitivity(results: DataFrame, axes: Sequence[str], score: str, trades: str, least: int = 30, thin: int = 10, limit: float = 0.5, most: float = 100.0) -> DataFrame:
    """``axes``, score, axes_counted, pss and knife_edge: the mean second difference of the score along the axes, one step
    each way, where both neighbours have ``thin`` trades; null with fewer than ``least`` trades of its own or no such axis.

    Scores beyond ``most`` are cut to it.  Axes and scores are taken once for each configuration, the greatest of repeated ones.
    """
    best = results.groupBy(*axes).agg(F.max(F.struct(F.col(score).cast("double").alias("s"), F.col(trades).cast("long").alias("n"))).alias("r"))
    clamped = F.greatest(F.lit(-most), F.least(F.lit(most), F.col("r.s")))
    placed = coordinates(best.where(F.col("r.s").isNotNull()).select(*axes, F.col("r.s").alias(score), clamped.alias("_s"), F.col("r.n").alias("_n")), axes)
    at = [f"at_{a}" for a in axes]
    names = [axis for axis in axes for _ in range(2)]
    unit = [tuple(sign * (other == axis) for other in axes) for axis in axes for sign in (-1, 1)]
    rows = placed.select(*axes, score, F.col("_s").alias("_own"), F.col("_n").alias("_trades"), _places(axes, unit, names).alias("_place")).select(*axes, score, "_own", "_trades", "_place.*")
    each = rows.join(placed.select(*at, "_s", "_n").where(F.col("_n") >= thin), at, "left")
    by_axis = each.groupBy(*axes, score, "_own", "_trades", "axis").agg(F.count("_s").alias("_k"), F.sum("_s").alias("_sum"))
    curve = F.when((F.col("_k") == 2) & (F.col("_trades") >= least), F.abs(F.col("_sum") - 2 * F.col("_own")))
    return by_axis.withColumn("_c", curve).groupBy(*axes, score).agg(F.count("_c").alias("axes_counted"), F.avg("_c").alias("pss")).withColumn("knife_edge", F.coalesce(F.col("pss") > limit, F.lit(False)))


def demote(board: DataFrame, pss: DataFrame, axes: Sequence[str], limit: float = 0.5) -> DataFrame:
    """``board`` (with ``rank``) ranked anew: configurations with a pss of ``limit`` or more go behind all others."""
    edge = board.join(pss.select(*axes, "pss"), list(axes), "left").withColumn("demoted", F.coalesce(F.col("pss") >= limit, F.lit(False)))
    return edge.withColumn("new_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("demoted", "rank")))
