"""State buckets of contracts by quantiles of their own history.

The quantiles come from sketches that merge: each task sketches its rows of a contract, Spark merges the sketches, and the
few edges go back to the rows, which are dealt to parts so that a contract with a third of all rows is no single task.  A
sketch of ``accuracy`` a places an edge at most n / a ranks beside the value at place floor(p * n), counted from 0, of the n
sorted values.  These are quantiles of the whole history: buckets describe, they must not trade.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: parts that the rows of one contract are dealt to
PARTS = 32

# Bucket names and their edges
REGIMES = ("vlow", "low", "mid", "high", "vhigh")
VOLUMES = ((25, "low_vol"), (50, "midlow"), (75, "midhigh"), (95, "high_vol"))


def quantile_edges(frame: DataFrame, key: str, value: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(key, edges): one merged sketch per key; null values are left out, a key without values has null edges."""
    just_over = ", ".join(f"{p!r}D + 1e-9D" for p in shares)
    return frame.groupBy(key).agg(F.expr(f"percentile_approx({value}, array({just_over}), {accuracy})").alias("edges"))


def bucketed(frame: DataFrame, key: str, value: str, into: str, names: Sequence[str] = REGIMES, accuracy: int = 10_000) -> DataFrame:
    """``frame`` with the name of the quantile bucket of ``value`` among its key's values; null is 'na'.

    A value on an edge is in the lower bucket.
    """
    n = len(names)
    edges = quantile_edges(frame, key, value, [k / n for k in range(1, n)], accuracy).withColumnRenamed(key, "_key")
    edges = edges.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = frame.withColumn("_part", F.pmod(F.xxhash64(*frame.columns), F.lit(PARTS)).cast("int"))
    joined = dealt.join(edges, (F.col(key).eqNullSafe(F.col("_key"))) & (dealt["_part"] == edges["_part"]), "left").drop(edges["_part"])
    name = F.when(F.col(value).isNull(), "na")
    for k in range(n - 1):
        name = name.when(F.col(value) <= F.col("edges")[k], names[k])
    return joined.withColumn(into, name.otherwise(names[-1])).drop("_part", "_key", "edges")


def volume_bucket(percentile: Column) -> Column:
    name = F.when(percentile.isNull(), "na")
    for edge, of in VOLUMES:
        name = name.when(percentile <= edge, of)
    return name.otherwise("shock")


def dominance(spread: Column, first: str, second: str) -> Column:
    """Which of two option types leads, by the spread of their returns; 'single' without a partner."""
    return (
        F.when(spread.isNull(), "single").when(spread < -1, f"{second}_dom").when(spread < -0.2, f"{second}_weak").when(spread <= 0.2, "balanced").when(spread <= 1, f"{first}_weak").otherwise(f"{first}_dom")
    )


def states(frame: DataFrame, value: str, spread: str | None = None, percentile: str = "volume_percentile", types: tuple[str, str] = ("CE", "PE"), accuracy: int = 10_000) -> DataFrame:
    """``frame`` (symbol, ...) with b_vol_regime, b_type_dom, b_vol and state_id, the three joined by '/'."""
    out = bucketed(frame, "symbol", value, "b_vol_regime", accuracy=accuracy)
    lead = F.lit("single") if spread is None else dominance(F.col(spread), *types)
    out = out.withColumns({"b_type_dom": lead, "b_vol": volume_bucket(F.col(percentile))})
    return out.withColumn("state_id", F.concat_ws("/", "b_vol_regime", "b_type_dom", "b_vol"))
