"""Scores and transfer classes by hand-worked cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.operators import scoring


def _score(spark, *row):
    frame = spark.createDataFrame([row], "n long, wins long, e double, loss double, pf double, dd double, sharpe double")
    parts = scoring.score_parts(*[F.col(c) for c in frame.columns])
    return frame.select(*[x.alias(k) for k, x in parts.items()], scoring.composite(parts).alias("composite")).collect()[0].asDict()


def test_parts(spark):
    told = _score(spark, 30, 20, 1.0, 10.0, 3.0, -10.0, 4.0)
    assert told == {"ret": 0.5, "win_exp": 0.8333, "pf": 0.75, "sample": 0.5, "risk": 0.5, "sharpe": 0.5, "composite": pytest.approx(0.6042)}


def test_tiny_samples_and_nulls(spark):
    told = _score(spark, 2, 2, 5.0, 0.0, 99.99, 0.0, 1160.0)
    assert told["sharpe"] == 0.9091 and told["ret"] == 0.0 and told["sample"] == 0.0625
    assert _score(spark, None, None, None, None, None, None, None) == {"ret": 0.0, "win_exp": 0.0, "pf": 0.0, "sample": 0.0, "risk": 1.0, "sharpe": 0.0, "composite": 0.15}


def test_transfer_and_tiers(spark):
    rows = [("RANKABLE", "RANKABLE", 1.0, 2.0), ("RANKABLE", "RANKABLE", 1.0, -2.0), ("RANKABLE", "EXPLORATORY", 1.0, 1.0), ("EXPLORATORY", "RANKABLE", 1.0, 1.0), ("INSUFFICIENT", "INSUFFICIENT", None, None), ("EXPLORATORY", "INSUFFICIENT", 1.0, 1.0), (None, "RANKABLE", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "f string, o string, a double, b double")
    assert [r.t for r in frame.select(scoring.transfer(*[F.col(c) for c in frame.columns]).alias("t")).collect()] == ["TRANSFERRED", "FAILED_TRANSFER", "PARTIALLY_TRANSFERRED", "OPTIONS_ONLY", "INSUFFICIENT_DATA", "FAILED_TRANSFER", "INSUFFICIENT_DATA"]
    n = spark.createDataFrame([(k,) for k in (9, 10, 29, 30, 99, 100, 200)], "n long")
    tier, cap = scoring.sample_gate(F.col("n"))
    told = n.select(tier.alias("t"), cap.alias("c"), scoring.reliability(F.col("n")).alias("r"), scoring.ranked_only(F.lit(1.0), F.col("n")).alias("s")).collect()
    assert [r.c for r in told] == [6, 6, 6, 6, 6, 8, 10] and [r.r for r in told][:4] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert [r.s for r in told][2:4] == [None, 1.0] and told[-1].t == "STRONG_SAMPLE"
