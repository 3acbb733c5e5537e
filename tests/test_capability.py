"""Reports on what a chain supports: empty chains, missing columns, unknown identities, ties and masks without rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import capability as cap

SCHEMA = "ts timestamp_ntz, symbol string, expiry string, strike double, option_type string, close double, volume double, oi double, bid double"


def at(minute):
    return dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=minute)


def row(minute, symbol, strike=100.0, kind="CE", close=1.0, volume=1.0, oi=None, bid=None, expiry="E1"):
    return (at(minute), symbol, expiry, strike, kind, close, volume, oi, bid)


@pytest.fixture(scope="module")
def chain(spark):
    rows = [row(0, "A"), row(0, "B", 200.0, "PE"), row(1, "A"), row(1, "A"), row(1, "B", 200.0, "PE", None), row(2, "A", bid=0.5), row(90, "B", 200.0, "PE", float("nan")), row(91, "C", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_facts(chain):
    told = cap.chain_facts(chain).collect()[0].asDict()
    assert told == {
        "n_contracts": 3, "n_expiries": 1, "n_strikes": 2, "n_option_types": 2, "snapshots": 5, "whole_snapshots": 0, "n_days": 1, "missing_closes": 3,
        "repeated_rows": 1, "first_ts": at(0), "last_ts": at(91), "has_bidask": True, "has_oi": False, "completeness": 0.0,
    }
    assert cap.chain_facts(chain.where("symbol <> 'C'")).collect()[0]["completeness"] == 0.5


def test_empty(spark, chain):
    empty = chain.limit(0)
    facts = cap.chain_facts(empty)
    assert facts.select("n_contracts", "snapshots", "completeness", "has_bidask").collect() == [(0, 0, 0.0, False)]
    assert {r.status for r in cap.modules(facts).collect()} == {"UNAVAILABLE"}
    for made in (cap.universe(empty), cap.priority(empty), cap.capability_map(empty, "expiry"), cap.temporal_coverage(empty, "expiry")):
        assert made.count() == 0
    masks = cap.horizon_eligibility(empty.withColumn("fwd_ret_1", F.lit(1.0)), {"all": F.lit(True)}, (1, 3))
    assert sorted((r.span, r.status, r.marked, r.events) for r in masks.collect()) == [(1, "INSUFFICIENT", 0, 0), (3, "UNAVAILABLE", 0, 0)]


def test_modules_and_reasons(chain):
    told = {r.module: (r.status, r.reason) for r in cap.modules(cap.chain_facts(chain), 3, 2).collect()}
    assert told["RAW_PRICE"] == ("AVAILABLE", "") and told["STRIKE_RELATIONSHIP"] == ("AVAILABLE", "")
    assert told["OPTION_DATA"] == ("UNAVAILABLE", "no identifiable contracts/timestamps/prices")
    assert told["EXPIRY_RELATIONSHIP"] == ("UNAVAILABLE", "only 1 expir(ies)") and told["OOS_VALIDATION"][1] == "only 1 day(s); VALIDATION_INSUFFICIENT_DATA"


def test_universe_keeps_all_but_the_unquoted(spark, chain):
    told = {r.symbol: (r.rows, r.closes, r.searchable) for r in cap.universe(chain).collect()}
    assert told == {"A": (4, 4, True), "B": (3, 1, True), "C": (1, 0, False)}
    named = spark.createDataFrame([row(0, "UNKNOWN"), row(0, None), row(0, "X")], SCHEMA)
    assert sorted(r.searchable for r in cap.universe(named).collect()) == [False, False, True]


def test_priority(spark, chain):
    told = {r.symbol: (r.strike_rank, r.first) for r in cap.priority(chain, 1).collect()}
    assert told == {"A": (1, True), "B": (2, False), "C": (None, False)}
    flat = spark.createDataFrame([row(0, s, None, volume=v) for s, v in (("A", 1.0), ("B", 3.0), ("C", 2.0))], SCHEMA)
    assert {r.symbol: r.first for r in cap.priority(flat, 1).collect()} == {"A": False, "B": True, "C": True}
    tie = spark.createDataFrame([row(0, "A", 200.0), row(0, "B", 100.0)], SCHEMA)
    assert {r.symbol: r.strike_rank for r in cap.priority(tie, 1).collect()} == {"A": 2, "B": 1}


def test_capability_map(spark, chain):
    told = {r.capability: r.status for r in cap.capability_map(chain, "expiry", 2).collect()}
    assert told["identity:strike"] == "PARTIAL" and told["identity:symbol"] == "AVAILABLE"
    assert told["field:close"] == "PARTIAL" and told["field:oi"] == "INSUFFICIENT" and told["field:ask"] == "UNAVAILABLE"
    assert told["overlap:cross_contract"] == told["overlap:cepe"] == "AVAILABLE" and told["overlap:cross_expiry"] == "UNAVAILABLE"
    one = {r.capability: r.status for r in cap.capability_map(chain.where("ts < '2024-01-01 09:01:00'"), "expiry", 2).collect()}
    assert one["overlap:cepe"] == "PARTIAL"
    nulls = cap.capability_map(spark.createDataFrame([row(0, "A", expiry=None), row(0, "B", expiry="E")], SCHEMA), "expiry")
    assert nulls.select("expiry").distinct().count() == 2


def test_temporal(chain):
    r = cap.temporal_coverage(chain, "expiry").collect()[0]
    assert (r.rows, r.contracts, r.days, r.gaps, r.median_rows, r.least_rows, r.most_rows) == (8, 3, 1, 1, 3.0, 1, 4)


def test_horizons(spark):
    f = spark.createDataFrame([(1.0, 1.0), (2.0, None), (-3.0, float("nan")), (None, 5.0)], "x double, fwd_ret_1 double")
    told = {(r["name"], r["span"]): r for r in cap.horizon_eligibility(f, {"any": F.col("x").isNotNull(), "up": F.col("x") > 0, "none": F.col("x") > 9}, (1, 5), 1).collect()}
    assert told["any", 1][2:6] == ("AVAILABLE", 3, 1, pytest.approx(1 / 3)) and told["up", 1]["coverage"] == 0.5
    assert told["none", 1][2:6] == ("INSUFFICIENT", 0, 0, 0.0) and told["up", 5]["status"] == "UNAVAILABLE"


def test_tracks(spark):
    own = ["e_large_ret", "seq2"]
    f = spark.createDataFrame([("EVENT", ["seq2"]), ("EVENT", ["breadth"]), ("SCOPE_SIDE", ["strike"]), ("SEL_VOL_RANK", ["sel_vol_rank"]), ("LEAD_LAG", ["seq2"]), (None, ["seq2"])], "family string, cols array<string>")
    told = f.select(cap.spec_track(F.col("family"), F.col("cols"), ["EVENT"], own).alias("t"), cap.child_track(F.lit("A"), F.col("cols"), own).alias("c"), cap.allows(F.lit("A"), F.col("cols"), own).alias("a")).collect()
    assert [r.t for r in told] == ["A", "B", "BOTH", "BOTH", "B", "B"]
    assert [r.c for r in told] == ["A", "B", "B", "B", "A", "A"] and [r.a for r in told] == [True, False, True, True, True, True]
    assert f.select(cap.child_track(F.lit("B"), F.col("cols"), own).alias("c")).distinct().collect() == [("B",)]
    assert f.select(F.min(cap.allows(F.lit("B"), F.col("cols"), own)).alias("a")).collect() == [(True,)]
