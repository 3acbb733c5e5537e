"""Audits find what they are for: a planted look-ahead, wrong ranks, bad trades."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import audits, relations, series
from barloom.sources.tables import bars, chain


@pytest.fixture(scope="module")
def few(spark, small):
    return bars(spark, small).where("ts < timestamp_ntz'2024-01-09 00:00:00'").persist()


def test_lookahead_is_found(few):
    whole = Window.partitionBy("symbol")

    def compute(frame):
        told = series.labels(series.returns(frame), (1,))
        return told.withColumn("against_max", F.col("close") / F.max("close").over(whole)).withColumn("so_far", F.col("close") / F.max("close").over(series.series().rowsBetween(Window.unboundedPreceding, 0)))

    cut = F.expr("hour(ts) % 7 = 3")
    got = {r.feature: r for r in audits.lookahead(few, compute, ["return_1", "return_15", "fwd_ret_1", "against_max", "so_far"], cut).collect()}
    sampled = few.where(cut).count()
    assert got["so_far"].checked == sampled and got["so_far"].deviations == got["return_1"].deviations == got["return_15"].deviations == 0
    assert got["fwd_ret_1"].deviations > 0.9 * got["fwd_ret_1"].checked > 0 and got["against_max"].deviations > 0
    bounded = {r.feature: r for r in audits.lookahead(few, compute, ["return_1", "so_far"], cut, days=1).collect()}
    assert bounded["return_1"].deviations == 0 and bounded["so_far"].deviations > 0
    assert audits.lookahead(few.limit(0), compute, ["return_1"], cut).count() == 0


def test_selector_ranks(spark, small):
    c = chain(spark, small).drop("symbol").withColumn("symbol", F.concat_ws("/", F.col("strike").cast("int"), "option_type"))
    ranked = relations.momentum_rank(relations.volume_rank(c)).persist()
    cut = F.expr("day(ts) = 17")
    fine = audits.selectors(c, ranked, cut).agg(F.sum("contracts"), F.sum("volume_mismatches"), F.sum("momentum_mismatches")).first()
    assert fine[0] > 50 and fine[1] == fine[2] == 0
    ahead = ranked.withColumn("volume_rank", F.lead("volume_rank").over(Window.partitionBy("symbol").orderBy("ts")))
    assert audits.selectors(c, ahead, cut).agg(F.sum("volume_mismatches")).first()[0] > 0


def test_ledgers(spark):
    t = datetime(2024, 1, 1)
    universe = spark.createDataFrame([("A", t, 10.0), ("B", t, 5.0)], "symbol string, ts timestamp_ntz, close double")
    good = [("A", t, t + timedelta(hours=1), 10.0), ("B", t, t + timedelta(hours=2), 5.0)]
    bad = [("C", t, t + timedelta(hours=1), 1.0), (None, t, t + timedelta(hours=1), 1.0), ("A", t, t, 10.0), ("A", t, None, 10.0), ("A", t, t + timedelta(hours=1), 9.0)]
    of = lambda rows: tuple(audits.ledger(spark.createDataFrame(rows, "symbol string, entry_ts timestamp_ntz, exit_ts timestamp_ntz, entry_price double"), universe).first())
    assert of(good) == (2, 0, 0, 0, 0, "PASS")
    assert of(good + bad) == (7, 1, 2, 1, 1, "FAIL")
    assert of(good)[0] == 2 and of([])[0] == 0 and of([])[-1] == "PASS"
    nets = spark.createDataFrame([(1.5,), (None,), (-0.5,)], "net double")
    assert audits.pool_sum(nets, nets, "net").first().status == "PASS"
    assert audits.pool_sum(nets, nets.where("net > 0"), "net").first().status == "FAIL"
