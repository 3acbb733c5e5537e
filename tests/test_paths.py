"""Mergeable runs and shuffled orders against plain loops; the predicate search against brute force."""

from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from barloom.operators import paths, predicates


def walk(values, capital=None):
    equity, peak, fall, share, under = 0, 0, 0, 0.0, 0
    streak = {-1: 0, 1: 0}
    most = {-1: 0, 1: 0}
    for v in values:
        equity += v
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
        under += equity < peak
        if capital:
            share = min(share, (equity - peak) / (capital + peak) * 100)
        for s in streak:
            streak[s] = streak[s] + 1 if v * s > 0 else 0
            most[s] = max(most[s], streak[s])
    return fall, most[-1] or None, most[1] or None, share, under


def ledger(spark, draw, n=400):
    rows = [(draw.choice("aaab"), k, float(draw.randrange(-5, 6)), "x") for k in range(n)]
    rows += [("up", 1, 1.0, "x"), ("up", 2, 2.0, "x"), ("down", 1, -1.0, "x"), ("down", 2, -2.0, "x"), ("flat", 1, 0.0, "x")]
    return rows, spark.createDataFrame(rows, "cfg string, seq long, ret double, run string")


@pytest.mark.parametrize("run_rows", [1_000_000, 37, 3])
def test_runs_merge_to_the_whole_path(spark, run_rows):
    rows, frame = ledger(spark, random.Random(run_rows))
    got = {r.cfg: r for r in paths.paths(frame, "cfg", "ret", "seq", run_rows).collect()}
    pct = {r.cfg: r for r in paths.capital_drawdown(frame, "cfg", "ret", "seq", 50.0, run_rows).collect()}
    for cfg in {r[0] for r in rows}:
        fall, losses, wins, share, under = walk([r[2] for r in rows if r[0] == cfg], 50.0)
        assert (got[cfg].max_drawdown, got[cfg].max_losses, got[cfg].max_wins) == (fall, losses, wins), cfg
        assert pct[cfg].max_drawdown_pct == pytest.approx(share) and pct[cfg].trades_under == under
    assert paths.paths(frame.limit(0), "cfg", "ret", "seq", run_rows).count() == 0


@pytest.mark.parametrize("run_rows", [1_000_000, 20])
def test_every_shuffled_order_is_its_own_loop(spark, run_rows):
    rows, frame = ledger(spark, random.Random(4), 150)
    got = {(r.cfg, r.rep): (r.max_drawdown, r.max_losses) for r in paths.shuffled(frame, "cfg", "ret", "seq", 6, run_rows, seed=9).collect()}
    for cfg in {r[0] for r in rows}:
        for rep in range(1, 7):
            mine = sorted((hashlib.md5(f"9:{rep}:{r[1]}".encode()).hexdigest(), r[2]) for r in rows if r[0] == cfg)
            assert got[cfg, rep] == walk([v for _, v in mine])[:2]
    told = {r.cfg: r for r in paths.monte_carlo(frame, "cfg", "ret", "seq", 6, run_rows, seed=9).collect()}
    falls = sorted(got["a", rep][0] for rep in range(1, 7))
    assert (told["a"].p5, told["a"].p50, told["a"].worst, told["a"].reps) == (falls[0], falls[3], falls[-1], 6)


def test_shuffled_orders_move_little(spark):
    """A trade of an order costs a few bytes between tasks, whatever the number of runs."""
    frame = spark.range(40_000).selectExpr("concat('key ', id % 3) as cfg", "id as seq", "round(pmod(hash(id), 100000) / 10000 - 4.9, 4) as ret")
    sc = spark.sparkContext
    sc.setJobGroup("moved", "")
    try:
        paths.shuffled(frame, "cfg", "ret", "seq", 20, 4_000).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup("moved") for k in sc.statusTracker().getJobInfo(j).stageIds}
    moved = 0
    for k in stages:
        try:
            moved += sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteBytes()
        except Py4JJavaError:  # a stage that was never started, as its blocks were there
            continue
    assert moved < 24 * 40_000 * 20


def test_shuffled_orders_of_odd_values(spark):
    """Null and non-finite values, null keys and ties, repeated trades, values that are no whole hundredths."""
    rows = [("a", 1, 0.1 + 0.2), ("a", 1, -1 / 3), ("a", None, None), ("a", 2, -2.0), (None, 1, -1.5), (None, 2, 3.25e6), ("inf", 1, float("inf")), ("b", 7, -0.0)]
    frame = spark.createDataFrame(rows, "cfg string, seq long, ret double")
    got = {(r.cfg, r.rep): r for r in paths.shuffled(frame, "cfg", "ret", "seq", 3, 2, seed=9).collect()}
    for cfg in {r[0] for r in rows}:
        for rep in range(1, 4):
            mine = sorted((hashlib.md5(f"9:{rep}:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2] or 0.0) for r in rows if r[0] == cfg)
            fall, losses, wins, _, _ = walk([v for _, v in mine])
            r = got[cfg, rep]
            assert (r.max_losses, r.max_wins, r.n) == (losses, wins, len(mine)), (cfg, rep)
            assert cfg == "inf" or r.max_drawdown == pytest.approx(fall)
    assert paths.shuffled(frame.limit(0), "cfg", "ret", "seq", 3).count() == 0


def test_predicate_search_by_brute_force(spark):
    draw = random.Random(11)
    begin = datetime(2024, 1, 30)
    names = ["p", "q", "r", "s"]
    rows = []
    for symbol in ("A", "B"):
        for k in range(500):
            flags = [draw.random() < 0.5 or None for _ in names[:2]] + [draw.random() < 0.4, draw.random() < 0.02]
            y = None if draw.random() < 0.05 else draw.uniform(-1, 1) + 0.4 * bool(flags[0]) + 0.3 * bool(flags[2])
            rows.append((symbol, begin + timedelta(minutes=k * 20), "train" if k < 250 else "check", y, *flags, "clash"))
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, part string, y double, p boolean, q boolean, r boolean, s boolean, label string")
    found = predicates.search(frame, {n: F.col(n) for n in names}, "y", F.col("part"), least=30, least_clusters=5, gap="40 minutes", stretch="day")
    got = {(tuple(r.names), r.part): (r.n, round(r.mean, 6), r.clusters) for r in found.collect()}

    def brute(combo, part):
        hits = [r for r in rows if r[2] == part and r[3] is not None and all(r[4 + names.index(c)] for c in combo)]
        clusters = sum(k == 0 or hits[k - 1][0] != h[0] or h[1] - hits[k - 1][1] > timedelta(minutes=40) for k, h in enumerate(hits))
        return len(hits), sum(h[3] for h in hits) / len(hits) if hits else 0, clusters

    levels = {d: {c for c, _ in got if len(c) == d} for d in (1, 2, 3)}
    assert levels[1] and ("p",) in levels[1] and ("s",) not in levels[1] and levels[2] and levels[3]
    for (combo, part), (n, mean, clusters) in got.items():
        want = brute(combo, part)
        assert (n, clusters) == (want[0], want[2]) and mean == pytest.approx(want[1], abs=2e-6)
    singles = [c[0] for c in levels[1] if brute(c, "train")[1] > 0 and brute(c, "train")[2] >= 5]
    assert levels[2] == {c for c in combinations([n for n in names if n in singles], 2) if brute(c, "train")[0] >= 30}
    assert predicates.search(frame.limit(0), {"p": F.col("p")}, "y", F.col("part")).count() == 0


@pytest.mark.parametrize("run_rows", [1_000_000, 7])
def test_adjusted_p_values_in_runs(spark, run_rows):
    from barloom.operators import inference

    draw = random.Random(5)
    rows = [(f"h{k}", draw.choice(["f", "g", None]), draw.choice([0.5, 0.01, draw.random() ** 3, draw.random() ** 3, None])) for k in range(150)]
    frame = spark.createDataFrame(rows, "name string, family string, p double").repartition(4)
    for keys in (None, ["family"]):
        got = {r.name: r for r in inference.adjust(frame, keys, run_rows).collect()}
        assert len(got) == len(rows)
        for family in {r[1] for r in rows} if keys else {"all"}:
            mine = sorted((r[2], r[0]) for r in rows if r[2] is not None and (not keys or r[1] == family))
            n, holm = len(mine), 0.0
            for k, (p, name) in enumerate(mine, 1):
                holm = max(holm, min(1.0, p * (n - k + 1)))
                bh = min(1.0, min(q * n / j for j, (q, _) in enumerate(mine, 1) if j >= k))
                assert (got[name].bh, got[name].holm, got[name].bonferroni) == pytest.approx((bh, holm, min(1.0, p * n)))
    assert all(got[r[0]].bh is None for r in rows if r[2] is None)
    assert inference.adjust(frame.limit(0), None, run_rows).count() == 0
