"""Neighbourhoods, sensitivity and demotion by brute force; metrics on capital and state buckets against plain code."""

from __future__ import annotations

import random
import statistics
from datetime import date, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from barloom.operators import lattice, paths, states

AXES = ("fast", "slow", "kind")


@pytest.fixture(scope="module")
def results(spark):
    draw = random.Random(6)
    rows = [(f, s, k, round(draw.uniform(-1, 2), 3), draw.randrange(5, 90), "clash") for f, s, k in product((5, 8, 13, 21), (1.0, 2.5, 9.0), "xy") if draw.random() < 0.85]
    rows.append((99, 1.0, "x", None, 50, "clash"))
    return rows, spark.createDataFrame(rows, "fast int, slow double, kind string, score double, trades long, median string").repartition(4)


def placed(rows):
    rows = [r for r in rows if r[3] is not None or True]
    values = [sorted({r[k] for r in rows}) for k in range(3)]
    return {tuple(values[k].index(r[k]) for k in range(3)): r for r in rows}


def test_neighbourhoods(results):
    rows, frame = results
    at = placed(rows)
    got = {(r.fast, r.slow, r.kind): r for r in lattice.neighbourhoods(frame, AXES, "score").collect()}
    assert len(got) == len(rows) - 1
    for place, r in at.items():
        if r[3] is None:
            continue
        near = [at[p][3] for d in product((-1, 0, 1), repeat=3) if (p := tuple(a + b for a, b in zip(place, d, strict=True))) in at and at[p][3] is not None]
        x = got[r[:3]]
        assert (x.neighbours, x.worst, x.best) == (len(near), min(near), max(near))
        assert x.median == pytest.approx(statistics.median(near)) and x.positive_density == pytest.approx(sum(s > 0 for s in near) / len(near))
        assert x.knife_edge == (x.positive_density < 0.4) and x.drop == pytest.approx(max(near) - x.median)
    assert lattice.neighbourhoods(frame.limit(0), AXES, "score").count() == 0


def test_sensitivity_and_demotion(results):
    rows, frame = results
    at = placed([r for r in rows if r[3] is not None])
    found = lattice.sensitivity(frame, AXES, "score", "trades")
    got = {(r.fast, r.slow, r.kind): r for r in found.collect()}
    for place, r in at.items():
        curves = []
        for k in range(3):
            ends = [at.get(tuple(a + d * (j == k) for j, a in enumerate(place))) for d in (-1, 1)]
            if r[4] >= 30 and all(e is not None and e[4] >= 10 for e in ends):
                curves.append(abs(ends[0][3] + ends[1][3] - 2 * r[3]))
        x = got[r[:3]]
        assert x.axes_counted == len(curves) and (x.pss is None if not curves else x.pss == pytest.approx(sum(curves) / len(curves)))
    board = frame.where("score is not null").select(*AXES, "score").withColumn("rank", F.expr("row_number() over (order by score desc, fast, slow, kind)"))
    out = lattice.demote(board, found, AXES).orderBy("new_rank").collect()
    assert [r.new_rank for r in out] == list(range(1, len(out) + 1))
    assert [(r.demoted, r["rank"]) for r in out] == sorted((r.demoted, r["rank"]) for r in out) and any(r.demoted for r in out)


def test_capital_metrics(spark):
    draw = random.Random(2)
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(40)]
    rows = [("a", k, draw.choice(days[:30]), draw.uniform(-8, 9)) for k in range(70)] + [("won", k, days[k], 5.0) for k in range(3)]
    trades = spark.createDataFrame(rows, "cfg string, seq long, day date, ret double")
    calendar = spark.createDataFrame([(d,) for d in days], "day date")
    got = {r.cfg: r for r in paths.capital_metrics(trades, calendar, "cfg", "ret", "seq", "day", 100.0, run_rows=9).collect()}
    for cfg in ("a", "won"):
        mine = [r for r in rows if r[0] == cfg]
        daily = [sum(r[3] for r in mine if r[2] == d) / 100 for d in days]
        x = got[cfg]
        assert x.net == pytest.approx(sum(r[3] for r in mine)) and x.days == 40 and x.final_capital == pytest.approx(100 + x.net)
        assert x.sharpe == pytest.approx(statistics.mean(daily) / statistics.stdev(daily) * 252**0.5)
        down = [d for d in daily if d < 0]
        assert x.sortino == pytest.approx(statistics.mean(daily) / statistics.stdev(down) * 252**0.5 if len(down) > 1 else 99.99)
    assert got["won"].profit_factor == 99.99 and got["won"].max_drawdown_pct == 0


def test_state_buckets_within_the_rank_error(spark):
    draw = random.Random(7)
    rows = [(draw.choice(["A", "A", "A", "B"]), k, draw.choice([None, draw.gauss(0, 1), draw.gauss(0, 1)]), draw.uniform(0, 100)) for k in range(3000)] + [("C", 1, None, None)]
    frame = spark.createDataFrame(rows, "symbol string, k long, x double, volume_percentile double")
    exact = {(r.symbol, r.k): r for r in states.states(frame, "x").collect()}
    assert len(exact) == len(rows)
    for symbol in "AB":
        values = sorted(r[2] for r in rows if r[0] == symbol and r[2] is not None)
        edges = [values[min(len(values) - 1, p * len(values) // 5)] for p in (1, 2, 3, 4)]
        for s, k, x, v in rows:
            if s == symbol:
                want = "na" if x is None else states.REGIMES[sum(x > e for e in edges)]
                assert exact[s, k].b_vol_regime == want and exact[s, k].b_vol == next((n for e, n in states.VOLUMES if v <= e), "shock")
    rough = states.quantile_edges(frame, "symbol", "x", [0.5], accuracy=50).where("symbol = 'A'").first().edges[0]
    values = sorted(r[2] for r in rows if r[0] == "A" and r[2] is not None)
    assert abs(values.index(rough) - len(values) // 2) <= len(values) / 50 + 1
    assert exact["C", 1].state_id == "na/single/na"
