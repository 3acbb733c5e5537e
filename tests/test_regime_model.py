"""Softmax training, session inputs and routing against plain loops."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import regime_model as reg


def loop(x, y, classes, scaled, iterations, rate, decay):
    x = x.copy()
    mean, sd = x[:, :scaled].mean(0), x[:, :scaled].std(0)
    x[:, :scaled] = (x[:, :scaled] - mean) / np.where(sd > 0, sd, 1)
    w = np.zeros((classes, x.shape[1]))
    for _ in range(iterations):
        g = np.zeros_like(w)
        for row, label in zip(x, y, strict=True):
            s = w @ row
            share = np.exp(s - s.max())
            share /= share.sum()
            for c in range(classes):
                g[c] += (share[c] - (c == label)) * row / len(x)
        w -= rate * (g + decay * w)
    return w, x


def test_softmax_is_the_plain_loop(spark):
    draw = np.random.default_rng(2)
    x = np.column_stack([draw.normal(5, 30, 90), draw.normal(0, 0.01, 90), np.full(90, 7.0), np.ones(90)])
    y = (x[:, 0] > 5).astype(int) + (x[:, 1] > 0)
    rows = [(*map(float, r), int(k), 1) for r, k in zip(x, y, strict=True)] + [(1.0, 1.0, 1.0, 1.0, None, 1)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, bias double, label int, x int").repartition(5)
    model = reg.train_softmax(frame, ["a", "b", "c", "bias"], "label", iterations=12)
    want, scaled = loop(x, y, 4, 3, 12, 0.5, 0.001)
    np.testing.assert_allclose(model.weights, want, atol=1e-9)
    told = model.predict(frame.where("label is not null")).collect()
    by_row = {(r.a, r.b): (r.predicted, r.confidence) for r in told}
    for raw, row in zip(x, scaled, strict=True):
        s = want @ row
        got = by_row[raw[0], raw[1]]
        assert got[0] == int(np.argmax(s)) and got[1] == pytest.approx(1 / np.exp(s - s.max()).sum())
    empty = reg.train_softmax(frame.limit(0), ["a", "b", "c", "bias"], "label", iterations=2)
    assert not empty.weights.any()


def test_targets_and_labels_break_ties(spark):
    rows = [("A", date(2024, 1, 1) + timedelta(days=k), r) for k, r in enumerate([0, 3, 3, 0, 1, 2, 2, 1])]
    frame = spark.createDataFrame(rows, "symbol string, d date, regime int").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    got = [r.target for r in reg.regime_targets(frame, 4).orderBy("ts").collect()]
    assert got == [0, 3, 0, 2, 1, 2, 1, 1]
    hours = frame.withColumn("ts", F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, datediff(d, date'2024-01-01'), 0, 0)"))
    of = lambda *regimes: reg.day_rule_labels(hours.where(F.col("regime").isin(*regimes))).first().label
    assert (of(0, 3), of(0, 1), of(1, 2), of(0)) == (3, 0, 1, 0)


def test_day_inputs_know_the_session_before_only(spark):
    draw = random.Random(1)
    rows = [("A", date(2024, 1, 1) + timedelta(days=k), draw.randrange(4), *[draw.random() for _ in range(8)]) for k in range(6)]
    frame = spark.createDataFrame(rows, "symbol string, day date, label int, " + ", ".join(f"d{k} double" for k in range(8)))
    out = reg.day_inputs(frame.drop("label"), frame.select("symbol", "day", "label")).orderBy("day").collect()
    for i, r in enumerate(out):
        assert [r[f"d{k}"] for k in range(8)] == ([None] * 8 if i == 0 else list(rows[i - 1][3:]))
        assert [r[f"was_{c}"] for c in range(4)] == [float(i >= 2 and rows[i - 1][2] == c) for c in range(4)]
        assert (r.label, r.session, r.bias) == (rows[i][2], i + 1, 1.0)


def test_routing_falls_back_openly(spark, small):
    from barloom.sources.tables import bars

    b = bars(spark, small)
    days = reg.day_routing(b, "ml", gate=2.0, iterations=1)
    assert days.where("not fallback").count() == 0
    assert reg.day_mask(b, days, "EMA").where("not trade or not fallback").count() == 0
    ruled = reg.day_routing(b, least=10_000)
    assert ruled.where("not fallback").count() == 0
    with pytest.raises(ValueError):
        reg.day_routing(b, "guess")
