"""Gap zones: a replayed stream, also across a restart, gives what the batch gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from barloom.operators.indicators import gap_bias_of
from barloom.streaming import zones


def walk(symbol, n, seed):
    draw, now, rows = random.Random(seed), 100.0, []
    for k in range(n):
        now += draw.uniform(-3, 3)
        rows.append((symbol, datetime(2024, 1, 1) + timedelta(minutes=k), now + draw.uniform(0.1, 2), now - draw.uniform(0.1, 2), now))
    return rows


def test_advance_is_the_batch_rule():
    for seed in range(5):
        rows = walk("A", 300, seed)
        live, got = [], []
        for k, r in enumerate(rows):
            live, bias = zones.advance(live, k, None if k < 2 else rows[k - 2][2:4], r[2:5], 4, 20)
            got.append(bias)
        h, low, c = (np.array([r[j] for r in rows]) for j in (2, 3, 4))
        assert got == gap_bias_of(h, low, c, 4, 20).astype(int).tolist() and any(got)


def test_stream_with_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", zones.ROCKS)
    rows = walk("A", 120, 1) + walk("B", 80, 2)
    schema = "symbol string, ts timestamp, high double, low double, close double"
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check"

    def put(part, extra=()):
        spark.createDataFrame([*part, *extra], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = zones.gap_biases(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)

    put([r for k, r in enumerate(rows) if k % 200 < 50 or k >= 150])
    put([r for k, r in enumerate(rows) if 50 <= k < 120], extra=rows[:3])  # late bars again are dropped
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.symbol, r.ts): r.bias for r in spark.read.parquet(out).collect()}
    used = {"A": rows[:120], "B": rows[150:]}
    assert len(got) == 120 + 50
    for symbol, mine in used.items():
        h, low, c = (np.array([r[j] for r in mine]) for j in (2, 3, 4))
        assert [got[symbol, r[1]] for r in mine] == gap_bias_of(h, low, c).astype(int).tolist()
