"""Ledgers cut into runs give what one pass over each key gives, wherever the cuts fall."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import premium, series, trading

CUTS = (7, 10**6)


@pytest.fixture(scope="module")
def ledger():
    """One key holds most rows, one has a single trade, one is null; many trades tie in size and in order."""
    rng = np.random.default_rng(5)
    rows = [("hot", int(k), float(v)) for k, v in zip(rng.integers(0, 150, 200), rng.integers(-6, 7, 200), strict=True)]
    rows += [("one", 3, 2.0)] + [(None, k, float(k % 5)) for k in range(30)]
    return rows


def by_key(rows):
    out = {}
    for key, *rest in rows:
        out.setdefault(key, []).append(rest)
    return out


@pytest.mark.parametrize("run_rows", CUTS)
def test_autocorrelation(spark, ledger, run_rows):
    told = {r.cfg: r.autocorrelation for r in trading.clustering(spark.createDataFrame(ledger, "cfg string, seq long, ret double"), "cfg", "ret", "seq", run_rows).collect()}
    for key, rows in by_key(ledger).items():
        v = [x for _, x in sorted(rows)]
        if len(v) < 3:
            assert told[key] is None or math.isnan(told[key])
        else:
            assert told[key] == pytest.approx(np.corrcoef(v[1:], v[:-1])[0, 1], abs=1e-9)


@pytest.mark.parametrize("run_rows", CUTS)
def test_top_share(spark, ledger, run_rows):
    frame = spark.createDataFrame([*ledger, ("one", 9, None)], "cfg string, seq long, ret double")
    told = {r.cfg: r for r in premium.top_share(frame, "cfg", "ret", (0.01, 0.1, 0.5), run_rows).collect()}
    for key, rows in by_key(ledger).items():
        sizes = sorted((abs(x) for _, x in rows), reverse=True)
        for share, name in ((0.01, "top1pct"), (0.1, "top10pct"), (0.5, "top50pct")):
            assert told[key][name] == pytest.approx(sum(sizes[: max(1, math.ceil(len(sizes) * share))]) / sum(sizes))


def test_concentration(spark, ledger):
    told = {r.cfg: r for r in trading.concentration(spark.createDataFrame(ledger, "cfg string, seq long, ret double"), "cfg", "ret", "seq").collect()}
    for key, rows in by_key(ledger).items():
        v = sorted((x for _, x in rows), reverse=True)
        assert told[key].top10 == pytest.approx(sum(v[:10]) / sum(v))
        assert told[key].mean_without_best5 == (pytest.approx(sum(v[5:]) / len(v[5:])) if len(v) > 5 else None)


@pytest.mark.parametrize("run_rows", CUTS)
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_clusters(spark, run_rows, kind):
    rng = np.random.default_rng(11)
    start = dt.datetime(2024, 3, 31)
    rows = [("a", start + dt.timedelta(seconds=int(s))) for s in np.cumsum(rng.choice([0, 20, 100, 400], 120))] + [("b", start), (None, start), (None, start + dt.timedelta(days=2))]
    made = series.clusters(spark.createDataFrame(rows, f"symbol string, ts {kind}"), "3 minutes", run_rows=run_rows)
    told = sorted((str(r.symbol), r.cluster, r.start, r.stop, r.n) for r in made.collect())
    want = []
    for key, times in by_key(rows).items():
        groups = []
        for (t,) in sorted(times):
            if not groups or t - groups[-1][-1] > dt.timedelta(minutes=3):
                groups.append([])
            groups[-1].append(t)
        want += [(str(key), k + 1, g[0], g[-1], len(g)) for k, g in enumerate(groups)]
    assert told == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "cfg string, seq long, ret double")
    assert trading.clustering(none, "cfg", "ret", "seq").count() == premium.top_share(none, "cfg", "ret").count() == trading.concentration(none, "cfg", "ret", "seq").count() == 0
    assert series.clusters(none.select(F.col("cfg").alias("symbol"), F.lit(None).cast("timestamp").alias("ts"))).count() == 0
