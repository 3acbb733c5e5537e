"""Recurrences by composition: what a stretch of bars does to a running value is itself a small map.

``y = a * y + b`` is an affine map of the value before, and maps compose, so every stretch of a symbol is reduced by itself to
one pair (a, b); the stretches of a symbol, which are few, are folded in order, and each bar is its stretch's start put
through the maps up to it.  A machine of few states is composed alike, as a table from the state before to the state after.
No task holds a symbol's history: a group is one symbol's bars of one stretch.

Bars whose value is null take no part: their result is null, and the value before them is carried on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import ratio, series

_STRETCH = ["symbol", "_stretch"]


def stretches(frame: DataFrame, span: str) -> DataFrame:
    return frame.withColumn("_stretch", F.date_trunc(span, "ts").cast("timestamp_ntz"))


def positions(frame: DataFrame, value: Column, span: str) -> DataFrame:
    """``frame`` where ``value`` is there, with its stretch and its place ``_k`` among the symbol's values, from 1.

    Places are counted per stretch and the counts added up, so no window orders a whole symbol.
    """
    rows = stretches(frame, span).withColumn("_x", value.cast("double")).where(F.col("_x").isNotNull())
    before = Window.partitionBy("symbol").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*_STRETCH).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*_STRETCH, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*_STRETCH).orderBy("ts"))
    return rows.join(counts, _STRETCH).withColumn("_k", F.col("_offset") + place).drop("_offset")


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of affine maps: place i holds the map of the steps 0 to i, by doubling."""
    a, b = a.copy(), b.copy()
    step = 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def affine_scan(frame: DataFrame, into: str, value: Column, first: int, decay: Column, drive: Column, seed: Column, span: str = "month") -> DataFrame:
    """(symbol, ts, into): from the ``first`` value of a symbol on, y = decay * y + drive.

    The value at ``first`` is the sum of ``seed`` over the values up to it; symbols with fewer values have nulls.  ``decay``,
    ``drive`` and ``seed`` are columns of the frame, of ``_x`` (the value) and of ``_k`` (its place).
    """
    rows = positions(frame, value, span)
    step = F.col("_k") > first
    rows = rows.select("symbol", "ts", "_stretch", "_k", F.when(step, decay).otherwise(1.0).alias("_a"), F.when(step, drive).otherwise(0.0).alias("_b"), F.when(~step, seed).otherwise(0.0).alias("_seed"))

    def run(group):
        import pyarrow as pa

        group = group.sort_by("ts")
        a, b = composed(*(group[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("_a", "_b")))
        return group.set_column(4, "_a", pa.array(a)).set_column(5, "_b", pa.array(b))

    schema = "symbol string, ts timestamp_ntz, _stretch timestamp_ntz, _k long, _a double, _b double, _seed double"
    local = rows.groupBy(*_STRETCH).applyInArrow(run, schema)
    maps = local.groupBy(*_STRETCH).agg(F.max_by("_a", "ts").alias("a"), F.max_by("_b", "ts").alias("b"), F.sum("_seed").alias("seed"), F.max("_k").alias("n"))
    folded = maps.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_stretch", "a", "b"))).alias("maps"), F.sum("seed").alias("seed"), F.max("n").alias("n"))
    start = F.struct(F.when(F.col("n") >= first, F.col("seed")).alias("y"), F.array().cast("array<double>").alias("starts"))
    step_on = lambda s, m: F.struct((s["y"] * m["a"] + m["b"]).alias("y"), F.concat(s["starts"], F.array(s["y"])).alias("starts"))
    starts = folded.withColumn("starts", F.aggregate("maps", start, step_on)["starts"])
    starts = starts.select("symbol", F.explode(F.arrays_zip(F.col("maps._stretch").alias("_stretch"), "starts")).alias("m")).select("symbol", "m._stretch", F.col("m.starts").alias("_start"))
    y = F.when(F.col("_k") >= first, F.col("_start") * F.col("_a") + F.col("_b"))
    return local.join(starts, _STRETCH).select("symbol", "ts", y.alias(into))


def ema(frame: DataFrame, p: int, into: str, value: Column | None = None, weight: float | None = None, span: str = "month") -> DataFrame:
    """(symbol, ts, into): exponential mean with weight 2 / (p + 1), seeded by the mean of the first ``p`` values."""
    k = 2 / (p + 1) if weight is None else weight
    return affine_scan(frame, into, F.col("close") if value is None else value, p, F.lit(1 - k), F.col("_x") * k, F.col("_x") / p, span)


def wilder(frame: DataFrame, p: int, into: str, value: Column, span: str = "month") -> DataFrame:
    return ema(frame, p, into, value, 1 / p, span)


def true_range() -> Column:
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def kama(frame: DataFrame, into: str = "kama", p: int = 10, fast: int = 2, slow: int = 30, span: str = "month") -> DataFrame:
    """(symbol, ts, into): Kaufman's mean, whose weight follows the efficiency of the last ``p`` moves; starts at bar p + 1 with the
    mean of the last p closes."""
    moved = F.abs(F.col("close") - F.lag("close").over(series()))
    told = frame.withColumn("_move", moved).withColumn("_path", F.sum("_move").over(series().rowsBetween(-(p - 1), 0)))
    told = told.withColumn("_er", F.coalesce(ratio(F.abs(F.col("close") - F.lag("close", p).over(series())), F.col("_path")), F.lit(0.0)))
    low, high = 2 / (slow + 1), 2 / (fast + 1)
    weight = F.pow(F.col("_er") * (high - low) + low, F.lit(2.0))
    seed = F.when(F.col("_k") > 1, F.col("_x") / p).otherwise(0.0)
    return affine_scan(told, into, F.col("close"), p + 1, 1 - weight, weight * F.col("_x"), seed, span)


def carried(frame: DataFrame, opinion: Column, into: str, span: str = "month") -> DataFrame:
    """``frame`` with the last opinion that is not null, up to the bar: within its stretch, else from the stretches before."""
    rows = stretches(frame, span).withColumn("_opinion", opinion)
    inside = Window.partitionBy(*_STRETCH).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy(*_STRETCH).agg(F.max_by("_opinion", F.when(F.col("_opinion").isNotNull(), F.col("ts"))).alias("_last"))
    before = Window.partitionBy("symbol").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*_STRETCH, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    told = rows.join(last, _STRETCH).withColumn(into, F.coalesce(F.last("_opinion", ignorenulls=True).over(inside), F.col("_before")))
    return told.drop("_stretch", "_opinion", "_before")


# --- machines of few states ------------------------------------------------------------------------------------------


def persistence_machine(labels: int, persist: int, hysteresis: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, shown): state after a label in a state, and the label that a state shows; state 0 is before the first bar.

    A state is the confirmed label, whether one change has been confirmed (the next costs ``hysteresis`` bars more), and the
    contender with the bars it has lasted.
    """
    states: dict[tuple, int] = {("start",): 0}

    def after(state: tuple, label: int) -> tuple:
        if state == ("start",):
            return (label, False, label, 0)
        now, changed, contender, run = state
        if label == now:
            return (now, changed, now, 0)
        run = run + 1 if contender == label else 1
        if run >= persist + hysteresis * changed:
            return (label, True, label, 0)
        return (now, changed, label, run)

    table, waiting = [], [("start",)]
    while waiting:
        state = waiting.pop(0)
        row = []
        for label in range(labels):
            to = after(state, label)
            if to not in states:
                states[to] = len(states)
                waiting.append(to)
            row.append(states[to])
        table.append(row)
    order = sorted(states, key=states.get)
    return np.array(table, np.int32).T.copy(), np.array([-1 if s == ("start",) else s[0] for s in order], np.int32)


def machine_scan(frame: DataFrame, label: str, into: str, table: np.ndarray, shown: np.ndarray, span: str = "month") -> DataFrame:
    """(symbol, ts, label, into): what the machine shows after each bar's ``label``, a number from 0; null labels leave it."""
    rows = stretches(frame, span).where(F.col(label).isNotNull()).select("symbol", "ts", "_stretch", F.col(label).cast("int").alias(label))

    def whole(group):
        import pyarrow as pa

        to = np.arange(table.shape[1], dtype=np.int32)
        for x in group.sort_by("ts")[label].to_pylist():
            to = table[x][to]
        one = [group[c].combine_chunks().slice(0, 1) for c in _STRETCH]
        return pa.table([*one, pa.array([to.tolist()], pa.list_(pa.int32()))], names=[*_STRETCH, "_map"])

    maps = rows.groupBy(*_STRETCH).applyInArrow(whole, "symbol string, _stretch timestamp_ntz, _map array<int>")
    folded = maps.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("_stretch", "_map"))).alias("maps"))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("starts"))
    step_on = lambda s, m: F.struct(F.element_at(m["_map"], s["s"] + 1).alias("s"), F.concat(s["starts"], F.array(s["s"])).alias("starts"))
    starts = folded.withColumn("starts", F.aggregate("maps", start, step_on)["starts"])
    starts = starts.select("symbol", F.explode(F.arrays_zip(F.col("maps._stretch").alias("_stretch"), "starts")).alias("m")).select("symbol", "m._stretch", F.col("m.starts").alias("_start"))

    def run(group):
        import pyarrow as pa

        group = group.sort_by("ts")
        state, out = group["_start"][0].as_py(), []
        for x in group[label].to_pylist():
            state = int(table[x][state])
            out.append(int(shown[state]))
        return pa.table([group["symbol"], group["ts"], group[label], pa.array(out, pa.int32())], names=["symbol", "ts", label, into])

    return rows.join(starts, _STRETCH).groupBy(*_STRETCH).applyInArrow(run, f"symbol string, ts timestamp_ntz, {label} int, {into} int")


def smoothed(frame: DataFrame, label: str, into: str, labels: int = 4, persist: int = 5, hysteresis: int = 2, span: str = "month") -> DataFrame:
    """(symbol, ts, label, into): a new label counts once it has lasted ``persist`` bars, after the first change
    ``hysteresis`` bars more; until then the confirmed one stands."""
    return machine_scan(frame, label, into, *persistence_machine(labels, persist, hysteresis), span)
