"""Paths of added returns, cut into runs that merge.

What a stretch of trades does to an equity curve is four numbers: its sum, its highest and lowest prefix (the empty one counts)
and its deepest fall.  Two neighbouring stretches merge in order,

    sum = s1 + s2;  high = max(h1, s1 + h2);  low = min(l1, s1 + l2);  fall = max(f1, f2, h1 - (s1 + l2)),

so a ledger may be cut anywhere: windows order the trades of one run, and a second window orders the runs of a key, which
are few.  Losing streaks merge alike, by the places of the last trade that ended one.

Random orders are not exploded into rows: tasks deal the trades of a chunk to the runs of every order in packed columns, so a
trade of an order costs its digest's head and its value, and a task that gets a run walks it in numpy.

Null values count as 0.  Trades of a key that tie in order stay in one run; ties are ordered by value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: trades that a run is meant to hold
RUN_ROWS = 200_000
#: trades that a task deals at once, and trades of shuffled orders that a task walks
CHUNK_ROWS, TASK_ROWS = 400_000, 2_000_000


def run_edges(trades: DataFrame, order: str, run_rows: int = RUN_ROWS) -> list[float]:
    """Places at which the whole table's order is cut so that about ``run_rows`` trades fall between two."""
    n = trades.count()
    runs = -(-n // run_rows)
    if runs <= 1:
        return []
    share = [k / runs for k in range(1, runs)]
    return sorted(set(trades.select(F.col(order).cast("double").alias("x")).approxQuantile("x", share, min(0.01, 0.2 / runs))))


def run_of(order: Column, edges: Sequence[float]) -> Column:
    """Number of the run, by halving: as deep as the logarithm of the edges."""

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(order.cast("double") < edges[mid], place(low, mid)).otherwise(place(mid + 1, high))

    return place(0, len(edges))


def seconds_of(frame: DataFrame, ts: str) -> Column:
    """A number that orders ``ts``: seconds since 1970, of timestamps without a zone by their own clock."""
    if dict(frame.dtypes)[ts] != "timestamp_ntz":
        return F.col(ts).cast("timestamp").cast("double")
    return F.unix_date(F.to_date(ts)) * 86400.0 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def entered(rows: DataFrame, keys: Sequence[str], last: Column) -> DataFrame:
    """(keys, run, came): ``last`` (an aggregate) of the nearest earlier run of the same keys, null before the first."""
    each = rows.groupBy(*keys, "run").agg(last.alias("_last"))
    return each.select(*keys, "run", F.lag("_last").over(Window.partitionBy(*keys).orderBy("run")).alias("came"))


def with_entry(rows: DataFrame, keys: Sequence[str], last: Column) -> DataFrame:
    """``rows`` with ``came`` of ``entered``; null keys meet.  There is one row for each key and run, so it is small."""
    few = entered(rows, keys, last).select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("run").alias("_of_run"), "came")
    same = F.col("run") == F.col("_of_run")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(few, same).drop("_of_run", *[f"_of_{k}" for k in keys])


def run_parts(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, run, n, sum, high, low, fall, won, lost, lead_losses, lead_wins, tail..., most...) of every run of ``rows``."""
    r = F.coalesce(F.col(value), F.lit(0.0))
    path = Window.partitionBy(*keys, "run").orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(Window.partitionBy(*keys, "run").orderBy(*order, value))
    walked = rows.withColumns({"_r": r, "_equity": F.sum(r).over(path), "_at": at})
    walked = walked.withColumns(
        {
            "_peak": F.greatest(F.max("_equity").over(path), F.lit(0.0)),
            "_not_loss": F.coalesce(F.max(F.when(F.col("_r") >= 0, F.col("_at"))).over(path), F.lit(0)),
            "_not_win": F.coalesce(F.max(F.when(F.col("_r") <= 0, F.col("_at"))).over(path), F.lit(0)),
        }
    )
    # a streak that the run's start cuts is 'lead'; one that begins in the run counts in 'most'
    streak = lambda breaker, own: [
        F.max(F.when(F.col(breaker) == 0, F.col("_at"))).alias(f"lead_{own}"),
        F.max(F.when(F.col(breaker) > 0, F.col("_at") - F.col(breaker))).alias(f"most_{own}"),
        F.max(breaker).alias(f"break_{own}"),
    ]
    return walked.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_r").alias("sum"), F.greatest(F.max("_equity"), F.lit(0.0)).alias("high"),
        F.least(F.min("_equity"), F.lit(0.0)).alias("low"), F.max(F.col("_peak") - F.col("_equity")).alias("fall"),
        *streak("_not_loss", "losses"), *streak("_not_win", "wins"),
    )


def placed_runs(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``parts`` with what came before each run: ``start`` (sum), ``top`` (highest prefix) and ``offset`` (trades)."""
    before = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumns({"start": F.coalesce(F.sum("sum").over(before), F.lit(0.0)), "offset": F.coalesce(F.sum("n").over(before), F.lit(0))})
    out = out.withColumn("top", F.greatest(F.max(F.col("start") + F.col("high")).over(before), F.lit(0.0)))
    last = lambda own: F.coalesce(F.max(F.when(F.col(f"break_{own}") > 0, F.col("offset") + F.col(f"break_{own}"))).over(before), F.lit(0))
    return out.withColumns({f"since_{own}": F.col("offset") - last(own) for own in ("losses", "wins")})


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, total, max_drawdown, max_losses, max_wins) of the runs put together; streaks are null where there is none."""
    runs = placed_runs(parts, keys)
    streak = lambda own: F.max(F.greatest(F.nullif(F.col(f"most_{own}"), F.lit(0)), F.col(f"since_{own}") + F.col(f"lead_{own}")))
    return runs.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("sum").alias("total"),
        F.max(F.greatest(F.col("fall"), F.col("top") - (F.col("start") + F.col("low")))).alias("max_drawdown"),
        streak("losses").alias("max_losses"),
        streak("wins").alias("max_wins"),
    )


def paths(trades: DataFrame, key: str, value: str, order: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, n, total, max_drawdown, max_losses, max_wins): each key's trades in ``order`` (a number), cut into runs."""
    edges = run_edges(trades, order, run_rows)
    rows = trades.select(key, F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"), run_of(F.col(order), edges).alias("run"))
    return merged(run_parts(rows, [key], "_value", ["_order"]), [key])


def shuffled(trades: DataFrame, key: str, value: str, tie: str, reps: int, run_rows: int = RUN_ROWS, seed: int = 42) -> DataFrame:
    """(key, rep, n, total, max_drawdown, max_losses, max_wins) of ``reps`` random orders of each key's trades.

    An order is a digest of seed, repetition and trade, so it is the same on any cluster and after any retry; its first
    digits are the run.  ``tie`` names a trade.  Of a digest the first ten bytes are kept; trades that agree in them are
    ordered by value.
    """
    n = trades.count()
    runs = max(1, -(-n // run_rows))
    chunks = max(-(-n // CHUNK_ROWS), min(32, -(-n // 5000)), 1)
    parts = min(reps * runs, max(32, -(-n * reps // TASK_ROWS)))
    rows = trades.select(key, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"), F.coalesce(F.col(tie).cast("string"), F.lit("")).cast("binary").alias("_tie"))
    kind = trades.schema[key].dataType
    packed = T.StructType().add("rep", "integer").add("run", "integer").add("keys", T.ArrayType(kind)).add("lens", T.ArrayType(T.IntegerType())).add("heads", "binary").add("tails", "binary").add("unit", "integer").add("values", "binary")
    told = T.StructType().add(key, kind).add("rep", "integer").add("run", "integer").add("n", "long")
    for c in _RUN_SUMS:
        told = told.add(c, "double")
    for c in _RUN_COUNTS:
        told = told.add(c, "long")
    dealt = rows.repartition(chunks).mapInArrow(_dealer(reps, runs, seed), packed)
    walked = dealt.repartition(parts, "rep", "run").groupBy("rep", "run").applyInArrow(_walker(key), told)
    return merged(walked, [key, "rep"])


_RUN_SUMS = ("sum", "high", "low", "fall")
_RUN_COUNTS = tuple(f"{part}_{own}" for own in ("losses", "wins") for part in ("lead", "most", "break"))
#: a value is kept as a whole number of hundredths or the like where that is exact, else (0) as it is
_UNITS = (1, 100, 10_000)


def _dealer(reps: int, runs: int, seed: int):
    """Trades (key, value, tie) of a task, dealt to the runs of every order: one packed row for each run of a chunk."""

    def deal(batches):
        from hashlib import md5

        import pyarrow as pa

        def chunk(held):
            table = pa.Table.from_batches(held)
            found = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
            code, names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
            v, ties = table.column(1).to_numpy(), table.column(2).to_pylist()
            for unit in (*_UNITS, 0):
                with np.errstate(invalid="ignore", over="ignore"):
                    scaled = np.rint(v * unit)
                    if unit and (np.abs(scaled) < 2**31).all() and (scaled / unit == v).all():
                        v = scaled.astype("<i4")
                        break
            for rep in range(1, reps + 1):
                start = f"{seed}:{rep}:".encode()
                digest = np.frombuffer(b"".join([md5(start + t).digest() for t in ties]), np.uint8).reshape(-1, 16)
                head, tail = digest[:, :8].copy().view(">u8").ravel().astype("<u8"), digest[:, 8:10].copy().view(">u2").ravel().astype("<u2")
                place = ((head >> np.uint64(32)) * np.uint64(runs) >> np.uint64(32)).astype(np.int64) * len(names) + code
                order = np.argsort(place, kind="stable")
                place, head, tail, mine = place[order], head[order], tail[order], v[order]
                first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))  # of each run and key
                lens = np.diff(np.append(first, len(place))).astype(np.int32)
                run = place[first] // len(names)
                turn = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1, [len(run)]))  # of each run
                cuts = np.append(first, len(place))[turn]
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                packed = lambda x, spans=spans: pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())
                listed = lambda x, turn=turn: pa.ListArray.from_arrays(pa.array(turn, pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rep] * len(spans), pa.int32()), pa.array(run[turn[:-1]], pa.int32()), listed(names.take(pa.array(place[first] % len(names)))), listed(pa.array(lens)),
                        packed(head), packed(tail), pa.array([unit] * len(spans), pa.int32()), packed(mine),
                    ],
                    names=["rep", "run", "keys", "lens", "heads", "tails", "unit", "values"],
                )

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_ROWS:
                yield from chunk(held)
                held, n = [], 0
        if n:
            yield from chunk(held)

    return deal


def _walker(key: str):
    """The packed rows of one run of one order, put in order and walked key by key."""

    def path(v: np.ndarray) -> list:
        """What ``run_parts`` says of a run's values in order, from ``n`` on."""
        equity = np.cumsum(v)
        peak = np.maximum(np.maximum.accumulate(equity), 0.0)
        out = [len(v), equity[-1], max(0.0, equity.max()) if equity[-1] == equity[-1] else np.nan, min(0.0, np.fmin.reduce(equity)), (peak - equity).max()]
        at = np.arange(1, len(v) + 1)
        for breaker in (~(v < 0), v <= 0):
            last = np.maximum.accumulate(np.where(breaker, at, 0))
            lead = int(np.argmax(breaker)) if last[-1] else len(v)
            out += [lead or None, int((at - last)[lead:].max()) if last[-1] else None, int(last[-1])]
        return out

    def walk(group, table):
        import pyarrow as pa

        whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        values = [np.frombuffer(x, "<i4") / unit if unit else np.frombuffer(x, "<f8") for x, unit in zip(table.column("values").to_pylist(), table.column("unit").to_pylist(), strict=True)]
        head, tail, v = whole("heads", "<u8"), whole("tails", "<u2"), np.concatenate(values)
        found = table.column("keys").combine_chunks().flatten().dictionary_encode(null_encoding="encode")
        lens = table.column("lens").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        code = np.repeat(found.indices.to_numpy(zero_copy_only=False), lens)
        order = np.lexsort((head, code))
        same = head[order]
        if (same[1:] == same[:-1]).any():
            order = np.lexsort((v, tail, head, code))
        code, v = code[order], v[order]
        first = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1))
        told = [path(x) for x in np.split(v, first[1:])]
        rep, run = (pa.array([g.as_py()] * len(told), pa.int32()) for g in group)
        columns = [pa.array(c, pa.float64() if 1 <= k <= 4 else pa.int64()) for k, c in enumerate(zip(*told, strict=True))]
        return pa.Table.from_arrays([found.dictionary.take(pa.array(code[first])), rep, run, *columns], names=[key, "rep", "run", "n", *_RUN_SUMS, *_RUN_COUNTS])

    return walk


def monte_carlo(trades: DataFrame, key: str, value: str, tie: str, reps: int = 200, run_rows: int = RUN_ROWS, seed: int = 42) -> DataFrame:
    """Per key the drawdowns of ``reps`` random orders: mean, the values at 5, 50 and 95 % and the worst, and the same of
    losing streaks.  The value at p is the one at place floor(p * reps) of the sorted ones, counted from 0."""
    each = shuffled(trades, key, value, tie, reps, run_rows, seed)
    at = lambda c, p: F.element_at(F.sort_array(F.collect_list(c)), min(reps, int(p * reps) + 1))
    streak = F.coalesce("max_losses", F.lit(0))
    return each.groupBy(key).agg(
        F.count(F.lit(1)).alias("reps"), F.first("n").alias("n"), F.avg("max_drawdown").alias("mean"),
        *[at("max_drawdown", p).alias(f"p{int(100 * p)}") for p in (0.05, 0.5, 0.95)], F.max("max_drawdown").alias("worst"),
        at(streak, 0.5).alias("streak_p50"), at(streak, 0.95).alias("streak_p95"),
    )


def capital_drawdown(trades: DataFrame, key: str, value: str, order: str, capital: float, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, total, max_drawdown_pct, trades_under): the deepest fall in percent of the equity's peak, from ``capital`` on.

    A share of the peak hangs on where a run starts, so the runs are placed first and walked again from there.
    """
    edges = run_edges(trades, order, run_rows)
    rows = trades.select(key, F.col(order).alias("_order"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"), run_of(F.col(order), edges).alias("run"))
    starts = placed_runs(run_parts(rows, [key], "_value", ["_order"]), [key]).select(key, "run", "start", "top")
    path = Window.partitionBy(key, "run").orderBy("_order", "_value").rowsBetween(Window.unboundedPreceding, 0)
    walked = rows.join(starts, [key, "run"]).withColumn("_equity", F.col("start") + F.sum("_value").over(path))
    walked = walked.withColumn("_peak", F.greatest(F.max("_equity").over(path), F.col("top")))
    share = (F.col("_equity") - F.col("_peak")) / (F.lit(float(capital)) + F.col("_peak")) * 100
    return walked.groupBy(key).agg(F.sum("_value").alias("total"), F.min(share).alias("max_drawdown_pct"), F.count_if(F.col("_equity") < F.col("_peak")).alias("trades_under"))


def capital_metrics(trades: DataFrame, calendar: DataFrame, key: str, value: str, order: str, day: str, capital: float, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per ``key`` the figures of a ledger on an initial capital: net, win_rate, profit_factor, max_drawdown_pct, days,
    trades_per_day, sharpe, sortino, expectancy, final_capital.

    ``calendar`` holds all session days in its column ``day``; Sharpe and Sortino are of each day's result over the initial capital,
    days without a trade count 0.  A profit factor without losses is 99.99 (0 without gains too), as is a Sortino without
    a deviation of the losing days and a mean above 0.  The drawdown is of the realised equity.
    """
    falls = capital_drawdown(trades, key, value, order, capital, run_rows).select(F.col(key).alias("_k"), "max_drawdown_pct")
    r, zero = F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0)
    told = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(r).alias("net"), F.count_if(r > 0).alias("_wins"),
        F.coalesce(F.sum(F.when(r > 0, r)), zero).alias("_gain"), F.coalesce(F.sum(F.when(r <= 0, -r)), zero).alias("_loss"),
    )
    n_days = calendar.select(F.col(day).alias("_day")).distinct().agg(F.count(F.lit(1)).alias("days"))
    by_day = trades.groupBy(key, day).agg((F.sum(r) / capital).alias("_d"))
    # days without a trade add nothing to the sums; the mean and deviation are over all days
    sums = by_day.groupBy(F.col(key).alias("_key")).agg(F.sum("_d").alias("_s"), F.sum(F.col("_d") * F.col("_d")).alias("_q"), F.stddev_samp(F.when(F.col("_d") < 0, F.col("_d"))).alias("_down"))
    out = told.join(sums, F.col(key).eqNullSafe(F.col("_key"))).join(falls, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_one", F.lit(1)).join(n_days.withColumn("_one", F.lit(1)), "_one")
    mean = F.col("_s") / F.col("days")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("days") * mean * mean) / F.greatest(F.col("days") - 1, F.lit(1)))
    year = float(252**0.5)
    return out.select(
        key, "trades", "net", (F.col("_wins") / F.col("trades") * 100).alias("win_rate"),
        F.when(F.col("_loss") > 0, F.col("_gain") / F.nullif("_loss", zero)).when(F.col("_gain") > 0, 99.99).otherwise(0.0).alias("profit_factor"),
        "max_drawdown_pct", "days", (F.col("trades") / F.col("days")).alias("trades_per_day"),
        F.when(spread > 0, mean / F.nullif(spread, zero) * year).otherwise(0.0).alias("sharpe"),
        F.when(F.col("_down") > 0, mean / F.nullif("_down", zero) * year).when(mean > 0, 99.99).otherwise(0.0).alias("sortino"),
        (F.col("net") / F.col("trades")).alias("expectancy"), (F.col("net") + capital).alias("final_capital"),
    )
