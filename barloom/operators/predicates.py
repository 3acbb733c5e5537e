"""Level-wise search over ANDs of predicates on a bitmap index.

The index has one row per part, symbol and stretch of time: the times and labels of the stretch's bars and one bitmap per
predicate.  A level of the search counts all its candidates in one job over the index: bitmaps are ANDed where they lie, each
stretch answers with (events, label sum, first and last event, clusters), and Spark adds the stretches up.  Clusters are
runs of events no further apart than a gap; those that reach over the edge of a stretch are joined by its first and last
event, so no bar's history is ever in one task.

A level only tries what the level before left: support can only fall with each AND, so nothing is lost.  What comes to the
driver are the figures of candidates, whose number hangs on the predicates alone.

Labels are taken in whole millionths, so sums don't hang on their order.  Bars with a null label are left out; a null
predicate is false.  An empty frame gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MILLION = 1_000_000

_INDEX = "part string, symbol string, stretch timestamp_ntz, n int, at binary, label binary, maps array<binary>"
_FOUND = "candidate int, part string, symbol string, stretch timestamp_ntz, n long, total long, first long, last long, clusters long"


def bitmap_index(frame: DataFrame, masks: dict[str, Column], label: str, part: Column, stretch: str = "month") -> DataFrame:
    """(part, symbol, stretch, n, at, label, maps) of ``frame`` (symbol, ts): a group is one symbol's bars of one stretch."""
    flags = F.array(*[F.coalesce(m, F.lit(False)) for m in masks.values()])
    whole = F.floor(F.col(label) * MILLION + 0.5).cast("long")
    rows = frame.where(F.col(label).isNotNull()).select(
        part.alias("part"), "symbol", F.date_trunc(stretch, "ts").cast("timestamp_ntz").alias("stretch"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), whole.alias("label"), flags.alias("flags"),
    )

    def pack(group):
        import pyarrow as pa

        group = group.sort_by("at")
        bits = np.array(group["flags"].combine_chunks().flatten().to_numpy(zero_copy_only=False), bool).reshape(group.num_rows, -1)
        maps = [np.packbits(bits[:, k]).tobytes() for k in range(bits.shape[1])]
        fixed = [group["at"].to_numpy().astype("<i8").tobytes()], [group["label"].to_numpy().astype("<i8").tobytes()]
        first = [group[c].combine_chunks().slice(0, 1) for c in ("part", "symbol", "stretch")]
        names = ["part", "symbol", "stretch", "n", "at", "label", "maps"]
        return pa.table([*first, pa.array([group.num_rows], pa.int32()), *fixed, pa.array([maps], pa.list_(pa.binary()))], names=names)

    return rows.groupBy("part", "symbol", "stretch").applyInArrow(pack, _INDEX)


def count_candidates(index: DataFrame, candidates: Sequence[tuple[int, ...]], gap: str) -> DataFrame:
    """(candidate, part, n, total, clusters): events, label sum in millionths and clusters of each AND of predicates.

    ``candidates`` are tuples of predicate numbers, sorted; one that has no event in a part has no row there.
    """
    micros = f"unix_micros(timestamp_seconds(0) + INTERVAL {gap})"
    limit = index.sparkSession.range(1).select(F.expr(micros)).first()[0]

    def run(batches):
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                at, label = np.frombuffer(row.at, "<i8"), np.frombuffer(row.label, "<i8")
                maps = [np.frombuffer(m, np.uint8) for m in row.maps]
                shared: dict[tuple[int, ...], np.ndarray] = {(): np.full(len(maps[0]), 255, np.uint8)}
                for k, names in enumerate(candidates):
                    head = names[:-1]
                    if head not in shared:
                        shared[head] = np.bitwise_and.reduce([maps[i] for i in head])
                    on = np.flatnonzero(np.unpackbits(shared[head] & maps[names[-1]], count=row.n))
                    if len(on):
                        when = at[on]
                        out.append((k, row.part, row.symbol, row.stretch, len(on), int(label[on].sum()), int(when[0]), int(when[-1]), 1 + int((np.diff(when) > limit).sum())))
            import pandas as pd

            yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    found = index.mapInPandas(run, _FOUND)
    before = F.lag("last").over(Window.partitionBy("candidate", "part", "symbol").orderBy("stretch"))
    joined = F.coalesce(F.col("first") - before <= limit, F.lit(False)).cast("long")
    return found.withColumn("clusters", F.col("clusters") - joined).groupBy("candidate", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("clusters").alias("clusters"))


def search(
    frame: DataFrame, masks: dict[str, Column], label: str, part: Column, train: str = "train", check: str = "check",
    least: int = 50, least_clusters: int = 10, gap: str = "3 hours", depth: int = 3, stretch: str = "month",
) -> DataFrame:
    """(names, depth, part, n, mean, clusters) of all ANDs of one to ``depth`` predicates that have support.

    Singles go on with ``least`` events, a mean above 0 and ``least_clusters`` clusters in ``train``.  Pairs of them are
    reported with ``least`` events in ``train``; they go on with a mean above 0 there and in ``check``.  A triple is tried if
    it holds a pair that goes on and all its pairs have support.
    """
    names = list(masks)
    index = bitmap_index(frame, masks, label, part, stretch).persist()
    rows: list[tuple] = []
    going, supported = {(): True}, {()}
    singles: list[int] = []
    for level in range(1, depth + 1):
        if level == 1:
            tried = [(k,) for k in range(len(names))]
        else:
            tried = sorted({tuple(sorted({*g, k})) for g in going for k in singles if k not in g})
            tried = [c for c in tried if all(s in supported for s in combinations(c, level - 1))]
        if not tried:
            break
        found: dict[int, dict[str, tuple]] = {}
        for r in count_candidates(index, tried, gap).collect():  # as many rows as candidates and parts
            found.setdefault(r.candidate, {})[r.part] = (r.n, r.total, r.clusters)
        held = {tried[k]: parts for k, parts in found.items() if parts.get(train, (0,))[0] >= least}
        supported = set(held)
        gains = lambda parts, p: p in parts and parts[p][1] > 0
        if level == 1:
            going = {c for c, parts in held.items() if gains(parts, train) and parts[train][2] >= least_clusters}
            supported &= going
            singles = [c[0] for c in going]
        else:
            going = {c for c, parts in held.items() if gains(parts, train) and gains(parts, check)}
        rows += [([names[i] for i in c], level, p, n, total / n / MILLION, clusters) for c, parts in held.items() for p, (n, total, clusters) in parts.items()]
    index.unpersist()
    return frame.sparkSession.createDataFrame(rows, "names array<string>, depth int, part string, n long, mean double, clusters long")
