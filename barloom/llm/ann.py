"""Approximate nearest neighbours by largest inner product on robust-pruned directed graphs.

Vectors are dealt to shards by the centres nearest to them, each to OVERLAP; every shard builds one graph: greedy
searches propose neighbours and relaxed distance pruning keeps diverse edges.  A query is beam-searched in the shards of
the PROBES centres nearest to it, a number that does not grow with the table, and the shards' answers are merged.  Equal
vectors are one node that carries the ids that can matter.  The inner product becomes a distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, so norms may differ.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, slices, spread_join

DEGREE = 40
ALPHA = 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 160
EXPAND = 4
BATCH = 256
#: nodes of one graph, which bounds a build task's memory
SHARD_ROWS = 16384
#: centres that a vector is dealt to, and centres whose shards a query is searched in
OVERLAP, PROBES = 1, 16
#: centres at most (a centre with more vectors than a shard has several shards, dealt by a hash), and vectors they are
#: fitted on at most, drawn by a hash
MAX_CENTRES, SAMPLE_ROWS = 1024, 20_000
#: queries that one search task takes
QUERY_BLOCK = 8192
SALTS = 64


def beam_search(vectors: np.ndarray, square: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances up to a constant) of the ``beam`` nearest nodes met, nearest first; -1 pads."""
    n, rows = len(vectors), len(queries)
    ids = np.full((rows, beam), -1, np.int64)
    dist = np.full((rows, beam), np.inf, np.float32)
    done = np.ones((rows, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = square[start] - 2 * queries @ vectors[start]
    seen = np.zeros(rows * n, bool)
    owner = np.zeros(rows * n, np.int32)
    seen[np.arange(rows) * n + start] = True
    while True:
        todo = ~done
        todo &= np.cumsum(todo, axis=1) <= EXPAND
        row, place = np.nonzero(todo)
        if not len(row):
            return ids, dist
        done[row, place] = True
        near = edges[ids[row, place]]
        key = (row[:, None] * n + near)[near >= 0]
        key = key[~seen[key]]
        owner[key] = np.arange(len(key), dtype=np.int32)
        key = key[owner[key] == np.arange(len(key), dtype=np.int32)]
        seen[key] = True
        if not len(key):
            continue
        key.sort()
        row, node = key // n, key % n
        d = square[node] - 2 * np.einsum("ij,ij->i", vectors[node], queries[row])
        count = np.bincount(row, minlength=rows)
        place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        all_d = np.concatenate([dist, np.full((rows, width), np.inf, np.float32)], axis=1)
        all_ids = np.concatenate([ids, np.full((rows, width), -1)], axis=1)
        all_done = np.concatenate([done, np.ones((rows, width), bool)], axis=1)
        all_d[row, beam + place], all_ids[row, beam + place], all_done[row, beam + place] = d, node, False
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist, ids, done = (np.take_along_axis(x, order, axis=1) for x in (all_d, all_ids, all_done))


def robust_prune(vectors: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point from its candidate row (-1 pads, may hold the point itself)."""
    cands = np.where(cands == points[:, None], -1, cands)
    x = vectors[np.maximum(cands, 0)]
    to_point = ((x - vectors[points][:, None, :]) ** 2).sum(-1)
    to_point[cands < 0] = np.inf
    order = np.argsort(to_point, axis=1, kind="stable")
    cands, to_point = np.take_along_axis(cands, order, 1), np.take_along_axis(to_point, order, 1)
    x = np.take_along_axis(x, order[:, :, None], 1)
    square = (x**2).sum(-1)
    between = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    alive = np.isfinite(to_point)
    out, n = np.full((len(points), degree), -1, np.int64), np.zeros(len(points), np.int64)
    for k in range(cands.shape[1]):
        take = alive[:, k] & (n < degree)
        if not take.any():
            continue
        out[take, n[take]] = cands[take, k]
        n[take] += 1
        alive[take] &= ~(alpha * alpha * between[take, k, :] <= to_point[take])
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(edges [n, degree] padded with -1, start node): points are inserted in batches, each into the graph so far."""
    n = len(vectors)
    square = (vectors**2).sum(1)
    start = int(np.argmin(((vectors - vectors.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    edges = np.full((n, degree), -1, np.int64)
    first = order[: min(n, degree)]
    edges[first] = robust_prune(vectors, first, np.tile(first, (len(first), 1)), degree, alpha)
    at = len(first)
    while at < n:
        batch = order[at : at + min(BATCH, at)]
        at += len(batch)
        found, _ = beam_search(vectors, square, edges, start, vectors[batch], beam)
        edges[batch] = robust_prune(vectors, batch, found, degree, alpha)
        row, place = np.nonzero(edges[batch] >= 0)
        source, target = batch[row], edges[batch][row, place]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        extra = np.full((len(nodes), count.max()), -1, np.int64)
        extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
        both = np.concatenate([edges[nodes], extra], axis=1)
        full = (both >= 0).sum(1) > degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        edges[nodes[~full]] = packed[~full][:, :degree]
        for k in range(0, int(full.sum()), BATCH):
            part = np.flatnonzero(full)[k : k + BATCH]
            edges[nodes[part]] = robust_prune(vectors, nodes[part], packed[part], degree, alpha)
    # one edge more to the next node in order, so that every node can be reached
    after = np.full(n, -1, np.int64)
    after[order[:-1]] = order[1:]
    return np.concatenate([edges, after[:, None]], axis=1), start


def centres_of(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centres of the sample by Lloyd's method, started at its rows."""
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        own = nearest_centres(sample, centres, 1)[:, 0]
        order = np.argsort(own, kind="stable")
        there, begin, count = np.unique(own[order], return_index=True, return_counts=True)
        centres[there] = np.add.reduceat(sample[order], begin, axis=0) / count[:, None]
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest centres of every row, nearest first."""
    distance = (centres**2).sum(1) - 2 * x @ centres.T
    return np.argsort(distance, axis=1, kind="stable")[:, :k]


def _dealt(rows: DataFrame, centres, top: float | None, k: int) -> DataFrame:
    """``rows`` (with v) once for each of its ``k`` nearest centres: one more column, centre; ``top`` lifts vectors."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            v = np.array(batch.column(batch.schema.get_field_index("v")).to_pylist(), float)
            if not len(v):
                continue
            lift = np.zeros(len(v)) if top is None else np.sqrt(np.maximum(0.0, top - (v**2).sum(1)))
            near = nearest_centres(np.concatenate([v, lift[:, None]], axis=1), centres.value, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "centres"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "centres array<int>"])
    return rows.mapInArrow(run, schema).withColumn("centre", F.explode("centres")).drop("centres")


def valid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector that is neither null nor zero, all finite, of the
    length that most rows have; of rows that repeat an id, the one with the smallest vector."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (length["d"] if length else -1))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every query.

    ``vectors`` and ``queries`` have (id, v) as :func:`valid_vectors` makes them; a query is not its own neighbour.
    Nearest is the largest inner product in double precision, ties go to the smaller id; fewer than ``k`` rows mean
    that there are no more candidates in the shards searched.  No vectors or no queries give an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    salted = W.partitionBy("v", F.pmod(F.col("id"), F.lit(SALTS))).orderBy("id")
    few = vectors.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1)
    nodes = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    nodes = scratch.put(nodes, "nodes")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    top = float(size["m"] or 0.0)
    if size["n"] == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    n = max(1, min(MAX_CENTRES, -(-size["n"] * OVERLAP // shard_rows))) if size["n"] > shard_rows else 1
    mark = F.xxhash64("v")
    sample = [r[0] for r in nodes.where(F.pmod(mark, F.lit(2**20)) <= int(min(1.0, SAMPLE_ROWS / max(size["n"], 1)) * 2**20)).orderBy(mark).limit(SAMPLE_ROWS).select("v").collect()]
    x = np.array(sample, float).reshape(len(sample), len(sample[0]) if sample else 0)
    found = centres_of(np.concatenate([x, np.sqrt(np.maximum(0.0, top - (x**2).sum(1)))[:, None]], axis=1), n)
    centres = spark.sparkContext.broadcast(found)
    dealt = _dealt(nodes, centres, top, OVERLAP)
    shards = dealt.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    shards = scratch.put(shards, "shards")  # a row for each centre

    def build(frame):
        import pandas as pd

        v = np.stack(frame["v"].to_numpy())
        lift = np.sqrt(np.maximum(0.0, top - (v**2).sum(1)))
        edges, start = build_graph(np.concatenate([v, lift[:, None]], axis=1).astype(np.float32))
        row = {"centre": frame["centre"].iloc[0], "shard": frame["shard"].iloc[0], "v": v.astype("<f8").tobytes(), "edges": edges.astype("<i4").tobytes(), "start": start, "ids": [list(x) for x in frame["ids"]]}
        return pd.DataFrame([row])

    placed = dealt.join(F.broadcast(shards), "centre").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    index = placed.groupBy("centre", "shard").applyInPandas(build, "centre int, shard int, v binary, edges binary, start int, ids array<array<long>>")
    index = scratch.put(index, "index")

    asked = _dealt(queries.select("id", "v"), centres, None, probes).join(F.broadcast(shards), "centre")
    asked = asked.select("id", "v", "centre", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    asked = scratch.put(asked, "asked")
    loads = asked.groupBy("centre", "shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    key = F.concat_ws("/", "centre", "shard").alias("place")
    asked = spread_join(asked.select("*", key), loads.select(key, "blocks"), "place", F.xxhash64("id"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "centre", "shard", "block")
    graphs = index.join(loads, ["centre", "shard"]).select(*index.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(graph, frame):
        import pandas as pd

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(frame):
            q = np.stack(frame["v"].to_numpy())
            d = q.shape[1]
            v = np.frombuffer(graph["v"].iloc[0], "<f8").reshape(-1, d)
            edges = np.frombuffer(graph["edges"].iloc[0], "<i4").reshape(len(v), -1).astype(np.int64)
            ids = graph["ids"].iloc[0]
            lift = np.sqrt(np.maximum(0.0, top - (v**2).sum(1)))
            x = np.concatenate([v, lift[:, None]], axis=1).astype(np.float32)
            square = (x**2).sum(1)
            names = frame["id"].to_numpy()
            for at in range(0, len(q), BATCH):
                part = q[at : at + BATCH]
                lifted = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
                near = beam_search(x, square, edges, int(graph["start"].iloc[0]), lifted, beam)[0]
                score = np.einsum("ijk,ik->ij", v[np.maximum(near, 0)], part)
                score[near < 0] = -np.inf
                for r, me in enumerate(names[at : at + BATCH]):
                    best = np.argsort(-score[r], kind="stable")
                    found: list[tuple[float, int]] = []
                    for c in best:
                        s = score[r, c]
                        if s == -np.inf or len(found) >= k and s < found[k - 1][0]:
                            break
                        found += [(s, int(i)) for i in ids[near[r, c]] if i != me]
                    for s, i in sorted(found, key=lambda f: (-f[0], f[1]))[:k]:
                        out["query_id"].append(int(me))
                        out["vec_id"].append(i)
                        out["score"].append(float(s))
        return pd.DataFrame(out)

    place = ["centre", "shard", "block"]
    hits = graphs.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search, "query_id long, vec_id long, score double")
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
