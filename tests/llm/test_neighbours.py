"""Several shards against brute force, ties, equal vectors, small tables and odd rows."""

from __future__ import annotations

import numpy as np

from barloom.llm import ann


def _brute(rows, query, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    s = np.einsum("ij,j->i", x, x[ids == query][0])
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != query][:k]
    return [int(ids[i]) for i in order]


def _found(spark, rows, step, k, **options):
    table = spark.createDataFrame([(i, [float(c) for c in v], "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, id int")
    vectors = ann.valid_vectors(table)
    out: dict = {}
    for r in ann.nearest(vectors, vectors.where(f"id % {step} = 0"), k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[1000:1400] = x[7] + 1e-3 * rng.normal(size=(400, 16))  # a large group of near-equal vectors
    rows = list(enumerate(x))
    got = _found(spark, rows, 50, 20, shard_rows=150, probes=8)
    assert set(got) == set(range(0, 3000, 50)) and all(len(f) == 20 for f in got.values())
    assert np.mean([len(set(f) & set(_brute(rows, q, 20))) / 20 for q, f in got.items()]) >= 0.9


def test_ties_and_small_tables(spark):
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(100 + k, [0.0, 1.0 + k % 2]) for k in range(6)]
    got = _found(spark, rows, 20, 20)
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[40] == list(range(20))
    few = [(k, [k + 1.0, 1.0, -k]) for k in range(7)]
    assert _found(spark, few, 3, 20) == {q: _brute(few, q, 20) for q in (0, 3, 6)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [None, 1.0]), (9, [3.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ann.valid_vectors(table)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(vectors, vectors.where("id % 7 = 0"), 5).collect()]
    assert sorted(got) == [(7, 1, 9, 9.0), (7, 2, 1, 4.0)]
    empty = ann.valid_vectors(table.limit(0))
    assert ann.nearest(empty, empty, 5).count() == 0
    assert ann.nearest(vectors, vectors.limit(0), 5).count() == 0
