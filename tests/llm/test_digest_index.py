"""The digest index against SQL and plain Python: loads, odd rows, reopening."""

from __future__ import annotations

import hashlib

from barloom.llm import digest_index, queries
from barloom.llm.digest_index import DigestIndex

from ..oracle import difference

COLUMNS = "doc_id long, text string, digest string, keep_id int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS)


def test_against_sql(spark, small):
    assert difference(queries.op11_exact_dedup(spark, small), queries.OP11_SQL, small) is None


def test_odd_rows(spark):
    long = "Word " * 400_000
    rows = [(1, "A b"), (2, "a B"), (2, "a b"), (3, "ÀB"), (4, "àB"), (5, "Àb"), (6, None), (7, ""), (None, "lone"), (None, "lone"), (None, "A b"), (8, long), (9, long.upper()), (10, "a b ")]
    judged = digest_index.judge_documents(frame(spark, rows))
    got = [tuple(r) for r in judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert digest_index.judge_documents(frame(spark, rows).limit(0)).count() == 0


def test_loads_and_reopening(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    index = DigestIndex.create(spark, path, 100)
    first = [(5, "x"), (4, "X"), (3, "y"), (3, "y")]
    assert sorted(r.doc_id for r in digest_index.drop_copies(frame(spark, first), index, "one").collect()) == [3, 5]
    for name in index.names.values():
        spark.sql(f"DROP TABLE {name}")
    again = DigestIndex.open(spark, path)
    second = [(9, "x"), (8, "z"), (7, "Z"), (None, "new"), (2, None)]
    kept = digest_index.drop_copies(frame(spark, second), again, "two")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 8, None] and kept.columns == ["doc_id", "text", "digest", "keep_id"]
    before = again.rows().count(), again.rows("repeats").count()
    again.add(digest_index.digests(frame(spark, second)), "two")
    assert (again.rows().count(), again.rows("repeats").count()) == before == (5, 1)
    sizes = {r.keep_id: r.group_size for r in again.groups().collect()}
    assert sizes == {5: 3, 3: 2, 8: 2, None: 1, 2: 1}


def test_the_anti_join_reads_buckets_without_a_shuffle(spark, tmp_path):
    index = DigestIndex.create(spark, f"file://{tmp_path}/index", 100)
    index.add(digest_index.digests(frame(spark, [(k, f"text {k}") for k in range(50)])), "one")
    staged = index.rows("digests").select("digest").alias("a").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
