"""Filter interactions against SQL and against a plain replay of every order."""

from __future__ import annotations

from itertools import permutations

from barloom.llm import filteraudit, queries

from ..oracle import difference


def test_against_sql(spark, small):
    assert difference(queries.op12_filter_interaction(spark, small), queries.OP12_SQL, small) is None


def replay(rows, labels):
    """Every order walked document by document."""
    fails = []
    for i, t, _ in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in t).split(" ") if w]
        failed = set()
        failed |= {"A"} if len(words) < 50 else set()
        failed |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        failed |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        failed |= {"E"} if any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        fails.append(failed)
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(f, rows[k][0]) for k, f in enumerate(fails) if (rows[k][2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                here = [(f, i) for f, i in left if x in f]
                lost = [sum(any(row[0] == i and i is not None and row[at] == 1 for row in labels) for _, i in here) for at in (1, 2)]
                failing = sum(x in f for f, _ in mine)
                left = [(f, i) for f, i in left if x not in f]
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), sum(f == {x} for f, _ in mine), *lost]
                total[x] += len(here)
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(total[x])
    return out


def test_odd_rows(spark):
    clean = " ".join(f"wörd{k}" for k in range(60))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "", None), (4, clean, "a"), (5, clean, ""), (5, clean, "b"), (6, clean + " #", "b"), (7, "A B c\td", "b"),
        (None, clean, "b"), (None, None, None), (8, "ab " * 300_000, "c"), (9, "ab " * 300_000, "c"), (10, clean + "\v\x1c\x85 x", "c"), (10, "TWO " * 60, "c"), (4, clean, "a"),
    ]
    labels = [(4, 1, 0), (4, None, 1), (5, 1, 1), (7, None, None), (8, 0, 1), (9, 1, 0), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, mask int, filter_order string")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = replay(rows, labels)
    audited = filteraudit.audit(docs, frame)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audited.collect()}
    assert got == want and audited.count() == 600 * 4
    assert filteraudit.audit(docs.limit(0), frame).count() == 0
    assert filteraudit.audit(docs, frame.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
