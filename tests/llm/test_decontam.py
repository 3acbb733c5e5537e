"""Chunks and runs against every window by brute force."""

from __future__ import annotations

import numpy as np

from barloom.llm import decontam


def _brute(words, items, window):
    hit, found = set(), set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if size else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == item[i : i + size]:
                    found.add(k)
                    hit.update(range(at, at + size))
    return hit, found


def test_runs_against_all_windows():
    rng = np.random.default_rng(5)
    for case in range(60):
        window = int(rng.choice([3, 4, 10]))
        items = [[f"w{x}" for x in rng.integers(0, 4 if case % 2 else 30, int(rng.integers(0, 35)))] for _ in range(6)]
        words = [f"w{x}" for x in rng.integers(0, 4 if case % 2 else 30, 60)]
        for _ in range(3):
            item = items[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 20))
            words[int(rng.integers(0, 60)) :][:0] = item[a : a + int(rng.integers(1, 25))]
        built = decontam.build_automaton([(str(k), " ".join(i)) for k, i in enumerate(items)], window)
        n, ranges, found = decontam.scan_text(" ".join(words).encode(), built)
        hit, who = _brute(words, items, window)
        assert (n, {k for a, b in ranges for k in range(a, b)}, found) == (len(words), hit, who)


def test_odd_rows_and_blocks(spark):
    items = spark.createDataFrame([("a", "one two three"), ("b", " ".join(f"x{k}" for k in range(30))), ("b", " ".join(f"x{k}" for k in range(30))), ("c", None), (None, "four"), ("d", "--")], "item_id string, text string")
    long = "y " * 100_000 + " ".join(f"X{k}" for k in range(5, 20)) + " ONE, two; three"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "one two three")]
    docs = spark.createDataFrame([(*r, "c", 3) for r in rows], "doc_id long, text string, n_hit string, items int")
    one = decontam.annotate(docs, items)
    assert one.columns == [*docs.columns, "decontam"]
    many = decontam.annotate(docs, items, block_bytes=20)
    for found in (one, many):
        got = {r.doc_id: (r.decontam.n_words, r.decontam.n_hit, r.decontam["items"]) for r in found.collect()}
        assert got == {1: (0, 0, []), 2: (0, 0, []), 3: (100_018, 18, ["a", "b"]), None: (3, 3, ["a"])}
        assert found.count() == len(rows)
    spans = next(r for r in one.collect() if r.doc_id == 3).decontam.spans
    assert [long[s.start : s.stop] for s in spans] == [long[200_000:]]
    assert decontam.annotate(docs, items.limit(0)).where("decontam.n_hit > 0").count() == 0
    assert decontam.annotate(docs.limit(0), items).count() == 0
    assert decontam.drop_contaminated(docs, items).select("doc_id").collect() == [(1,), (2,)]
