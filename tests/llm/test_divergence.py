"""Source divergence against SQL and against plain whole-number loops."""

from __future__ import annotations

import random
import re
from collections import Counter

from barloom.llm import divergence, queries

from ..oracle import difference


def test_against_sql(spark, small):
    assert difference(queries.op13_source_divergence(spark, small), queries.OP13_SQL, small) is None


def brute(rows, min_docs, top):
    docs = []
    for text, lang, source in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))))
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in seen if seen[t] >= min_docs)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for d in mine:
            counts[d[1]].update({t: n for t, n in d[2].items() if seen[t] >= min_docs})
        whole = sum(counts.values(), Counter())
        v, total = len(kept), {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: share(c[t], total[s], v) for t in kept} for s, c in counts.items()}
        q = {t: share(whole[t], sum(total.values()), v) for t in kept}
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, value, k) for k, (i, value) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_odd_rows(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = ["der", "Die", "das", "été", "naïve", "x", "ÉTÉ", "don't", "a1b", "日本", "🙂z", "Straße", " w"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(draw.choices(vocabulary, k=draw.randrange(1, 30))), draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "é", None])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "en", "silent"), ("rare words only", "fr", "a"), ("others here", "fr", "b"), (None, "xx", "lone"), rows[0], rows[0]]
    rows += [("Die der " * 200_000, "en", "long"), ("der\x0bDie\x1c" * 9, "de", "a")]
    docs = spark.createDataFrame([(k, *r, 1, "x") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string")
    got = divergence.divergence(docs.repartition(5), min_docs=10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 10)
    assert divergence.divergence(docs.limit(0)).count() == 0
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)  # the way of many groups
    assert sorted(tuple(r) for r in divergence.divergence(docs, min_docs=3, top=2).collect()) == brute(rows, 3, 2)


def test_pieces_and_handing_on(spark, monkeypatch):
    rows = [("ab cd ab " * 50, "en", "a"), ("cd ef", "en", "b"), ("ab " * 400, "en", "b")]
    monkeypatch.setattr(divergence, "CHUNK_BYTES", 64)
    monkeypatch.setattr(divergence, "HELD_ROWS", 2)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    held = Counter()
    for out in divergence._counted(iter([batch])):
        for r in out.to_pylist():
            held[r["lang"], r["source"], r["term"], "n"] += r["n"]
            held[r["lang"], r["source"], r["term"], "df"] += r["df"]
    assert held["en", "a", "ab", "n"] == 100 and held["en", "a", "ab", "df"] == 1 and held["en", "b", "ab", "n"] == 400
    assert held["en", "b", "ab", "df"] == 1 and held["en", "b", "cd", "df"] == 1 and ("en", "a", None, "n") in held
