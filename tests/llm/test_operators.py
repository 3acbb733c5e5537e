"""The training-data operators against SQL, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, decontam, lm, neardup, queries, spm, tokencount, toxicity
from tests.oracle import difference


@pytest.mark.parametrize("name", ["op1_html_extraction", "op2_chat_formatting", "op8_decontamination", "op9_url_filters"])
def test_against_sql(spark, small, name):
    assert difference(queries.queries()[name](spark, small), queries.oracle_sql()[name], small) is None


def test_near_duplicates_by_brute_force(spark):
    """A group of near copies that change a few words each, exact copies, repeated rows, nulls and empty texts."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 500, 60)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[at] = f"v{rng.integers(0, 30)}"
        docs.append((k, " ".join(words)))
    docs += [(100, docs[0][1].upper()), (101, "one two"), (102, "one  two"), (103, None), (104, " "), (101, "one two"), (None, "x y z")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    sets = {}
    for k, t in docs:
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    comp = {k: k for k in sets if k is not None}
    for _ in comp:
        for a in comp:
            for b in comp:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {k: v for k, v in got.items() if k is not None} == {k: (len(sets[k]), c, c == k) for k, c in comp.items()}
    assert got[None] == (1, None, True)


def test_lm_base_counts_and_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    got = lm.score_documents(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k, t in texts.items() if not held[k] for w in [*lm.words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*lm.words_of(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0


def test_lm_gradient_and_fast_path():
    counts = np.random.default_rng(0).integers(0, 50, 900).astype(float)
    layout = lm.Layout(counts, np.zeros(900, bool))
    net = lm.Attention(layout)
    ids = np.random.default_rng(1).integers(0, 899, 75)
    ends = np.array([30, 31, 75])
    inputs, targets, places = lm.windows(ids, ends, layout)
    assert sorted(places[places >= 0]) == list(range(75))
    slot = layout.slot[targets]
    group, slot, weights = slot // lm.SLOTS, slot % lm.SLOTS, (places >= 0).astype(np.float32)
    slow, _ = net.forward(inputs, group, slot)
    assert np.abs(slow - net.score(inputs, group.astype(np.uint8), slot, net.scoring_tables())).max() < 1e-4
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    _, grads = net.gradient(inputs, group, slot, weights)
    for name in ("wq", "wv", "w1", "ug", "near"):
        x = net.p[name]
        at = np.unravel_index(np.argmax(np.abs(grads[name])), x.shape)
        h = 1e-3
        x[at] += h
        up = net.gradient(inputs, group, slot, weights)[0]
        x[at] -= 2 * h
        down = net.gradient(inputs, group, slot, weights)[0]
        x[at] += h
        assert (up - down) / (2 * h) == pytest.approx(grads[name][at], rel=0.05, abs=5e-5)  # the softmax buffer is 32-bit


def test_pieces_round_trip_and_parity(spark):
    texts = ["Hello  world", "", None, " lead", "tail ", "漢字 🙂 \u0007", "a" * 5000, "▁ marker", "x\n\ny\tz"]
    got = spm.annotate(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert all(r.pieces.parity for r in got)
    assert [r.pieces.n_tokens for r in got][1:3] == [0, 0]
    assert all(r.pieces.round_trip for r in got if r.text != "▁ marker")


def test_token_tree_after_edits_counts_as_anew():
    rng = np.random.default_rng(4)
    counter = tokencount.load()
    text = "The quick brown fox's 12 jumps,  over\n\n the lazy dog. " * 40
    tree = tokencount.TokenTree(text, counter)
    for _ in range(60):
        a, b = sorted(rng.integers(0, len(text) + 1, 2))
        b = min(b, a + 30)
        new = "".join(rng.choice(list(" abc'1\n"), int(rng.integers(0, 9))))
        tree.edit(int(a), int(b), new)
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.total == len(counter.encoding.encode_ordinary(text))


def test_neighbours_recall_and_ties(spark, small):
    vectors = ann.valid_vectors(spark.read.parquet(f"{small}/embeddings.parquet"))
    got = {}
    for r in ann.nearest(vectors, vectors.where("id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = vectors.collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.v for r in rows])
    hits = total = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {v for v, _ in found})
        total += len(order)
    assert len(got) == (ids % 20 == 0).sum() and hits / total >= 0.9


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("score", "toxic").collect()
    good, bad = [r.score for r in seen if r.toxic == 0], [r.score for r in seen if r.toxic == 1]
    assert np.mean([[b > g for g in good] for b in bad]) > 0.9
    none = toxicity.score_documents(docs.limit(3), labels.where("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_tokens string, score string")
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    assert neardup.near_duplicates(empty).count() == 0
    assert decontam.contamination(empty, items).count() == 0
    assert tokencount.count_with_edits(empty).count() == 0
    assert spm.annotate(empty).count() == 0
    with pytest.raises(ValueError):
        spm.annotate(empty.withColumn("pieces", F.lit(1)))


def test_pipeline_keeps_columns_and_drops_copies(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = corpus_pipeline.run(spark, small)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert out.count() == out.select("text").distinct().count() and 0 < out.count() < docs.count()
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontam.contamination(out.select("doc_id", "text"), items).where("contaminated").count() == 0


def test_two_texts_under_one_id_lose_no_links(spark):
    words = lambda mark, n: " ".join(f"{mark}{k}" for k in range(n))
    a, b = words("a", 40), words("b", 40)
    rows = [(5, a), (5, b), (7, a + " one"), (9, b + " one"), (9, b + " one"), (11, "few"), (11, "other"), (12, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(4)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (11, 11, True), (11, 11, True), (12, 12, True)]
    left = sorted((r.doc_id, r.text or "") for r in neardup.drop_near_duplicates(docs, 3, 85).collect())
    assert left == [(5, a), (5, b), (11, "few"), (11, "other"), (12, "")]
    near = spark.createDataFrame([(5, a), (5, a + " one"), (3, a + " two"), (3, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(near, 3, 85).collect()) == [(3, a + " two"), (3, b)]
