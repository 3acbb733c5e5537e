"""The score of whole texts by a plain loop over places, rounds of training by tasks, and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest

from barloom.llm import lm
from barloom.llm.common import Scratch


def _docs(spark, n=80):
    rng = np.random.default_rng(3)
    words = np.array([f"word{k}" if k % 3 else f"Süß{k}-x" for k in range(300)])
    rows = [(k, " ".join(words[np.minimum(rng.zipf(1.4, int(rng.integers(1, 120))), 300) - 1])) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _plain(text: bytes, model: dict, counts: dict, path: str) -> float:
    """log10 probability, place by place."""
    lay, p = model["layout"], {k: x.astype(float) for k, x in model["net"].p.items()}
    spell, words = lm.spelling(path), lm.words_of(text)
    ids, owner = [], []
    for k, w in enumerate(words):
        flat, _ = spell.of([w])
        ids += flat.tolist()
        owner += [k] * len(flat)
    ids, owner = [*ids, lay.end], [*owner, len(words)]
    spelled = np.zeros(len(words) + 1)
    inputs = [lay.begin, *(int(lay.input[i]) for i in ids[:-1])]
    for at, target in enumerate(ids):
        first = max(0, at // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
        q = p["embed"][inputs[at]] @ p["wq"]
        s = [math.exp(min(q @ (p["embed"][inputs[k]] @ p["wk"]) + p["near"][at - k], 60)) for k in range(first, at + 1)]
        o = sum(a * (p["embed"][inputs[k]] @ p["wv"]) for a, k in zip(s, range(first, at + 1), strict=True)) / sum(s)
        h = np.maximum(np.concatenate([p["embed"][inputs[at]], o]) @ p["w1"] + p["b1"], 0)
        g, slot = divmod(int(lay.slot[target]), lm.SLOTS)
        groups, slots = h @ p["ug"] + p["bg"], h @ p["us"][g] + p["bs"][g]
        spelled[owner[at]] += groups[g] - math.log(np.exp(groups).sum()) + slots[slot] - math.log(np.exp(slots).sum()) + lay.inside[target]
    c = [counts.get(w, 0) for w in words] + [counts[None]]
    return sum(math.log10(model["share"] * x / model["listed"] + (1 - model["share"]) * math.exp(y)) for x, y in zip(c, spelled, strict=True))


def test_score_by_a_plain_loop(spark, monkeypatch):
    kept = []
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    monkeypatch.setattr(lm, "STEPS", 60)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "never seen wörds"), (1002, "word1"), (None, "word1 word2"), (1003, "word1 " * 50_000)], "doc_id long, text string")
    docs = _docs(spark).unionByName(odd)
    more = docs.selectExpr("*", "'x' as score", "1 as n_tokens")
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(more, table_words=40).collect()}
    model, counts = kept[0]
    known = {r.word.encode() if r.word is not None else None: r.c for r in counts.collect()}
    assert len(got) == docs.count()
    for r in docs.where("doc_id is null or doc_id % 9 = 1 or doc_id in (1000, 1001, 1002)").collect():
        text = (r.text or "").encode()
        assert got[r.doc_id, len(text.split()) + 1] == pytest.approx(_plain(text, model, known, lm.VOCABULARY), rel=1e-3)
    assert lm.score_documents(docs.limit(0)).count() == 0


def test_rounds_of_tasks_learn(spark):
    docs = _docs(spark, 400).selectExpr("text", "false as aside")
    scratch = Scratch(spark, "test")
    counts = lm.count_words(docs)
    by_id = np.zeros(lm.spelling().size + 1)
    for r in lm._id_counts(counts, lm.VOCABULARY).collect():
        by_id[r["id"]] = r["n"]
    layout = lm.Layout(by_id, np.append(lm.spelling().opens, True))
    lay = spark.sparkContext.broadcast(layout)
    found = scratch.put(lm._sample_windows(docs.repartition(5), lay, lm.VOCABULARY), "windows")
    net, looked = lm.Attention(layout), lm._arrays(found, layout)
    losses = [net.loss(*looked)]
    for _ in range(3):
        lm._round(found, net, lay, 0.01)
        losses.append(net.loss(*looked))
    assert all(b < a for a, b in zip(losses[:-1], losses[1:], strict=True))


def test_scores_do_not_hang_on_the_partitioning(spark, monkeypatch):
    """Files, tasks and batches may fall anywhere: the same texts give the same model."""
    monkeypatch.setattr(lm, "STEPS", 60)
    monkeypatch.setattr(lm, "SHARD_WINDOWS", 200)
    docs = _docs(spark, 400)
    told = []
    for n, rows in ((2, 10_000), (16, 300)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            told.append({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n, "text"), table_words=40).collect()})
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(told[0]) == 400
    assert max(abs(told[0][k] - told[1][k]) for k in told[0]) < 1e-4


def test_every_training_text_is_in_a_round(spark, monkeypatch):
    """Texts of one window each, more than the driver or a share would take."""
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "TRAIN_WINDOWS", 300)
    told, step = [], lm._round
    monkeypatch.setattr(lm, "_round", lambda found, *a, **b: told.append(found.count()) or step(found, *a, **b))
    docs = spark.range(5000).selectExpr("concat('w', id % 4500, ' x') as text")
    lm.fit(docs, Scratch(spark, "test"), table_words=40)
    assert sum(told) == docs.distinct().where("pmod(shiftright(xxhash64(text), 20), 10) <> 0").count()


def test_mean_loss_by_tasks(spark):
    docs = _docs(spark, 60).selectExpr("text", "true as aside")
    by_id = np.bincount(np.arange(3000), minlength=lm.spelling().size + 1).astype(float)
    layout = lm.Layout(by_id, np.append(lm.spelling().opens, True))
    net, lay = lm.Attention(layout), spark.sparkContext.broadcast(layout)
    looked = lm._arrays(lm._sample_windows(docs, lay, lm.VOCABULARY), layout)
    assert lm._mean_loss(docs.repartition(3), net, lay, lm.VOCABULARY) == pytest.approx(net.loss(*looked), rel=1e-4)
    assert lm._mean_loss(docs.limit(0), net, lay, lm.VOCABULARY) == 0


def test_weight_fit_reads_the_texts_kept_aside_once(spark, monkeypatch):
    """Every text is spelled once for training and once for the weight, and the weight is that of a plain count."""
    docs = _docs(spark, 60).selectExpr("text", "true as aside").cache()
    scratch = Scratch(spark, "test")
    counts = scratch.put(lm.count_words(docs), "counts")
    known = {r.word.encode() if r.word is not None else None: r.c for r in counts.collect()}
    layout = lm.Layout(np.bincount(np.arange(3000), minlength=lm.spelling().size + 1).astype(float), np.append(lm.spelling().opens, True))
    table = dict(sorted(((w, c) for w, c in known.items() if w), key=lambda x: -x[1])[:40]) | {None: known[None]}
    model = {"layout": layout, "net": lm.Attention(layout), "table": table, "share": 0.5, "listed": sum(known.values()), "total": 1, "v": 1}
    ran = spark.sparkContext.accumulator(0)
    tokens = lm.text_bytes
    monkeypatch.setattr(lm, "text_bytes", lambda column: ran.add(len(column)) or tokens(column))
    share = lm._fit_share(docs, counts, model, lm.VOCABULARY, scratch)
    scorer, ratio = lm.Scorer(model, lm.VOCABULARY), []
    for r in docs.collect():
        text = r.text.encode()
        words = lm.words_of(text)
        said = scorer.tokens([text])[4]
        for w, y in zip([*words, None], said, strict=True):
            rest = known[w] - (words.count(w) if w is not None else 1)
            ratio.append(math.exp((math.floor((math.log(rest / model["listed"]) - max(y, -600)) * 100) + 0.5) / 100) if rest > 0 else 0.0)
    ratio, plain = np.array(ratio), 0.5
    for _ in range(30):
        plain = float(np.mean(plain * ratio / (plain * ratio + 1 - plain)))
    assert ran.value == docs.count()
    assert share == pytest.approx(plain, rel=1e-3)
