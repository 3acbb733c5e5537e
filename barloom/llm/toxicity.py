"""Toxicity by a linear-chain conditional random field over words.

1. Training documents give evidence: how much more often a word, or its first letters, stands in toxic documents
   than in others.  Words with strong evidence in toxic documents are the labelled tokens.
2. A two-state chain (plain, toxic) is trained on windows of words: its inputs are evidence levels.  Each half of the
   documents is looked at with the evidence of the other half, so no document vouches for itself.
3. Forward-backward gives every word's marginal; a logistic curve fitted on the same looks turns a document's
   marginals into its score, and words of high marginal are the offending spans.  Scoring uses the evidence of both
   halves, the stronger where both have it, so that levels mean the same as in training.

A word without evidence is one and the same input, so runs of them are powers of one 2x2 matrix: the chain is exact over
whole texts, and the work goes by the words that matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, slices

#: labelled rows of each class that training takes at most (a hash of the id picks them)
MAX_ROWS = 10_000
#: evidence features kept, strongest first
MAX_FEATURES = 20_000
#: windows of this many words that the chain is trained on, and their number of each class of document
WINDOW, MAX_WINDOWS = 24, 3_000
MIN_COUNT = 3
#: lower bounds of a feature's log odds (CAUTION standard errors below the estimate) that make its level
LEVELS = (1.0, 2.0, 3.0, 4.0)
CAUTION = 1.5
#: level from which a word of a toxic document is labelled toxic (the highest there is, if none reaches it)
STRONG = 3
PREFIXES = (4, 5, 6)
MEMORY = 250_000
EPOCHS = 150
#: of a marginal, to be an offending span
SPAN = 0.5
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def features_of(token: str) -> list[str]:
    """The word itself and its first letters, each marked by kind."""
    word = token.strip(STRIP)
    return [f"w{word}", *[f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n]] if word else []


class Buckets:
    """Evidence bucket of a token: (word level, prefix level) as one number, 0 for none."""

    def __init__(self, levels: dict[str, int]):
        self.levels = levels
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> list[int]:
        if len(self.known) > MEMORY:
            self.known = {}
        get = self.known.get
        out = [get(t, -1) for t in tokens]
        if -1 in out:
            for k, code in enumerate(out):
                if code < 0:
                    out[k] = self.known[tokens[k]] = self._bucket(tokens[k])
        return out

    def _bucket(self, token: str) -> int:
        found = features_of(token)
        if not found:
            return 0
        word = self.levels.get(found[0], 0)
        return word * (len(LEVELS) + 1) + max((self.levels.get(f, 0) for f in found[1:]), default=0)


N_BUCKETS = (len(LEVELS) + 1) ** 2


def tokens_of(text: str) -> list[str]:
    return text.lower().split()


def train_chain(codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, epochs: int = EPOCHS, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(state weights [2, buckets], transition weights [2, 2]) by maximum likelihood with Adam.

    ``codes`` and ``labels`` are [sequences, steps], padded beyond ``lengths``.
    """
    n, steps = codes.shape
    mask = np.arange(steps) < lengths[:, None]
    onehot = np.eye(2)[labels] * mask[:, :, None]
    seen = np.zeros((2, N_BUCKETS))
    np.add.at(seen.T, codes.ravel(), onehot.reshape(-1, 2))
    pairs = np.einsum("nti,ntj->ij", onehot[:, :-1], onehot[:, 1:])
    w, t = np.zeros((2, N_BUCKETS)), np.zeros((2, 2))
    moments = [np.zeros_like(x) for x in (w, w, t, t)]
    for step in range(1, epochs + 1):
        phi, psi = np.exp(w.T[codes]) * mask[:, :, None], np.exp(t)
        alpha, beta = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        a = phi[:, 0]
        alpha[0] = a / a.sum(1, keepdims=True)
        for k in range(1, steps):
            a = alpha[k - 1] @ psi * phi[:, k]
            s = a.sum(1, keepdims=True)
            alpha[k] = np.where(mask[:, k, None], a / np.where(s > 0, s, 1), 0)
        b = np.ones((n, 2))
        for k in range(steps - 1, -1, -1):
            b = np.where((k == lengths - 1)[:, None], 1.0, b)
            beta[k] = b
            b = (b * phi[:, k]) @ psi.T
            b /= np.maximum(b.sum(1, keepdims=True), 1e-300)
        gamma = alpha * beta
        gamma = gamma / np.maximum(gamma.sum(-1, keepdims=True), 1e-300) * mask.T[:, :, None]
        xi = alpha[:-1, :, :, None] * psi * (phi.transpose(1, 0, 2)[1:] * beta[1:])[:, :, None, :]
        xi = xi / np.maximum(xi.sum((-1, -2), keepdims=True), 1e-300) * mask.T[1:, :, None, None]
        expected = np.zeros((2, N_BUCKETS))
        np.add.at(expected.T, codes.T.ravel(), gamma.reshape(-1, 2))
        for x, grad, m, v in ((w, (expected - seen) / n + l2 * w, *moments[:2]), (t, (xi.sum((0, 1)) - pairs) / n + l2 * t, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, t


class Chain:
    """Exact marginals of the toxic state at words with evidence."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.phi = np.exp(w - w.max(0)).T
        self.psi = np.exp(t - t.max())
        self.plain = self.psi * self.phi[0]  # one step onto a plain word
        self.powers: dict[int, np.ndarray] = {}

    def _run(self, k: int) -> np.ndarray:
        """k steps onto plain words, scaled."""
        if k not in self.powers:
            out, base, left = np.eye(2), self.plain / self.plain.max(), k
            while left:
                if left & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                left >>= 1
            if len(self.powers) > 10_000:
                self.powers = {}
            self.powers[k] = out
        return self.powers[k]

    def marginals(self, places: list[int], codes: list[int], length: int) -> np.ndarray:
        """P(toxic) at ``places`` (ascending), whose buckets are ``codes``; all other words are plain."""
        ahead, a, before = [], None, -1
        for place, code in zip(places, codes, strict=True):
            gap = place - before - 1
            if a is None:
                a = np.ones(2) if gap == 0 else self.phi[0] @ self._run(gap - 1)
                a = self.phi[code] * (a if gap == 0 else a @ self.psi)
            else:
                a = a @ self._run(gap) @ self.psi * self.phi[code]
            a = a / a.sum()
            ahead.append(a)
            before = place
        out, b, after = np.zeros(len(places)), None, length
        for k in range(len(places) - 1, -1, -1):
            gap = after - places[k] - 1
            if b is None:
                b = self._run(gap) @ np.ones(2)
            else:
                b = self._run(gap) @ (self.psi @ (self.phi[codes[k + 1]] * b))
            b = b / b.sum()
            g = ahead[k] * b
            out[k] = g[1] / g.sum()
            after = places[k]
        return out


def _summary(marginals: np.ndarray, words: list[str]) -> list[float]:
    """What a document's score looks at: the expected number of toxic words, and the best words of different spelling."""
    best: dict[str, float] = {}
    for m, word in zip(marginals, words, strict=True):
        best[word] = max(best.get(word, 0.0), float(m))
    top = sorted(best.values(), reverse=True)[:3] + [0.0] * 3
    return [math.log1p(float(marginals.sum())), *top[:3]]


def _fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + l2 * w)
        w -= np.clip(step, -5, 5)
    return w


_RESULT = "struct<x:array<double>,spans:array<struct<start:int,stop:int,marginal:double>>>"


def _summaries(docs: DataFrame, model, into: str = "crf") -> DataFrame:
    """``docs`` with a struct column: what the score looks at (x) and the offending spans of the text."""
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")

    def run(batches):
        import re

        import pyarrow as pa

        levels, w, t = model.value
        buckets, chain = Buckets(levels), Chain(w, t)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
        kind = pa.struct([("x", pa.list_(pa.float64())), ("spans", span)])
        for batch in slices(batches):
            rows = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                tokens = tokens_of(text or "")
                codes = buckets.of(tokens)
                places = [k for k, c in enumerate(codes) if c] if any(codes) else []
                marginals = chain.marginals(places, [codes[k] for k in places], len(tokens)) if places else np.zeros(0)
                high = {p: float(m) for p, m in zip(places, marginals, strict=True) if m >= SPAN}
                spans = [{"start": m.start(), "stop": m.end(), "marginal": high[k]} for k, m in enumerate(re.finditer(r"\S+", text)) if k in high] if high else []
                rows.append({"x": _summary(marginals, [tokens[k].strip(STRIP) for k in places]), "spans": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{into}` {_RESULT}"])
    return docs.mapInArrow(run, schema)


def _evidence(docs: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many documents of either class a feature stands; summed per Arrow batch first."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in slices(batches):
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({f for token in set(tokens_of(text or "")) for f in features_of(token)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())],
                names=["feature", "toxic", "clean"],
            )

    rows = docs.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def window_starts(codes: list[int]) -> list[int]:
    """Where the windows of a text start: every place with evidence lies in one, and the first one is always there."""
    return sorted({0} | {k // WINDOW * WINDOW for k, c in enumerate(codes) if c}) if codes else []


def _windows(docs: DataFrame, levels) -> DataFrame:
    """(codes, labels, toxic, doc, at) of windows of words: those with evidence, and one at the start of each document."""

    def run(batches):
        import pyarrow as pa

        buckets = Buckets(levels.value)
        size = len(LEVELS) + 1
        strong = min(STRONG, max(levels.value.values(), default=1))
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, toxic, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                codes = buckets.of(tokens_of(text or ""))
                for at in window_starts(codes):
                    part = codes[at : at + WINDOW]
                    rows.append((part, [int(toxic and (c // size >= strong or c % size >= strong)) for c in part], toxic, doc, at))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["codes", "labels", "toxic", "doc", "at"])

    return docs.select("text", "toxic", F.xxhash64("doc_id").alias("doc")).mapInArrow(run, "codes array<int>, labels array<int>, toxic int, doc long, at long")


def _sampled(labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, toxic, half) of at most about ``max_rows`` ids of each class, by a hash of the id."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in one.groupBy("toxic").count().collect()}
    share = F.lit(0)
    for toxic, n in counts.items():
        share = F.when(F.col("toxic") == toxic, int(min(1.0, max_rows / n) * 2**20)).otherwise(share)
    mark = F.xxhash64("doc_id")
    return one.where(F.pmod(mark, F.lit(2**20)) < share).select("doc_id", "toxic", F.pmod(F.shiftright(mark, 24), F.lit(2)).alias("half"))


def _levels(train: DataFrame) -> dict[str, int]:
    """Evidence level by feature, from the rows of ``train`` (text, toxic); empty if a class is missing."""
    counts = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / counts[1] / ((F.col("clean") + 0.5) / counts[0]))
    odds -= CAUTION * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = _evidence(train).where(F.col("toxic") >= MIN_COUNT).withColumn("odds", odds).where(F.col("odds") >= LEVELS[0])
    top = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(MAX_FEATURES).select("feature", "odds").collect()
    return {r[0]: sum(r[1] >= x for x in LEVELS) for r in top}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """Model (levels, state weights, transitions, curve) from labelled rows; None if a class is missing.

    ``labels`` has doc_id, toxic (0 or 1).  Training takes at most about ``max_rows`` ids of each class, by a hash of the
    id, so what is broadcast and collected here has a fixed bound; of these, the chain sees at most MAX_WINDOWS
    windows of each class, by a hash of document and place, and the MAX_FEATURES strongest features count.  All is
    drawn by hashes, so any partitioning gives the same model.  If a half of the documents lacks a class, all documents
    are looked at with the evidence of all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    sample = _sampled(labels, max_rows)
    train = scratch.put(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic", "half"), "train")
    counts = {(r[0], r[1]): r[2] for r in train.groupBy("half", "toxic").count().collect()}
    if not all(counts.get((0, k)) or counts.get((1, k)) for k in (0, 1)):
        scratch.drop(train)
        return None
    crossed = all(counts.get((h, k)) for h in (0, 1) for k in (0, 1))
    looks = [(train.where(F.col("half") == 1 - h), _levels(train.where(F.col("half") == h))) for h in (0, 1)] if crossed else [(train, _levels(train))]
    levels = {f: max(known.get(f, 0) for _, known in looks) for f in set().union(*(known for _, known in looks))}
    shared = [(part, spark.sparkContext.broadcast(known)) for part, known in looks]
    rows = []
    for part, known in shared:
        found = _windows(part, known).withColumn("mark", F.xxhash64("doc", "at"))
        for toxic in (0, 1):
            rows += found.where(F.col("toxic") == toxic).orderBy("mark", "codes").limit(MAX_WINDOWS // len(shared)).collect()
    lengths = np.array([len(r["codes"]) for r in rows], np.int64)
    codes, marks = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, r in enumerate(rows):
        codes[k, : lengths[k]], marks[k, : lengths[k]] = r["codes"], r["labels"]
    w, t = train_chain(codes, marks, lengths)
    seen = [r for part, known in shared for r in _summaries(part, spark.sparkContext.broadcast((known.value, w, t))).select("doc_id", "crf.x", "toxic").collect()]
    seen.sort(key=lambda r: (r["doc_id"], r["x"]))
    curve = _fit_logistic(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen]))
    scratch.drop(train)
    return levels, w, t, curve


def annotate(docs: DataFrame, model, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``into``: score (0 to 1) and spans (code-point ranges with their marginal).

    Whole texts count.  Null or empty text has no words and gets the score of a text without evidence.  Rows are
    independent, and other columns pass through.  Without a model (a class has no labels) every score is 0.
    """
    if model is None:
        none = F.array().cast("array<struct<start:int,stop:int,marginal:double>>")
        return docs.withColumn(into, F.struct(F.lit(0.0).alias("score"), none.alias("spans")))
    levels, w, t, curve = model
    found = _summaries(docs, docs.sparkSession.sparkContext.broadcast((levels, w, t)), into)
    z = F.lit(float(curve[-1]))
    for k, c in enumerate(curve[:-1]):
        z = z + F.col(into)["x"][k] * float(c)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.withColumn(into, F.struct(score.alias("score"), F.col(into)["spans"].alias("spans")))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row, trained on labels outside the held-out third.

    A null doc_id is not held out; null and empty texts are scored as texts without evidence; repeated rows give
    repeated results; an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", "text")
    scored = annotate(texts, fit(texts, labels.where(fold(F.col("doc_id"), 3) != 1))).select("doc_id", "toxicity.*")
    predicted = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "spans")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` whose score stays below ``threshold``, with their columns as they were.

    Null and empty texts are scored as texts without evidence; an empty table, or labels without both classes, drop nothing.
    """
    model = fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return annotate(docs, model, "__toxicity").where(F.col("__toxicity.score") < threshold).drop("__toxicity")
