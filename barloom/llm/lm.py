"""Language-model scoring: a causal self-attention model trained in numpy on subword ids.

1. Spark counts every word and every end of the training texts, and from these every subword id.
2. One attention layer is trained on the windows of all training texts (equal texts count once).  The driver only finds a
   point to start from, on a bounded part; then tasks go on from there, each on a shard of texts dealt by their hashes, and
   the shards' steps are averaged, round by round, until every text was in one round.  A tenth of the texts is kept
   aside: on windows of it the start stops early, on all of it a round that does not help is undone and the weight of the
   table is fitted.  The softmax has two levels, groups and slots: frequent ids have a slot of their own, the others
   share slots and are told apart by their counts.
3. Texts are cut into overlapping windows: the first CONTEXT places of a window only give context, each of the other
   places is scored once, all windows of a chunk in one batched, masked attention.
4. The attention layer spells every word; with a fitted weight a word may also come from the table of all counted
   words, by its count.  Workers hold the frequent words of it; the counts of the others are joined, with
   what the layer says of each.  So every text has a probability, and they sum to one at most.

A subword sequence per word comes from a public byte-level vocabulary whose place is a parameter.
"""

from __future__ import annotations

import base64
import math
import threading
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, Scratch, fold, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: words that the broadcast table of frequent words holds at most
TABLE_WORDS = 1 << 17
#: ids with an input vector of their own (the most frequent; others share the last one)
INPUTS = 4096
GROUPS, SLOTS = 32, 16
DIM, KEY, HIDDEN = 32, 8, 48
#: places of a window that only give context, and places that are scored
CONTEXT, STRIDE = 8, 16
WIDTH = CONTEXT + STRIDE
#: of the driver's start: windows and steps at most, windows of a step, steps between looks at the texts kept aside, and
#: looks without gain after which it stops
TRAIN_WINDOWS, STEPS, BATCH, LOOK, PATIENCE = 48_000, 750, 256, 50, 3
#: rounds in which tasks train on shards, and parts that their steps are summed in
ROUNDS, PARTS, PIECE = 2, 64, 8192
#: windows that a shard of a round is meant to hold
SHARD_WINDOWS = 16_384
#: one text in so many is kept aside; windows of them that the driver looks at
ASIDE, ASIDE_WINDOWS = 10, 4_000
RATE, ROUND_RATE = 0.02, 0.003
#: weight of the table of counted words where nothing is kept aside to fit it on
TABLE_WEIGHT = 0.25
#: words a worker remembers, and distinct words a counting task holds; both are emptied when full
MEMORY, COUNTED = 400_000, 300_000
#: windows scored at once
CHUNK = 256
LOG10 = math.log(10)

#: rows of one id that are added one after the other; more are added at once
FEW = 8

_loaded: dict = {}
_rooms = threading.local()


def _room(name: str, *shape: int, kind=np.float32) -> np.ndarray:
    """An array with the memory of the last one of this name: fresh pages for every batch cost as much as the work on them."""
    size, rooms, key = math.prod(shape), _rooms.__dict__, f"{name} {np.dtype(kind)}"
    if key not in rooms or rooms[key].size < size:
        rooms[key] = np.empty(size, kind)
    return rooms[key][:size].reshape(shape)


#: sums of exponentials that 32 bits lose
_LEAST = np.float32(1e-37)
#: numpy compares with an array faster than with a number
_ZEROS = np.zeros((max(BATCH, CHUNK) * STRIDE, HIDDEN), np.float32)


def _below(x: np.ndarray, most: float) -> None:
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in the order of their ids, where each id begins in it, distinct ids, which of these stands at a place)."""
    flat = ids.astype(np.uint16).ravel()
    by = np.argsort(flat, kind="stable")
    inorder = flat[by]
    new = np.append(True, inorder[1:] != inorder[:-1])
    first, at = np.flatnonzero(new), np.empty(len(flat), np.int64)
    at[by] = np.cumsum(new) - 1
    return by, first, inorder[first].astype(np.int64), at.reshape(ids.shape)


def _sums(x: np.ndarray, by: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` that have one id, as :func:`_distinct` orders them."""
    count = np.diff(first, append=len(by))
    x = x.take(by, axis=0, out=_room("ordered", *x.shape, kind=x.dtype), mode="clip")
    out = x.take(first, axis=0)
    few = count <= FEW
    for r in range(1, FEW):
        more = np.flatnonzero(few & (count > r))
        out[more] += x.take(first[more] + r, axis=0)
    for k in np.flatnonzero(~few):
        np.add.reduce(x[first[k] : first[k] + count[k]], axis=0, out=out[k])
    return out


class Spelling:
    """Subword ids of words, by a public byte-level vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.opens = np.zeros(self.size, bool)
        for token, k in ranks.items():
            self.opens[k] = token[:1] == b" "

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids per word)."""
        texts = [w.decode() for w in words]
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        plain = all(len(t.split()) == 1 for t in texts)  # no white space beyond ASCII
        if plain:
            flat = np.asarray(self.encoding.encode_ordinary(" " + " ".join(texts)), np.int32)
            starts = np.flatnonzero(self.opens[flat])
            if len(starts) == len(texts) and starts[0] == 0:
                return flat, np.diff(np.append(starts, len(flat))).astype(np.int32)
        each = [self.encoding.encode_ordinary(" " + t) for t in texts]
        return np.array([i for e in each for i in e], np.int32), np.array([len(e) for e in each], np.int32)


def spelling(path: str = VOCABULARY) -> Spelling:
    if path not in _loaded:
        _loaded[path] = Spelling(path)
    return _loaded[path]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_TABLE).split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``docs`` (text); the end of a text is the null word."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            words = pa.array([None, *seen.keys()], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array([ends, *seen.values()], pa.int64())], names=["word", "c"])

        seen: Counter = Counter()
        ends = 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(words_of(text))
                ends += 1
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
                    ends = 0
        yield out()

    return docs.select("text").mapInArrow(run, "word string, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def _id_counts(counts: DataFrame, path: str) -> DataFrame:
    """(id, n) of the subword ids of all counted words; id -1 is the end."""

    def run(batches):
        import pyarrow as pa

        spell = spelling(path)
        total, ends = np.zeros(spell.size, np.int64), 0
        for batch in batches:
            words, c = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            there = np.array([w is not None for w in words], bool)
            ends += int(c[~there].sum())
            flat, lens = spell.of([w for w in words if w is not None])
            total += np.bincount(flat, np.repeat(c[there], lens), spell.size).astype(np.int64)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *ids.tolist()], pa.int32()), pa.array([ends, *total[ids].tolist()], pa.int64())], names=["id", "n"])

    return counts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Layout:
    """Which group and slot an id has, and how likely it is inside its slot; the last id is the end of a text."""

    def __init__(self, counts: np.ndarray, opens: np.ndarray):
        self.size = len(counts)  # all ids, and the end
        self.end = self.size - 1
        order = np.argsort(-counts, kind="stable")
        slots = GROUPS * SLOTS
        single = order[: slots - GROUPS]
        single = single[np.argsort(~opens[single], kind="stable")]
        rest = order[slots - GROUPS :]
        self.slot = np.empty(self.size, np.int32)
        place = np.arange(slots).reshape(GROUPS, SLOTS)
        self.slot[single] = place[:, :-1].ravel()
        # every group's last slot is shared by the other ids, dealt by frequency
        self.slot[rest] = place[np.arange(len(rest)) % GROUPS, -1]
        smooth = counts + 0.5
        mass = np.bincount(self.slot, smooth, slots)
        self.inside = np.log(smooth / mass[self.slot]).astype(np.float32)
        self.mass = mass.reshape(GROUPS, SLOTS)
        # inputs: frequent ids by themselves, the others together, then the start of a text and the empty place
        self.input = np.full(self.size, INPUTS - 3, np.int32)
        self.input[order[: INPUTS - 3]] = np.arange(min(self.size, INPUTS - 3))
        self.begin, self.empty = INPUTS - 2, INPUTS - 1


#: of which query place sees which key place
_SEEN = np.arange(WIDTH)[None, :] <= np.arange(CONTEXT, WIDTH)[:, None]
_DELTA = np.clip(np.arange(CONTEXT, WIDTH)[:, None] - np.arange(WIDTH)[None, :], 0, WIDTH - 1)


class Attention:
    """One causal self-attention layer with a residual, a hidden layer and a two-level softmax."""

    def __init__(self, layout: Layout, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=0.1: (rng.standard_normal(shape) * by).astype(np.float32)
        group = layout.mass.sum(1)
        self.p = {
            "embed": draw(INPUTS, DIM),
            "wq": draw(DIM, KEY, by=0.3),
            "wk": draw(DIM, KEY, by=0.3),
            "wv": draw(DIM, DIM, by=0.2),
            "near": (-0.5 * np.arange(WIDTH)).astype(np.float32),
            "w1": draw(2 * DIM, HIDDEN, by=0.2),
            "b1": np.zeros(HIDDEN, np.float32),
            "ug": draw(HIDDEN, GROUPS, by=0.05),
            "bg": np.log(group / group.sum()).astype(np.float32),
            "us": draw(GROUPS, HIDDEN, SLOTS, by=0.05),
            "bs": np.log(layout.mass / group[:, None]).astype(np.float32),
        }
        self.empty = layout.empty

    def tables(self):
        p = self.p
        return p["embed"] @ p["wq"], p["embed"] @ p["wk"], p["embed"] @ p["wv"], p["embed"]

    def scoring_tables(self):
        """What depends on one id alone, worked out for every id: query, key, value and the residual's hidden part."""
        p = self.p
        q, k, v, e = self.tables()
        near = np.where(_SEEN, p["near"][_DELTA], np.float32(-1e4))
        return q, k, v, e @ p["w1"][:DIM] + p["b1"], p["w1"][DIM:].copy(), near, np.ones(WIDTH, np.float32), np.ones(GROUPS, np.float32), np.ones(SLOTS, np.float32)

    def score(self, inputs: np.ndarray, groups: np.ndarray, slots: np.ndarray, tables) -> np.ndarray:
        """Log probability of the target slots; inputs [n, WIDTH], targets [n, STRIDE]; ``tables`` are :meth:`scoring_tables`."""
        p, n = self.p, len(inputs)
        m, room = n * STRIDE, partial(_room, kind=p["w1"].dtype)
        q_of, k_of, v_of, h_of, wo, near, one_w, one_g, one_s = tables
        asked = inputs[:, CONTEXT:]
        s = np.matmul(q_of.take(asked, axis=0), k_of.take(inputs, axis=0).transpose(0, 2, 1), out=room("s", n, STRIDE, WIDTH))
        s += near
        _below(s, 60)
        np.exp(s, out=s)
        gaps = np.flatnonzero(inputs[:, 0] == self.empty)
        if len(gaps):  # empty places stand at a text's start only
            s[gaps] *= (inputs[gaps] != self.empty)[:, None, :]
        o = np.matmul(s, v_of.take(inputs, axis=0, out=room("v", n, WIDTH, DIM), mode="clip"), out=room("o", n, STRIDE, DIM))
        o /= (s @ one_w)[:, :, None]
        h = np.matmul(o.reshape(-1, DIM), wo, out=room("h", m, HIDDEN))
        h += h_of.take(asked.ravel(), axis=0, out=room("dh", m, HIDDEN), mode="clip")
        np.maximum(h, _ZEROS[: len(h)] if len(h) <= len(_ZEROS) else 0, out=h)
        # the rest in the order of groups
        order, gs, ts, parts, rows = self._by_group(groups, slots)
        hs = h.take(order, axis=0, out=room("hs", m, HIDDEN), mode="clip")
        lg = np.matmul(hs, p["ug"], out=room("lg", m, GROUPS))
        lg += p["bg"]
        _below(lg, 80)
        logp = lg[rows, gs]
        np.exp(lg, out=lg)
        logp -= np.log(lg @ one_g)
        ls = p["bs"].take(gs, axis=0, out=room("ls", m, SLOTS), mode="clip")
        for c, part in parts:
            ls[part] += hs[part] @ p["us"][c]
        _below(ls, 80)
        logp += ls[rows, ts]
        np.exp(ls, out=ls)
        logp -= np.log(ls @ one_s)
        out = np.empty(m, np.float32)
        out[order] = logp
        return out.reshape(groups.shape)

    @staticmethod
    def _by_group(groups: np.ndarray, slots: np.ndarray):
        g = groups.ravel().astype(np.uint8)
        order = np.argsort(g, kind="stable")
        gs = g[order]
        bounds = np.searchsorted(gs, np.arange(GROUPS + 1))
        parts = [(c, slice(bounds[c], bounds[c + 1])) for c in range(GROUPS) if bounds[c + 1] > bounds[c]]
        return order, gs.astype(np.int64), slots.ravel()[order], parts, np.arange(len(g))

    def forward(self, inputs: np.ndarray, groups: np.ndarray, slots: np.ndarray):
        """(as :meth:`score`, what backward needs, until the next batch)."""
        p = self.p
        n = len(inputs)
        m, one_w, room = n * STRIDE, np.ones(WIDTH, np.float32), partial(_room, kind=p["w1"].dtype)
        # what depends on one id alone is worked out once for every id
        by, first, ids, at = _distinct(inputs)
        asked = np.ascontiguousarray(at[:, CONTEXT:])
        w_e, w_o = p["w1"][:DIM], p["w1"][DIM:]
        e = p["embed"][ids]
        q_of, k_of, v_of = e @ p["wq"], e @ p["wk"], e @ p["wv"]
        h_of = e @ w_e + p["b1"]
        q, k, v = q_of.take(asked, axis=0), k_of.take(at, axis=0), v_of.take(at, axis=0, out=room("v", n, WIDTH, DIM), mode="clip")
        s = np.matmul(q, k.transpose(0, 2, 1), out=room("s", n, STRIDE, WIDTH))
        s += np.where(_SEEN, p["near"][_DELTA], np.float32(-1e4))
        _below(s, 60)
        np.exp(s, out=s)
        gaps = np.flatnonzero(inputs[:, 0] == self.empty)
        if len(gaps):
            s[gaps] *= (inputs[gaps] != self.empty)[:, None, :]
        s /= (s.reshape(-1, WIDTH) @ one_w).reshape(n, STRIDE, 1)
        o = np.matmul(s, v, out=room("o", n, STRIDE, DIM)).reshape(-1, DIM)
        h = np.matmul(o, w_o, out=room("h", m, HIDDEN))
        h += h_of.take(asked.ravel(), axis=0, out=room("dh", m, HIDDEN), mode="clip")
        np.maximum(h, _ZEROS[: len(h)] if len(h) <= len(_ZEROS) else 0, out=h)
        # the softmax in the order of groups
        order, gs, ts, parts, rows = self._by_group(groups, slots)
        hs = h.take(order, axis=0, out=room("hs", m, HIDDEN), mode="clip")
        lg = np.matmul(hs, p["ug"], out=room("lg", m, GROUPS))
        lg += p["bg"]
        _below(lg, 80)
        logp = lg[rows, gs]
        np.exp(lg, out=lg)
        zg = np.maximum(lg @ np.ones(GROUPS, np.float32), _LEAST)
        logp -= np.log(zg)
        ls = p["bs"].take(gs, axis=0, out=room("ls", m, SLOTS), mode="clip")
        for c, part in parts:
            ls[part] += hs[part] @ p["us"][c]
        _below(ls, 80)
        logp += ls[rows, ts]
        np.exp(ls, out=ls)
        zs = np.maximum(ls @ np.ones(SLOTS, np.float32), _LEAST)
        logp -= np.log(zs)
        out = np.empty(m, logp.dtype)
        out[order] = logp
        return out.reshape(groups.shape), (by, first, ids, asked, e, q, k, v, s, o, hs, lg, zg, ls, zs, order, gs, ts, parts, rows)

    def gradient(self, inputs, groups, slots, weights) -> tuple[float, dict]:
        """(mean loss, gradient of every parameter); weights [n, STRIDE] are 0 at places without a target."""
        p = self.p
        logp, (by, first, ids, asked, e, q, k, v, s, o, hs, lg, zg, ls, zs, order, gs, ts, parts, rows) = self.forward(inputs, groups, slots)
        n, m, us, room = len(inputs), len(rows), p["us"], partial(_room, kind=p["w1"].dtype)
        w_e, w_o, one_w = p["w1"][:DIM], p["w1"][DIM:], np.ones(WIDTH, np.float32)
        total = max(float(weights.sum()), 1.0)
        w = (weights.ravel() / total).astype(np.float32)[order]
        lg *= (w / zg)[:, None]
        lg[rows, gs] -= w
        ls *= (w / zs)[:, None]
        ls[rows, ts] -= w
        one = np.ones(m, np.float32)
        d = {"ug": hs.T @ lg, "bg": one @ lg, "us": np.zeros_like(us), "bs": np.zeros_like(p["bs"])}
        dhs, back = np.matmul(lg, p["ug"].T, out=room("h", m, HIDDEN)), room("back", m, HIDDEN)
        for c, part in parts:
            np.matmul(hs[part].T, ls[part], out=d["us"][c])
            np.matmul(one[part], ls[part], out=d["bs"][c])
            np.matmul(ls[part], us[c].T, out=back[part])
        dhs += back
        dhs *= hs > 0
        dh = room("dh", m, HIDDEN)
        dh[order] = dhs
        d["b1"] = one @ dh
        do = np.matmul(dh, w_o.T, out=room("back", m, DIM)).reshape(n, STRIDE, DIM)
        dv = np.matmul(s.transpose(0, 2, 1), do, out=room("dv", n, WIDTH, DIM))
        da = np.matmul(do, v.transpose(0, 2, 1), out=room("da", n, STRIDE, WIDTH))
        da *= s
        s *= (da.reshape(-1, WIDTH) @ one_w).reshape(n, STRIDE, 1)
        da -= s
        d["near"] = np.bincount(_DELTA.ravel(), (da.sum(0) * _SEEN).ravel(), WIDTH).astype(np.float32)
        # by id: of values and keys at every place, of queries and the residual's hidden part at the asked ones
        over, own = room("over", n, WIDTH, DIM + KEY), room("own", n, STRIDE, KEY + HIDDEN)
        over[:, :, :DIM], over[:, :, DIM:] = dv, da.transpose(0, 2, 1) @ q
        own[:, :, :KEY], own[:, :, KEY:] = da @ k, dh.reshape(n, STRIDE, HIDDEN)
        over = _sums(over.reshape(n * WIDTH, -1), by, first)
        dv, dk = over[:, :DIM], over[:, DIM:]
        by, first, which, _ = _distinct(asked)
        own = _sums(own.reshape(m, -1), by, first)
        dq, dh_of = own[:, :KEY], own[:, KEY:]
        d["w1"] = np.concatenate([e[which].T @ dh_of, o.T @ dh])
        d["wq"], d["wk"], d["wv"] = e[which].T @ dq, e.T @ dk, e.T @ dv
        de = dk @ p["wk"].T + dv @ p["wv"].T
        de[which] += dq @ p["wq"].T + dh_of @ w_e.T
        d["embed"] = np.zeros_like(p["embed"])
        d["embed"][ids] = de
        return -float((logp.ravel() * weights.ravel()).sum()) / total, d

    def train(self, inputs, groups, slots, weights, aside=None, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Train in place; with windows kept ``aside``, stop when these get no better and keep what suited them best."""
        rng, adam, losses = np.random.default_rng(5), Adam(self.p), []
        best, kept, waited = np.inf, None, 0
        while len(losses) < steps:
            order = rng.permutation(len(inputs))
            for at in range(0, len(order), BATCH):
                if aside is not None and len(losses) % LOOK == 0:
                    now = self.loss(*aside)
                    best, kept, waited = (now, {k: x.copy() for k, x in self.p.items()}, 0) if now < best else (best, kept, waited + 1)
                if len(losses) == steps or waited >= PATIENCE:
                    break
                part = order[at : at + BATCH]
                loss, grads = self.gradient(inputs[part], groups[part], slots[part], weights[part])
                losses.append(loss)
                adam.step(grads, rate * (1 - 0.9 * len(losses) / steps))
            if waited >= PATIENCE:
                break
        if aside is not None and kept is not None and self.loss(*aside) > best:
            self.p = kept
        return losses

    def loss(self, inputs, groups, slots, weights) -> float:
        """Mean loss without training."""
        total, tables = 0.0, self.scoring_tables()
        for k in range(0, len(inputs), BATCH):
            part = slice(k, k + BATCH)
            total -= float((self.score(inputs[part], groups[part], slots[part], tables) * weights[part]).sum())
        return total / max(float(weights.sum()), 1.0)


class Adam:
    """Steps on a dictionary of parameters, in place."""

    def __init__(self, p: dict):
        self.p, self.n = p, 0
        self.m, self.r, self.t = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(3))

    def step(self, grads: dict, rate: float) -> None:
        self.n += 1
        mean, root = 1 - 0.9**self.n, math.sqrt(1 - 0.99**self.n)
        for k, g in grads.items():
            m, r, t = self.m[k], self.r[k], self.t[k]
            np.multiply(g, 0.1, out=t)
            m *= 0.9
            m += t
            t *= g
            t *= 0.1
            r *= 0.99
            r += t
            np.sqrt(r, out=t)
            t += 1e-8 * root
            np.divide(m, t, out=t)
            t *= rate * root / mean
            self.p[k] -= t


def windows(ids: np.ndarray, ends: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs [n, WIDTH], targets [n, STRIDE], places [n, STRIDE]) of texts laid end to end.

    ``ids`` are the targets of all texts, ``ends`` where each text stops in it.  Every place is scored in exactly
    one window; a place of -1 is padding.
    """
    starts = np.concatenate(([0], ends[:-1]))
    lengths = ends - starts
    per = -(-lengths // STRIDE)
    owner = np.repeat(np.arange(len(ends)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[owner] + nth * STRIDE
    places = first[:, None] + np.arange(STRIDE)
    places = np.where(places < ends[owner][:, None], places, -1)
    # the input at a target's place is the id before it; before the first one stands the start of the text
    before = first[:, None] + np.arange(-CONTEXT - 1, STRIDE - 1)
    start = starts[owner][:, None]
    seen = layout.input[ids[np.clip(before, 0, max(len(ids) - 1, 0))]]
    inputs = np.where(before >= start, seen, np.where(before == start - 1, layout.begin, layout.empty)).astype(np.int32)
    inputs = np.where(before < ends[owner][:, None], inputs, layout.begin)
    return inputs, ids[np.maximum(places, 0)], places


class Speller:
    """Spells batches of texts; remembers words, and what ``table`` counts of them."""

    def __init__(self, path: str, table: dict | None = None):
        self.spell, self.table = spelling(path), table or {}
        self._empty()

    def _empty(self) -> None:
        self.index: dict[bytes, int] = {}
        self.known = 0
        self.flat, self.lens = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int32)
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[bytes]) -> None:
        flat, lens = self.spell.of(words)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(words) > len(self.lens):
            self.lens, self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.begin, self.count))
        part = slice(self.known, self.known + len(words))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lens[part], self.begin[part] = lens, self.used + np.cumsum(lens) - lens
        self.count[part] = np.fromiter((self.table.get(w, 0) for w in words), np.int64, len(words))
        self.index.update(zip(words, range(self.known, self.known + len(words)), strict=True))
        self.known, self.used = self.known + len(words), self.used + len(flat)

    def ids(self, texts: list[bytes]):
        """(words of all texts, number of words per text, whether a token is an end, index of its word, where a token stops in the ids, ids)."""
        if self.known > MEMORY:
            self._empty()
        parts = [words_of(t) for t in texts]
        flat = [w for p in parts for w in p]
        new = list(set(flat) - self.index.keys())
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        # words and ends in order; an end is token number -1
        total = len(flat) + len(parts)
        last = np.cumsum(n_words + 1) - 1
        is_end = np.zeros(total, bool)
        is_end[last] = True
        token = np.full(total, -1, np.int64)
        token[~is_end] = at
        lens = np.where(is_end, 1, self.lens[token])
        stop = np.cumsum(lens)
        begin = np.where(is_end, 0, self.begin[token]) - (stop - lens)
        ids = self.flat[np.minimum(np.repeat(begin, lens) + np.arange(stop[-1] if total else 0), len(self.flat) - 1)]
        ids[stop[last] - 1] = self.spell.size
        return flat, n_words, is_end, token, stop, ids


class Scorer(Speller):
    """Scores batches of texts."""

    def __init__(self, model: dict, path: str):
        super().__init__(path, model["table"])
        self.layout, self.net, self.share = model["layout"], model["net"], model["share"]
        self.tables = self.net.scoring_tables()
        # what a frequent word's count says, and what the base says of it
        self.total, self.listed, self.v = model["total"], model["listed"], model["v"]

    def __call__(self, texts: list[bytes]):
        """(tokens, tokens that the worker's table holds, their base, their score, other words, what the layer says of these) per text; an end is a token."""
        return self._sums(*self.tokens(texts))

    def tokens(self, texts: list[bytes]):
        """(words of all texts, number of words per text, whether a token is an end, index of its word, log probability of its spelling)."""
        flat, n_words, is_end, token, stop, ids = self.ids(texts)
        logp = self._attend(ids, stop[is_end])
        return flat, n_words, is_end, token, np.add.reduceat(logp, np.append(0, stop[:-1])) if len(stop) else np.zeros(0)

    def _sums(self, flat, n_words, is_end, token, spelled):
        total, last = len(token), np.cumsum(n_words + 1) - 1
        c = np.where(is_end, self.table[None], self.count[token])
        score = np.zeros(total)
        held = c > 0
        score[held] = np.log10(self.share * c[held] / self.listed + (1 - self.share) * np.exp(np.maximum(spelled[held], -600.0)))
        base = np.where(c > 0, np.log10((c + 1) / (self.total + self.v + 1)), 0.0)
        sums = [np.add.reduceat(x, last - n_words) if total else np.zeros(0) for x in ((c > 0).astype(np.int64), base, score)]
        rare = np.flatnonzero((c == 0))
        owner = np.searchsorted(last, rare)
        cuts = np.searchsorted(owner, np.arange(len(n_words) + 1))
        place = rare - owner  # ends before it are not in ``flat``
        outside = [[flat[k] for k in place[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        said = [spelled[rare[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return n_words + 1, *sums, outside, said

    def _attend(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log probability of every id of texts laid end to end."""
        lay = self.layout
        out = lay.inside[ids].astype(np.float64)
        if not len(ids):
            return out
        inputs, targets, places = windows(ids, ends, lay)
        slot = lay.slot[targets]
        group, slot = (slot // SLOTS).astype(np.uint8), slot % SLOTS
        for k in range(0, len(inputs), CHUNK):
            part = slice(k, k + CHUNK)
            logp = self.net.score(inputs[part], group[part], slot[part], self.tables)
            there = places[part] >= 0
            out[places[part][there]] += logp[there]
        return out


def _lumps(texts: list[bytes], most: int = 2_000_000):
    """(first, behind the last) of texts that have at most ``most`` bytes together, or of one text."""
    done = 0
    while done < len(texts):
        size, stop = 0, done
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < most):
            size += len(texts[stop])
            stop += 1
        yield done, stop
        done = stop


def _spelled(docs: DataFrame, path: str) -> DataFrame:
    """(ids, whole, size, mark, aside, text) of ``docs`` (text, aside): subword ids and the end as bytes, two hashes, code points; only texts kept aside keep their text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        speller = Speller(path)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            wholes = [xxhash.xxh3_64_digest(t) for t in texts]
            for a, b in _lumps(texts):
                *_, is_end, _, stop, ids = speller.ids(texts[a:b])
                data, ends = ids.astype("<i4").tobytes(), stop[is_end]
                bounds = np.append(0, ends)
                spelled = [data[4 * x : 4 * y] for x, y in zip(bounds[:-1], ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spelled, pa.binary()), pa.array(wholes[a:b], pa.binary()), *(batch.column(k).slice(a, b - a) for k in range(1, 5))], names=["ids", "whole", "size", "mark", "aside", "text"]
                )

    given = docs.select("text", F.length("text").alias("size"), F.xxhash64("text").alias("mark"), "aside", F.when(F.col("aside"), F.col("text")).alias("kept"))
    return given.mapInArrow(run, "ids binary, whole binary, size int, mark long, aside boolean, text string")


def _cut(batches, layout: Layout, most: int, marked: bool = True):
    """(key, inputs, targets, there, marks) of rows (ids, whole, key): about ``most`` windows of texts in their order that have one key.

    A mark is a hash of the text and the window's number; where they are not ``marked``, there is none.
    """
    import xxhash

    key, held, n = None, [], 0

    def out():
        ids = np.frombuffer(b"".join(x for x, _ in held), "<i4")
        lengths = np.array([len(x) for x, _ in held]) // 4
        inputs, targets, places = windows(ids, np.cumsum(lengths), layout)
        per = -(-lengths // STRIDE)
        marks = [xxhash.xxh3_64_intdigest(whole + k.to_bytes(8, "little")) - 2**63 for (_, whole), m in zip(held, per.tolist(), strict=True) for k in range(m)] if marked else []
        return key, inputs, targets, places >= 0, np.array(marks, np.int64)

    for batch in batches:
        for ids, whole, of in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and (of != key or n >= most):
                yield out()
                held, n = [], 0
            key = of
            held.append((ids, whole))
            n += -(-len(ids) // (4 * STRIDE))
    if held:
        yield out()


def _sample_windows(docs: DataFrame, layout, path: str) -> DataFrame:
    """(inputs, targets, there, mark, aside) windows of ``docs`` (text, aside), or of texts that are spelled."""

    def run(batches):
        import pyarrow as pa

        for aside, *three, marks in _cut(batches, layout.value, PIECE):
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().astype(np.int32)), x.shape[1]).cast(pa.list_(pa.int32())) for x in three]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(marks, pa.int64()), pa.array([aside] * len(marks), pa.bool_())], names=["inputs", "targets", "there", "mark", "aside"])

    docs = docs if "ids" in docs.columns else _spelled(docs, path)
    return docs.select("ids", "whole", "aside").mapInArrow(run, "inputs array<int>, targets array<int>, there array<int>, mark long, aside boolean")


def _arrays(found: DataFrame, layout: Layout) -> tuple:
    """(inputs, groups, slots, weights) of windows, few enough for the driver; they come as Arrow, not as rows of objects."""
    table = found.select("inputs", "targets", "there").toArrow()
    inputs, targets, there = (table[k].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, w) for k, w in (("inputs", WIDTH), ("targets", STRIDE), ("there", STRIDE)))
    slot = layout.slot[targets]
    return inputs, slot // SLOTS, slot % SLOTS, there.astype(np.float32)


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p.values()])


def _mean_loss(texts: DataFrame, net: Attention, layout, path: str) -> float:
    """Mean loss over all windows of ``texts`` (text, aside), or of texts that are spelled, worked out by tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        import pyarrow as pa

        lay, tables, total, n = layout.value, shared.value.scoring_tables(), 0.0, 0
        for _, inputs, targets, there, _ in _cut(batches, lay, PIECE, False):
            slot = lay.slot[targets]
            for k in range(0, len(inputs), CHUNK):
                part = slice(k, k + CHUNK)
                logp = shared.value.score(inputs[part], slot[part] // SLOTS, slot[part] % SLOTS, tables)
                total -= float(logp[there[part]].sum())
            n += int(there.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64()), pa.array([n], pa.int64())], names=["loss", "n"])

    texts = texts if "ids" in texts.columns else _spelled(texts, path)
    told = texts.select("ids", "whole", "aside").mapInArrow(run, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    shared.unpersist()
    return float(told[0] or 0.0) / max(int(told[1] or 0), 1)


def _round(found: DataFrame, net: Attention, layout, rate: float = ROUND_RATE, path: str = VOCABULARY, shards: int = 0) -> None:
    """Let tasks train from ``net`` on the shards of ``found``, and move ``net`` by the mean of their steps.

    ``found`` has windows, or spelled texts to be cut into windows by the task that trains on them, dealt to ``shards``.
    The mark of a window or text deals it to a shard, and the window's gives its place there, so what is learnt hangs on the windows alone: neither on
    files nor on tasks, nor on what is run again.  Steps are weighed by the windows that they come from, those of an input
    vector by how often its id was seen, so what only few shards see is not averaged away.  They are summed in pieces, in two
    levels and in the order of shards: the driver gets one sum.
    """
    shared = found.sparkSession.sparkContext.broadcast(net.p)
    empty = net.empty
    whole, most = "ids" in found.columns, SHARD_WINDOWS
    shards = shards if whole else max(1, -(-found.count() // SHARD_WINDOWS))

    def steps(own: Attention, start: dict, seen: np.ndarray, n: int, shard: int):
        import pyarrow as pa

        weights = {k: np.full(x.shape, n, np.float32) for k, x in own.p.items()}
        weights["embed"] = np.repeat(seen[:, None], DIM, axis=1)
        weight = _flat(weights)
        moved = (_flat(own.p) - _flat(start)) * weight
        sums = [np.stack([moved[k : k + PIECE], weight[k : k + PIECE]]).astype("<f4").tobytes() for k in range(0, len(moved), PIECE)]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([shard % PARTS] * len(sums), pa.int32()), pa.array([shard] * len(sums), pa.int32()), pa.array(sums, pa.binary())], names=["piece", "part", "shard", "sums"]
        )

    def given(batches):
        """(shard, inputs, targets, there) of windows that come in order."""
        for batch in batches:
            three = [batch.column(k).flatten().to_numpy().reshape(batch.num_rows, -1) for k in range(3)]
            of = batch.column(3).to_numpy()
            bounds = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *bounds], [*bounds, len(of)], strict=True):
                if b > a:
                    yield int(of[a]), *(x[a:b] for x in three)

    def spelled(batches):
        """The same of texts; windows of about ``most`` are put in the order of their marks."""
        for shard, *three, marks in _cut(batches, layout.value, most):
            order = np.argsort(marks, kind="stable")
            yield shard, *(x[order] for x in three)

    def run(batches):
        lay, start = layout.value, shared.value
        shard, own, adam, seen, n, held = None, None, None, None, 0, []

        def learn(least: int) -> None:
            """Steps on what is held, as long as at least ``least`` windows are."""
            nonlocal held, n, seen
            while held and sum(len(h[0]) for h in held) >= least:
                inputs, targets, there = (np.concatenate(x) for x in zip(*held, strict=True))
                first, held = (x[:BATCH] for x in (inputs, targets, there)), [[x[BATCH:] for x in (inputs, targets, there)]] if len(inputs) > BATCH else []
                inputs, targets, there = first
                slot = lay.slot[targets]
                adam.step(own.gradient(inputs, slot // SLOTS, slot % SLOTS, there.astype(np.float32))[1], rate)
                seen += np.bincount(inputs.ravel(), minlength=INPUTS)
                n += len(inputs)

        for of, inputs, targets, there in (spelled if whole else given)(batches):
            if of != shard:
                if shard is not None:
                    learn(1)
                    yield steps(own, start, seen, n, shard)
                shard, own, n = of, Attention.__new__(Attention), 0
                own.p, own.empty = {k: x.copy() for k, x in start.items()}, empty
                adam, seen = Adam(own.p), np.zeros(INPUTS, np.float32)
            for k in range(0, len(inputs), BATCH):
                held.append([x[k : k + BATCH] for x in (inputs, targets, there)])
                learn(BATCH)
        if shard is not None:
            learn(1)
            yield steps(own, start, seen, n, shard)

    def add(frame):
        import pandas as pd

        frame = frame.sort_values("shard")
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in frame["sums"])
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "part": frame["part"].iloc[:1], "shard": frame["part"].iloc[:1], "sums": [total.astype("<f4").tobytes()]})

    schema = "piece int, part int, shard int, sums binary"
    kept, last = (["ids", "whole"], "ids") if whole else (["inputs", "targets", "there"], "targets")
    dealt = found.select(*kept, F.pmod(F.xxhash64(F.lit(shards), "mark"), F.lit(shards)).cast("int").alias("shard"), "mark")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "mark", last).select(*kept, "shard")
    sums = dealt.mapInArrow(run, schema)
    rows = sums.groupBy("piece", "part").applyInPandas(add, schema).groupBy("piece").applyInPandas(add, schema).collect()
    if rows:
        pieces = [np.frombuffer(r["sums"], "<f4").reshape(2, -1) for r in sorted(rows, key=lambda r: r["piece"])]
        moved, weight = np.concatenate(pieces, axis=1)
        step, at = moved / np.maximum(weight, 1e-9), 0
        for k, x in net.p.items():
            net.p[k] = x + step[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size


def _fit_share(aside: DataFrame, counts: DataFrame, model: dict, path: str, scratch: Scratch, rounds: int = 30) -> float:
    """Weight of the table by expectation maximisation on all texts of ``aside``, each without its own counts.

    Tasks spell the texts, once; words that the table holds have their count there and are counted there, others by a join.  What the weight needs of a
    token is how much likelier the table makes it than its spelling does: hundredths of that are counted, at most 40,001.
    """
    shared, total, far = aside.sparkSession.sparkContext.broadcast(model), model["listed"], 20_000
    names = ["word", "own", "said", "place", "n"]

    def run(batches):
        import pyarrow as pa

        scorer, listed = Scorer(shared.value, path), np.zeros(2 * far + 2, np.int64)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in _lumps(texts):
                flat, n_words, is_end, token, said = scorer.tokens(texts[a:b])
                count = np.where(is_end, scorer.table[None], scorer.count[token])
                owner = np.repeat(np.arange(b - a), n_words + 1)
                _, same, often = np.unique(owner * (scorer.known + 1) + token + 1, return_inverse=True, return_counts=True)
                own, said = often[same], np.maximum(said, -600.0)
                held = count > 0
                rest = np.maximum(count - own, 0)[held]
                ratio = np.log(np.maximum(rest, 1) / total) - said[held]
                place = np.clip(np.floor(ratio * 100), -far, far).astype(np.int64) + far
                listed += np.bincount(np.where(rest > 0, place, 2 * far + 1), minlength=2 * far + 2)
                rare = np.flatnonzero(~held)
                words = [flat[k].decode() for k in rare - owner[rare]]  # ends before it are not in ``flat``
                for k in range(0, len(rare), 65536):
                    part = slice(k, k + 65536)
                    none = pa.nulls(len(rare[part]), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(words[part], pa.string()), pa.array(own[rare[part]]), pa.array(said[rare[part]]), none, none], names=names)
        at = np.flatnonzero(listed)
        none = pa.nulls(len(at))
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.float64()), pa.array([int(x) - far if x <= 2 * far else None for x in at], pa.int64()), pa.array(listed[at])], names=names)

    told = scratch.put(aside.select("text").mapInArrow(run, "word string, own long, said double, place long, n long"), "told")
    rare = told.where("word is not null").join(counts.where("word is not null"), "word", "left").select(F.coalesce("c", F.lit(0)).alias("held"), "own", "said")
    rest = F.greatest(F.col("held") - F.col("own"), F.lit(0))
    place = F.floor((F.log(rest / F.lit(float(total))) - F.col("said")) * 100)
    place = F.when(rest > 0, F.greatest(F.least(place, F.lit(far)), F.lit(-far)))
    rare = rare.select(place.alias("place"), F.lit(1).cast("long").alias("n"))
    found = told.where("word is null").select("place", "n").unionByName(rare).groupBy("place").agg(F.sum("n").alias("n")).collect()
    scratch.drop(told)
    if not found:
        return TABLE_WEIGHT
    ratio = np.array([0.0 if r["place"] is None else math.exp((r["place"] + 0.5) / 100) for r in found])
    n, share = np.array([r["n"] for r in found], float), 0.5
    for _ in range(rounds):
        share = float(np.sum(n * (share * ratio / (share * ratio + (1 - share)))) / n.sum())
    return min(max(share, 0.01), 0.99)


def fit(train: DataFrame, scratch: Scratch, path: str = VOCABULARY, table_words: int = TABLE_WORDS) -> tuple[dict, DataFrame]:
    """(model, word counts) from all texts of ``train`` (text).

    Counts cover every text, and the attention layer is trained on every text, equal ones taken once; those kept aside
    decide on rounds and on the table's weight.  The driver holds TRAIN_WINDOWS windows and ASIDE_WINDOWS windows to start
    from, at most, workers ``table_words`` words of the table.
    """
    spark = train.sparkSession
    counts = scratch.put(count_words(train), "counts")
    words = counts.where("word is not null")
    n_docs = (counts.where("word is null").agg(F.sum("c")).first()[0]) or 0
    sums = words.agg(F.count(F.lit(1)), F.sum("c")).first()
    total, v = int(sums[1] or 0) + n_docs, int(sums[0]) + (n_docs > 0)
    # the lowest count of the table: counts above it belong to few enough words
    steps = sorted(((r["c"], r["n"]) for r in words.where("c > 1").groupBy(F.least("c", F.lit(100_000)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    lowest, held = 2**62, 0
    for c, n in steps:
        if held + n > table_words:
            break
        lowest, held = c, held + n
    listed = {bytes(r[0]): r[1] for r in words.where(F.col("c") >= lowest).select(F.col("word").cast("binary"), "c").collect()}
    listed[None] = max(n_docs, 1)
    spell = spelling(path)
    by_id = np.zeros(spell.size + 1, np.float64)
    for r in _id_counts(counts, path).collect():
        by_id[r["id"]] = r["n"]
    layout = Layout(by_id, np.append(spell.opens, True))
    net = Attention(layout)
    model = {"layout": layout, "net": net, "table": listed, "share": TABLE_WEIGHT, "listed": max(total, 1), "total": total, "v": v}
    texts = train.select("text").distinct().withColumn("aside", F.pmod(F.shiftright(F.xxhash64("text"), 20), F.lit(ASIDE)) == 0)
    texts = scratch.put(_spelled(texts, path), "texts")
    lay = spark.sparkContext.broadcast(layout)
    taken, aside = texts.where("not aside"), texts.where("aside")
    # about two characters an id
    about = {bool(r["aside"]): int(r["n"] + (r["size"] or 0) // (2 * STRIDE)) for r in texts.groupBy("aside").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}

    def some(of: DataFrame, kept: bool, most: int) -> tuple:
        """Windows of texts with low hashes, about four times ``most`` of which ``most`` are taken."""
        share = min(1.0, 4 * most / max(about.get(kept, 0), 1))
        low = of.where(F.pmod(F.xxhash64("mark"), F.lit(2**20)) < math.ceil(share * 2**20))
        return _arrays(_sample_windows(low, lay, path).orderBy("mark", "targets").limit(most), layout)

    first = some(taken, False, TRAIN_WINDOWS)
    if len(first[0]):
        kept = some(aside, True, ASIDE_WINDOWS)
        looked = kept if len(kept[0]) else None
        net.train(*first, looked)
        del first
        worth = _mean_loss(aside, net, lay, path) if looked else 0.0
        for k in range(ROUNDS if looked or about[False] > TRAIN_WINDOWS else 0):
            before = {n: x.copy() for n, x in net.p.items()}
            _round(taken.where(F.pmod(F.xxhash64("mark"), F.lit(ROUNDS)) == k), net, lay, path=path, shards=max(1, -(-about[False] // (ROUNDS * SHARD_WINDOWS))))
            now = _mean_loss(aside, net, lay, path) if looked else worth
            if now > worth:
                net.p = before
            else:
                worth = now
    model["share"] = _fit_share(aside.where("text is not null"), counts, model, path, scratch)
    scratch.drop(texts)
    return model, counts


def score_documents(docs: DataFrame, path: str = VOCABULARY, modulus: int = 7, held: int = 2, table_words: int = TABLE_WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Whole texts are scored; a null or empty text is the end alone.  Rows whose crc32(doc_id as text) mod ``modulus`` is
    ``held`` take no part in training; a null doc_id does take part and is not held out.  Repeated rows give repeated
    results; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"))
    model, counts = fit(texts.where(~F.col("held_out")), scratch, path, table_words)
    total, v, share, mass = model["total"], model["v"], model["share"], model["listed"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value, path)
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for done, stop in _lumps(texts):
                n, known, base, score, rare, said = scorer(texts[done:stop])
                kept = [batch.column(k).slice(done, stop - done) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(said, pa.list_(pa.float32()))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "said"],
                )

    scored = texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, said array<float>")
    scored = scratch.put(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    spread = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("said").alias("said")))).toDF("row", "word", "said")
    found = spread.join(counts.where("word is not null"), "word", "left").select("row", "said", F.coalesce("c", F.lit(0)).alias("c"))
    spelled = F.col("said").cast("double") + math.log(1 - share)
    token = F.when(F.col("c") > 0, F.log10(F.col("c") * (share / mass) + F.exp(spelled))).otherwise(spelled / LOG10)
    rest = found.groupBy("row").agg(
        F.sum((F.col("c") > 0).cast("long")).alias("more_known"),
        F.sum(F.log10((F.col("c") + 1) / F.lit(float(total + v + 1)))).alias("more_base"),
        F.sum(token).alias("more_score"),
    )
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
