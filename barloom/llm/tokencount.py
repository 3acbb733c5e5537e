"""Edit-aware token counts.

A document's pre-tokens are the leaves of a tree that keeps characters and tokens per subtree.  An edit finds its leaf
by descending, re-encodes only the leaves it touches with a little context, and updates the sums on the way up.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters after a pre-token that its match can look at
LOOKAHEAD = 2
#: pre-tokens of one leaf block, and blocks are cut anew when one holds four times as many
BLOCK = 64
MEMORY = 500_000
# What the production edit script replaces.
REDACTIONS = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<email>"), (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", "<ip>")]

_loaded: dict = {}


class Counter:
    """Pre-token splitter and token counts by pre-token, remembered up to a bound."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > MEMORY:
            self.known = {}
        known = self.known
        out = [known.get(p, 0) for p in pieces]
        for k, n in enumerate(out):
            if not n:
                p = pieces[k]
                out[k] = known[p] = known.get(p) or len(self.encoding.encode_ordinary(p))
        return out


def load(path: str = VOCABULARY) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


class TokenTree:
    """Segment tree over blocks of pre-tokens; node sums are (characters, tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.encoded = 0
        pieces = counter.split(text)
        self._plant(pieces, counter.counts(pieces))

    def _plant(self, pieces: list[str], counts: list[int]) -> None:
        cuts = range(0, max(1, len(pieces)), BLOCK)
        self.pieces = [pieces[k : k + BLOCK] for k in cuts]
        self.counts = [counts[k : k + BLOCK] for k in cuts]
        self.size = 1 << (len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.pieces)):
            self._fill(k)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _fill(self, block: int) -> None:
        self.chars[self.size + block] = sum(map(len, self.pieces[block]))
        self.tokens[self.size + block] = sum(self.counts[block])

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join("".join(b) for b in self.pieces)

    def _locate(self, at: int) -> tuple[int, int, int]:
        """(block, leaf in it, offset of the leaf's start) of the leaf that holds character ``at``, or of the end."""
        node, base = 1, 0
        at = min(at, self.chars[1])
        while node < self.size:
            node *= 2
            if at - base >= self.chars[node] and self.chars[node + 1]:
                base += self.chars[node]
                node += 1
        block = node - self.size
        for leaf, piece in enumerate(self.pieces[block]):
            if at - base < len(piece):
                return block, leaf, base
            base += len(piece)
        return block, len(self.pieces[block]), base

    def _back(self, block: int, leaf: int, base: int, limit: int) -> tuple[int, int, int]:
        """The last leaf at or before the given one whose predecessor cannot see character ``limit``."""
        while True:
            b, k = block, leaf
            while k == 0 and b > 0:
                b -= 1
                k = len(self.pieces[b])
            if k == 0 or base + LOOKAHEAD < limit:
                return block, leaf, base
            block, leaf = b, k - 1
            base -= len(self.pieces[b][k - 1])

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop) by ``new``; offsets beyond the end mean the end."""
        start, stop = max(0, min(start, self.chars[1])), min(max(start, stop), self.chars[1])
        b0, k0, base = self._back(*self._locate(start), start)
        b1, k1, end = self._locate(stop)
        if end < stop:  # inside a leaf: through its end
            end += len(self.pieces[b1][k1])
            k1 += 1
        old = self._take(b0, k0, b1, k1)
        text = "".join(old)
        text = text[: start - base] + new + text[stop - base :]
        at = len(text)
        while True:  # take in whole leaves until a match starts where an old leaf does
            more = self._next(b1, k1, 8)
            tail = text + "".join(p for *_, p in more)
            borders = {at}
            where = at
            for *_, piece in more[: len(more) - 3]:
                where += len(piece)
                borders.add(where)
            pieces, pos, met = self.counter.split(tail), 0, None
            for n, piece in enumerate(pieces):
                if pos >= at and pos in borders:
                    met = n, pos
                    break
                pos += len(piece)
            if met is None and len(more) < 8:
                met = len(pieces), len(tail)
            if met is not None:
                break
            b1, k1, _ = more[-1]
            k1 += 1
            text = tail
        keep, reach = met
        b2, k2 = b1, k1
        for block, leaf, piece in more:
            if reach <= at:
                break
            b2, k2 = block, leaf + 1
            reach -= len(piece)
        self._put(b0, k0, b2, k2, pieces[:keep])

    def _take(self, b0: int, k0: int, b1: int, k1: int) -> list[str]:
        if b0 == b1:
            return self.pieces[b0][k0:k1]
        return [*self.pieces[b0][k0:], *(p for b in range(b0 + 1, b1) for p in self.pieces[b]), *self.pieces[b1][:k1]]

    def _next(self, block: int, leaf: int, n: int) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        while len(out) < n and block < len(self.pieces):
            part = self.pieces[block][leaf : leaf + n - len(out)]
            out += [(block, leaf + k, p) for k, p in enumerate(part)]
            block, leaf = block + 1, 0
        return out

    def _put(self, b0: int, k0: int, b1: int, k1: int, new: list[str]) -> None:
        """Leaves from (b0, k0) to before (b1, k1) become ``new``; sums change on the way up only."""
        counts = self.counter.counts(new)
        self.encoded += len(new)
        if b0 == b1:
            self.pieces[b0][k0:k1], self.counts[b0][k0:k1] = new, counts
        else:
            self.pieces[b0][k0:], self.counts[b0][k0:] = new, counts
            for b in range(b0 + 1, b1):
                self.pieces[b], self.counts[b] = [], []
            del self.pieces[b1][:k1], self.counts[b1][:k1]
        if len(self.pieces[b0]) > 4 * BLOCK:
            self._plant([p for b in self.pieces for p in b], [c for b in self.counts for c in b])
            return
        for b in range(b0, b1 + 1):
            self._fill(b)
            node = (self.size + b) // 2
            while node:
                self._sum(node)
                node //= 2


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The production edit script: every address of e-mail or network becomes a placeholder, last one first."""
    import regex

    found = []
    for pattern, new in REDACTIONS:
        found += [(m.start(), m.end(), new) for m in regex.finditer(pattern, text)]
    kept, free = [], len(text) + 1
    for start, stop, new in sorted(found, reverse=True):
        if stop <= free:
            kept.append((start, stop, new))
            free = start
    return kept


def count_with_edits(docs: DataFrame, edits: str | None = None, path: str = VOCABULARY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_edits, n_tokens_after, n_pieces, n_encoded.

    ``edits`` names an array<struct<start, stop, text>> column, applied in order, each to the text that the earlier
    ones left, offsets in code points; without it the redaction script is used.  ``n_encoded`` says how many of the
    ``n_pieces`` pre-tokens the edits had encoded again.  Null text counts as empty; null edits are none, and a null
    offset or text in one means 0 or nothing.  Rows are independent; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", *([edits] if edits else []))

    def run(batches):
        import pyarrow as pa

        counter = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scripts = batch.column(2).to_pylist() if edits else [None] * len(texts)
            out = []
            for text, script in zip(texts, scripts, strict=True):
                text = text or ""
                tree = TokenTree(text, counter)
                before, pieces = tree.total, sum(map(len, tree.pieces))
                steps = redactions(text) if not edits else [(e["start"] or 0, e["stop"] or 0, e["text"] or "") for e in script or [] if e]
                for step in steps:
                    tree.edit(*step)
                out.append((before, len(steps), tree.total, pieces, tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_encoded"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_pieces long, n_encoded long")
