"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark words.

The automaton's patterns are the items cut into chunks of half a window, so it is about as large as the benchmark; any
window holds a whole chunk.  A text is scanned once; where a chunk occurs, the run of equal words around it is measured,
and runs of a window or more are hits.  Items shorter than a window are one pattern and hit as they are.  Hits are
mapped back to offsets of the original text: normalising maps bytes to bytes (A-Z to a-z, ASCII other than letters and
digits to a space, all else unchanged), so a position in the normalised text is the same position in the original.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: benchmark text that one automaton holds at most (some 200 MB of memory); more is scanned in several passes
BLOCK_BYTES = 4_000_000
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,words:array<struct<first:int,last:int>>,spans:array<struct<start:int,stop:int>>>"

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_automata: dict = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def build_automaton(items: list[tuple[str, str]], window: int):
    """(automaton, words by item, window); a pattern's value is (words, places), places being (item, word) pairs."""
    import ahocorasick

    chunk = (window + 1) // 2
    texts = [words_of((text or "").encode()) for _, text in items]
    found: dict[str, tuple[int, list]] = {}
    for k, words in enumerate(texts):
        size = chunk if len(words) >= window else len(words)
        for at in range(0, len(words) - size + 1, size) if size else ():
            key = (b" " + b" ".join(words[at : at + size]) + b" ").decode("latin-1")
            found.setdefault(key, (size, []))[1].append((k, at))
    automaton = ahocorasick.Automaton()
    for key, value in found.items():
        automaton.add_word(key, value)
    if found:
        automaton.make_automaton()
    return (automaton, texts, window) if found else None


def scan_text(text: bytes, built) -> tuple[int, list[tuple[int, int]], set]:
    """(words in all, merged ranges [first, last) of words hit, positions of the items that occur)."""
    words = words_of(text)
    if not words or built is None:
        return len(words), [], set()
    automaton, texts, window = built
    flat = b" " + b" ".join(words) + b" "
    ranges: list[tuple[int, int]] = []
    items: set = set()
    measured: dict[tuple[int, int], int] = {}
    spaces = None
    for end, (size, places) in automaton.iter(flat.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        first = int(np.searchsorted(spaces, end)) - size
        for k, at in places:
            if measured.get((k, first - at), -1) > first:
                continue  # inside a run that is measured already
            item, a, b, i, j = texts[k], first, first + size, at, at + size
            while a and i and words[a - 1] == item[i - 1]:
                a, i = a - 1, i - 1
            while b < len(words) and j < len(item) and words[b] == item[j]:
                b, j = b + 1, j + 1
            measured[k, first - at] = b
            if b - a >= min(window, len(item)):
                items.add(k)
                ranges.append((a, b))
    return len(words), _merge(ranges, []), items


def _offsets(text: bytes, ranges: list) -> list[dict]:
    """Code-point offsets in the original of word ranges."""
    if not ranges:
        return []
    solid = np.frombuffer(text.translate(_KEEP), np.uint8) != 32
    edges = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lead = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    points = np.concatenate(([0], np.cumsum(lead)))
    return [{"start": int(points[starts[a]]), "stop": int(points[stops[b - 1]])} for a, b in ranges]


def _merge(one: list, other: list) -> list:
    out: list[list[int]] = []
    for a, b in sorted([*one, *other]):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _pass(items, window: int, text_col: str, into: str, first: bool):
    """One pass over Arrow batches: adds or extends the struct column ``into``."""

    def run(batches):
        import pyarrow as pa

        key = hash((window, *items.value))
        if key not in _automata:
            _automata.clear()
            _automata[key] = build_automaton(items.value, window)
        automaton, names = _automata[key], [k for k, _ in items.value]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            before = [None] * len(texts) if first else batch.column(batch.schema.get_field_index(into)).to_pylist()
            rows = []
            for text, old in zip(texts, before, strict=True):
                n, ranges, who = scan_text(text or b"", automaton)
                found = {names[k] for k in who}
                if old:
                    ranges = _merge([(x["first"], x["last"]) for x in old["words"]], ranges)
                    found |= set(old["items"])
                rows.append(
                    {
                        "n_words": n,
                        "n_hit": sum(b - a for a, b in ranges),
                        "items": sorted(found),
                        "words": [{"first": a, "last": b} for a, b in ranges],
                        "spans": _offsets(text or b"", ranges),
                    }
                )
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            word = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", word), ("spans", span)])
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if first or n != into]
            yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(rows, kind)], names=[*[n for n, _ in kept], into])

    return run


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", into: str = "decontam", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items (ids as sorted strings), words, spans.

    ``benchmark`` has item_id, text.  An item of fewer words than ``window`` is one window; a null or empty text has
    no words and no windows; rows with a null item_id are left out; repeated items count once.  Rows of ``docs`` are
    judged one by one; null text has no words.  Other columns pass through; ``into`` must not be among them.
    An empty table gives an empty result, an empty benchmark no hits.  The benchmark's size is read first: up to
    ``block_bytes`` it is one automaton, which is what a worker holds; more is cut into blocks, one pass each.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{into}` {RESULT}"])
    out = docs
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.sort("item_id", "text").collect()])
        out = out.mapInArrow(_pass(block, window, text_col, into, k == 0), schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated, spans.

    Odd rows and tables are treated as in :func:`annotate`; other columns are ignored.
    """
    found = annotate(docs.select("doc_id", "text"), benchmark).select("doc_id", "decontam.*")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no benchmark window occurs, with their columns as they were (as in :func:`annotate`)."""
    return annotate(docs, benchmark, into="__decontam").where("__decontam.n_hit = 0").drop("__decontam")
