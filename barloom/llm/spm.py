"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; normaliser, metaspace marker, piece scores and byte fallback are rebuilt as a
``tokenizers`` pipeline, whose batches are encoded by several threads.  Parity with the sentencepiece library is
checked on the texts themselves.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from itertools import pairwise

from pyspark.sql import DataFrame

from .common import slices

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: text handed to the tokenizer at once, which bounds the memory of its result
CHUNK_CHARS = 1_000_000
#: segments of one generation of what a worker remembers
MEMORY = 250_000
#: new segments that the tokenizer gets as one text
RUN = 500
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_loaded: dict = {}


def _fields(data: bytes):
    """(field number, value) pairs of one protobuf message: ints, 4- and 8-byte blocks, byte strings."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), model type, byte fallback, unknown id and normaliser settings of a model file."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    for n, value in _fields(data):
        if n == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif n == 2:
            spec = dict(_fields(value))
            model |= {"type": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "unk_id": spec.get(40, 0)}
        elif n == 3:
            spec = dict(_fields(value))
            model |= {"charsmap": spec.get(2, b""), "prefix": bool(spec.get(3, 1)), "squeeze": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    return model


def _merges(pieces: list) -> list[tuple[str, str]]:
    """BPE merge list: every split of a piece into two pieces, best score of the whole first."""
    ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-pieces[k][1], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


SEGMENT = f"{SPACE}*[^{SPACE}]+|{SPACE}+"


def splits_at_markers(model: dict) -> bool:
    """No piece crosses from a letter into a marker, so runs of markers may start segments of their own."""
    return not any(SPACE in p.lstrip(SPACE) for p, _, _ in model["pieces"])


class SegmentCoder:
    """Codes by segment and remembers segments; only for models that split at markers and map no characters.

    A segment is remembered as its ids (little-endian 32-bit).  Its pieces are put together again when it is learnt; only
    segments that do not give themselves back (unknown characters without byte fallback) need a text of their own.
    There are two generations: when the younger is full, the older is forgotten, so frequent segments stay.
    """

    def __init__(self, model: dict, tokenizer):
        from tokenizers import Tokenizer, decoders

        self.cutter = Tokenizer(tokenizer.model)
        self.cutter.pre_tokenizer = tokenizer.pre_tokenizer
        self.cutter.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.prefix = SPACE if model["prefix"] else ""
        self.find = re.compile(SEGMENT).findall
        self.pieces = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.encode() if kind in (NORMAL, USER) else b"" for p, _, kind in model["pieces"]]
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}

    def _learn(self, new: list[str]) -> None:
        bare = [s for s in new if not s.strip(SPACE)]
        words = [s for s in new if s.strip(SPACE)]
        for s in bare:
            self._keep([s], [self.cutter.encode(s, add_special_tokens=False).ids])
        # a run of segments is one text that the tokenizer cuts again at the same places
        runs = [words[k : k + RUN] for k in range(0, len(words), RUN)]
        for run, e in zip(runs, self.cutter.encode_batch(["".join(r) for r in runs], add_special_tokens=False), strict=True):
            flat, of = e.ids, e.word_ids
            starts = [0, *(k for k, (a, b) in enumerate(pairwise(of), 1) if a != b), len(flat)]
            self._keep(run, [flat[a:b] for a, b in pairwise(starts)])

    def _keep(self, segments: list[str], ids: list[list[int]]) -> None:
        self.ids.update((s, array("i", i).tobytes()) for s, i in zip(segments, ids, strict=True))
        if b"".join([self.pieces[k] for i in ids for k in i]) != "".join(segments).encode():
            for s, text in zip(segments, self.cutter.decode_batch(ids, skip_special_tokens=False), strict=True):
                if text != s.replace(SPACE, " "):
                    self.odd[s] = text

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        cut = [self.find(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.ids) > MEMORY:
            self.old, self.ids = self.ids, {}
            self.odd = {s: t for s, t in self.odd.items() if s in self.old}
        new = set().union(*cut) - self.ids.keys()
        again = new & self.old.keys()
        self.ids.update((s, self.old[s]) for s in again)
        self._learn(list(new - again))
        ids, skip = self.ids.__getitem__, len(self.prefix)
        if self.odd:
            back = ["".join([self.odd.get(s, s.replace(SPACE, " ")) for s in segments])[skip:] for segments in cut]
        else:
            back = [t.replace(SPACE, " ") for t in texts]
        return [(b"".join(map(ids, segments)), t) for segments, t in zip(cut, back, strict=True)]


def build_tokenizer(model: dict):
    """The ``tokenizers`` pipeline of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    if model["type"] == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], model["unk_id"], model["byte_fallback"]))
    elif model["type"] == BPE:
        vocab = {p: k for k, (p, _, _) in enumerate(pieces)}
        tokenizer = Tokenizer(
            models.BPE(vocab, _merges(pieces), unk_token=pieces[model["unk_id"]][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
        )
    else:
        raise ValueError(f"model type {model['type']} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if model["prefix"] else []
    steps += [normalizers.Replace(" ", SPACE)] if model["escape"] else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_markers(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(SEGMENT), "isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])]
    )
    return tokenizer


def _whole(tokenizer, texts: list[str]) -> list[tuple[bytes, str]]:
    """Ids and decoded text of whole texts, for any model."""
    ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [(array("i", i).tobytes(), t) for i, t in zip(ids, tokenizer.decode_batch(ids, skip_special_tokens=False), strict=True)]


def load(path: str = MODEL, threads: int = THREADS):
    """(tokenizer, coder of batches, sentencepiece processor) of a model file; one triple per Python worker."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        model = parse_model(data)
        tokenizer = build_tokenizer(model)
        plain = splits_at_markers(model) and model["escape"] and not model["squeeze"] and not model["charsmap"]
        coder = SegmentCoder(model, tokenizer) if plain else lambda texts: _whole(tokenizer, texts)
        _loaded[path] = tokenizer, coder, sentencepiece.SentencePieceProcessor(model_proto=data)
    return _loaded[path]


def _chunks(texts: list[str], limit: int):
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def encode_texts(texts: list[str], path: str = MODEL, threads: int = THREADS):
    """Per text: (ids as little-endian 32-bit integers, decoded text, parity with the sentencepiece library)."""
    _, coder, reference = load(path, threads)
    for chunk in _chunks(texts, CHUNK_CHARS):
        same = reference.encode(chunk, num_threads=threads)
        for (ids, decoded), other in zip(coder(chunk), same, strict=True):
            yield ids, decoded, ids == array("i", other).tobytes()


def annotate(docs: DataFrame, text_col: str = "text", into: str = "pieces", path: str = MODEL, threads: int = THREADS) -> DataFrame:
    """``docs`` with a struct column ``into``: ids, n_tokens, ids_sha256, round_trip, parity.

    ``round_trip`` says that decoding gives the text back, ``parity`` that the sentencepiece library gives the same
    ids; ``ids_sha256`` is the digest of the ids as little-endian 32-bit integers.  Null text counts as empty: no ids,
    both flags true.  Whole texts are encoded; rows are independent; other columns pass through.  ``path`` is the
    place of the model file on every worker.
    """
    if into in docs.columns:
        raise ValueError(f"column {into!r} exists already; name another with into=")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("round_trip", pa.bool_()), ("parity", pa.bool_())])
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            ids, rest = [], []
            for text, (i, back, parity) in zip(texts, encode_texts(texts, path, threads), strict=True):
                ids.append(i)
                rest.append((len(i) // 4, hashlib.sha256(i).hexdigest(), back == text, parity))
            offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            n, sha, trip, parity = (list(x) for x in zip(*rest, strict=True)) if rest else ([], [], [], [])
            column = pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(trip, pa.bool_()), pa.array(parity, pa.bool_())],
                fields=list(kind),
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    fields = "struct<ids:array<int>,n_tokens:bigint,ids_sha256:string,round_trip:boolean,parity:boolean>"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{into}` {fields}"])
    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", into: str = "decoded", path: str = MODEL) -> DataFrame:
    """``docs`` with the text that the ids of ``ids_col`` stand for; null ids give null."""

    def run(batches):
        import pyarrow as pa

        tokenizer, _, _ = load(path)
        for batch in slices(batches):
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            texts = tokenizer.decode_batch([i or [] for i in ids], skip_special_tokens=False)
            column = pa.array([None if i is None else t for i, t in zip(ids, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"`{into}` string"])
    return docs.mapInArrow(run, schema)
