"""Piece models built by hand: a unigram model with byte fallback, and one whose unknown characters have no bytes."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from barloom.llm import spm


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _block(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _model(kind: int, words: list[tuple[str, float]], fallback: bool) -> bytes:
    pieces = [("<unk>", 0.0, spm.UNKNOWN), ("<s>", 0.0, spm.CONTROL), ("</s>", 0.0, spm.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, spm.BYTE) for b in range(256)] if fallback else []
    pieces += [(w, s, spm.NORMAL) for w, s in words]
    data = b"".join(_block(1, _block(1, p.encode()) + b"\x15" + struct.pack("<f", s) + _number(3, k)) for p, s, k in pieces)
    trainer = _number(3, kind) + _number(4, len(pieces)) + _number(35, int(fallback)) + _number(40, 0) + _number(41, 1) + _number(42, 2)
    normaliser = _number(3, 1) + _number(4, 0) + _number(5, 1)  # a prefix marker, no squeezing, escaped white space
    return data + _block(2, trainer) + _block(3, normaliser)


WORDS = ["▁the", "▁th", "e", "▁", "h", "t", "a", "in", "ing", "n", "g", "i", "▁in", "r", "s", "er", "▁a", "x", "re"]
TEXTS = ["the thing in the air", "", None, " lead", "tail ", "a  b", "the 漢字 thing", "xyz", "ing" * 300, "the\nrest"]


@pytest.mark.parametrize(("kind", "fallback"), [(spm.UNIGRAM, True), (spm.UNIGRAM, False), (spm.BPE, True), (spm.BPE, False)])
def test_models_built_by_hand(spark, tmp_path, kind, fallback):
    rng = np.random.default_rng(3)
    scores = -np.sort(rng.random(len(WORDS)) * 9 + 1) if kind == spm.UNIGRAM else -np.arange(len(WORDS))
    path = tmp_path / "small.model"
    path.write_bytes(_model(kind, list(zip(WORDS, map(float, scores), strict=True)), fallback))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = spm.annotate(docs, path=str(path)).orderBy("doc_id").collect()
    assert [r.pieces.parity for r in got] == [True] * len(TEXTS)
    assert [r.pieces.n_tokens for r in got][1:3] == [0, 0]
    known = [k for k, t in enumerate(TEXTS) if fallback or set(t or "") <= set("theingar sx")]
    assert all(got[k].pieces.round_trip for k in known)
    assert fallback or not got[6].pieces.round_trip  # an unknown character is lost


def test_segments_of_both_generations(monkeypatch):
    _, coder, reference = spm.load()
    monkeypatch.setattr(spm, "MEMORY", 20)
    words = [f"word{k} again" for k in range(200)]
    for at in range(0, 200, 10):
        part = words[at : at + 10] + words[:3]
        for text, (ids, back) in zip(part, coder(part), strict=True):
            assert back == text and np.frombuffer(ids, "<i4").tolist() == reference.encode(text)
