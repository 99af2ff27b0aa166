"""Ids by parts against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dagloom.llm import ids

ODD = ["a", "b", "Z", "J", "\u030c", "=", "\u0338", "'", "'s", ".", ",", ";", "ö", "Ö", "ß", "×", "÷", "İ", "Σ", " ", "\u0085", "\u00a0", "  ", "\n", "\t"]
ODD += ["1", "2", "’", "“", "–", "\u212a", "ǰ", "\x01", "<|endoftext|>", "<", "|", ">", "中", "文", "é", "\u0301", "\U0001f600", "don't", "IT'S"]


def same(code, texts):
    flat, sizes = code.encode(pa.array(texts, pa.string()))
    at = np.cumsum(sizes) - sizes
    for text, a, n in zip(texts, at.tolist(), sizes.tolist()):
        assert flat[a : a + n].tolist() == code.library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("piece", [40, 1 << 21])
def test_odd_texts(monkeypatch, piece):
    monkeypatch.setattr(ids, "PIECE", piece)
    rng = random.Random(piece)
    same(ids.encoder(), ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(4000)] + [None, "", "x" * 70_000])


def test_merges_and_full_tables(monkeypatch):
    monkeypatch.setattr(ids, "CACHE", 64)
    code = ids.PartEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(20):
        same(code, ["".join(rng.choice("aaabbeeennrstthäöß÷ ") for _ in range(rng.randrange(60))) for _ in range(60)])


def test_other_tokenizers_go_through_the_library():
    code = ids.encoder("byte_bpe_50k.json")
    assert not code.by_parts
    same(code, ["Hello wörld. foo", None, "", "a  b<|endoftext|>"])
