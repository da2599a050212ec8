"""Operator 11 against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from tremor.llm import bpe
from tremor.llm.tokens import default_tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(default_tokenizer())


def check(codec, library, texts):
    for text, ids in zip(texts, codec.encode_many([t.encode() for t in texts])):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text[:80]
        assert codec.decode(ids).decode() == library.decode(wanted, skip_special_tokens=False)


def test_odd_texts(codec, library):
    check(codec, library, ["", " \t\n", "Hello <|endoftext|> WORLD's", "<|ENDOFTEXT|>", "x<|startoftext|><|endoftext|>y", "ΑΣ ΣΑΣ İx", "a\x1cb\x85c\xa0d\x00", "123 ab12 don't!!! 🎉é é", "'S 'LL'd 'lL", "a" * 999])


def test_code_points(codec, library):
    """Every assigned and unassigned code point between two letters."""
    points = [chr(x) for x in range(1, 0x110000) if not 0xD800 <= x < 0xE000]
    check(codec, library, ["".join(f"a{c}B " for c in points[i : i + 2000]) for i in range(0, len(points), 2000)])


@pytest.mark.parametrize("letters", ["ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "!?.-", "aé", "ABCdefghi'st", "日本語か", "a"])
def test_long_words(codec, library, letters):
    """Words above LONG go by windows; there the order of merges matters most."""
    rng = random.Random(len(letters))
    check(codec, library, ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 40, bpe.LONG, bpe.LONG + 1, 3000, 20_000)])


def test_full_cache_and_slices(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    monkeypatch.setattr(bpe, "SLICE", 300)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    codec = bpe.Codec(default_tokenizer())
    check(codec, library, [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)])
    assert codec.held <= 5000


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200)
    assert bpe.sliding_min(x, 7).tolist() == [x[max(0, i - 7) : i + 8].min() for i in range(200)]


def test_unsafe_rules_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "aab": 3}, [("a", "ab"), ("a", "b")])


def test_table(spark, docs, rows, library, empty):
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.round_trip(docs)).collect())
    wanted = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        wanted.append((-1 if r[0] is None else r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(wanted)
    trips = bpe.round_trip(docs).where("doc_id = 3")
    assert sorted(r.text for r in bpe.decode(bpe.encode(docs.where("doc_id = 3"))).collect()) == sorted(r.decoded for r in trips.collect())
    assert bpe.digests(bpe.round_trip(empty)).count() == 0
