from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm import repeated_spans as rs
from tremor.llm.suffix_array import least_owner, suffix_array


def brute(rows: list[tuple], length: int = 50) -> dict:
    first: dict[bytes, int] = {}
    texts = sorted({(i, t.encode()) for i, t in rows if i is not None})
    for i, b in texts:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def result(df):
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rs.digests(rs.strip_repeats(df)).collect()]


def test_against_brute_force(docs, plain):
    expected, got = brute(plain), result(docs)
    assert len(got) == len(plain) and any(e[1] for e in expected.values())
    assert all(v == expected[i] for i, v in got if i is not None)
    assert all(v[1] == 0 for i, v in got if i is None)


@pytest.mark.parametrize("seed", range(3))
def test_repetitive_texts(spark, seed):
    """Few letters and spliced pieces: overlapping, adjacent and self-overlapping repeats."""
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.choice([10, 49, 50, 51, 80]))) for _ in range(6)] + ["a" * 70, "ab" * 40, "é" * 30]
    rows = [(i, "".join(rng.choice([*pieces, rng.choice("abc")]) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    assert dict(result(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty(empty):
    assert result(empty) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=70))
def test_suffix_array(symbols):
    assert suffix_array(np.array(symbols, np.int64)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=8), st.integers(1, 5))
def test_least_owner(texts, length):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owners = np.array([7 - i for i in range(len(texts))], np.int64)
    got = sorted(zip(*(x.tolist() for x in least_owner(data, offsets, owners, length))))
    every = [(i, k, t[k : k + length]) for i, t in enumerate(texts) for k in range(len(t) - length + 1)]
    assert got == sorted((i, k, min(int(owners[j]) for j, _, v in every if v == w)) for i, k, w in every)
