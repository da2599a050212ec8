"""Operator 12 against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tremor.llm import conversation_trie as ct

KIND = "conv_id long, turn long, role string, text string, node string, chunk string, leaf int, conv string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    path = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(turns.get(c - int(c - 5 * int(c / 5)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = []
    for node, m in members.items():
        under = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(m) if path[c] == node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(below[node]), sum(not below[n] for n in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.12:
            continue
        for t in range(rng.choice([1, 2, 3, longest])):
            turn = None if rng.random() < 0.03 else t if rng.random() < 0.97 else 0
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"]) if rng.random() < 0.8 else f"only {c}"))
    rows += [(c, t, "user", f"hot {t}") for c in range(n, n + 60) for t in range(4)]  # one common conversation
    rows += [(2 * n + 200, t, "user", f"turn {t}") for t in range(40)] + rows[:3]  # a long one, repeated rows
    rows += [(None, 0, "user", "nobody"), (-3, 0, "user", "a"), (-5, 1, None, "b"), (-5, 0, "user", "é"), (0, 9, "x", "y")]
    rng.shuffle(rows)
    return [(*r, "x", "y", 1, "z") for r in rows]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_against_plain_trie(spark, monkeypatch, chunk):
    monkeypatch.setattr(ct, "CHUNK", chunk)
    rows = conversations(4, 50)
    found = ct.trie(spark.createDataFrame(rows, KIND).repartition(5))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == plain(rows)


def test_hot_parents_and_split_lists(spark, monkeypatch):
    """One node with many children, which are dealt to parts, and many ends, which come in several lists."""
    from tremor.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rows = [(c, t, "user", "same" if t == 0 or c % 3 else f"own {c}") for c in range(0, 1500, 5) for t in range(2)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.conv_id, r.depth): r for r in ct.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r[i] for i in range(8)) for r in found.values()} == set(plain(rows))


def test_empty(spark):
    assert ct.trie(spark.createDataFrame([], KIND)).count() == 0
