from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tremor.llm import bfd_output as bo
from tremor.llm import kk_packing as kk
from tremor.llm.tokens import WordIds, default_tokenizer

PATH = default_tokenizer()


@pytest.fixture(scope="module")
def ids(plain):
    t = Tokenizer.from_file(PATH)
    return [(i, t.encode(text, add_special_tokens=False).ids) for i, text in plain]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_cached_ids_are_the_tokenizers(text):
    text = text.encode("utf-8", "ignore").decode()
    expected = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids if len(text) < 3 else WordIds.of(PATH).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WordIds.of(PATH).ids(text.encode()), "<u4").tolist() == expected


def test_marks_and_special_strings():
    for text in ("a \x01 b\x01c", "<|endoftext|> x<|endoftext|>", "Σας ΣΑΣ İstanbul", "a b c\x0bd"):
        w = WordIds.of(PATH)
        assert np.frombuffer(w.ids(text.encode()), "<u4").tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(docs, ids):
    rows = kk.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= kk.WINDOW
    expected = defaultdict(list)
    for i, x in ids:
        code = np.array([*x, kk.END_ID], "<u4").tobytes()
        for start, length in kk.cuts(len(x) + 1, kk.WINDOW, kk.PIECE):
            expected[i].append((start, length, zlib.crc32(code[4 * start : 4 * (start + length)]), len(x) + 1))
    assert {i: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for i, v in by_doc.items()} == {i: sorted(v) for i, v in expected.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_windows_hold_and_are_near_equal(sizes):
    at = kk.pack_shard(np.array(sizes), 100)
    load = np.bincount(at, weights=sizes)
    assert load.max() <= 100 and len(at) == len(sizes) and (load > 0).all()


def test_known_differencing():
    at = kk.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(at, weights=[8, 7, 6, 5, 4])) == [14, 16]
    many = np.random.default_rng(0).integers(100, 1000, 4000)
    load = np.bincount(kk.differencing(many, 500), weights=many)
    assert load.max() - load.min() < 60


def test_cut_covers():
    assert kk.cuts(10000, 4096, 1024) == [(0, 4096), (4096, 4096), (8192, 1024), (9216, 784)]


def test_output_round_trip(docs, ids):
    streams = defaultdict(dict)
    n = 0
    for r in bo.packed_rows(docs).collect():
        row, position = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(row) == len(position) == bo.ROW and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (row[r.n_tokens :] == bo.PAD_ID).all()
        for d, s, a, b in zip(r.segment_doc_ids, r.segment_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert position[a:b].tolist() == list(range(b - a))
            streams[d].setdefault(s, []).append(row[a:b].tolist())
            n += b - a
    assert n == sum(len(x) + 1 for _, x in ids)
    for i, x in ids:
        if i is not None:
            assert sum((streams[i][s][0] for s in sorted(streams[i])), []) == [*x, bo.END_ID]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit_is_the_plain_algorithm(sizes):
    room, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            r = len(rows)
            rows.append([])
            room.append(40)
        rows[r].append(i)
        room[r] -= sizes[i]
    got = bo.best_fit_decreasing(sizes, 40)
    assert sorted(sum(got, [])) == list(range(len(sizes)))
    assert sorted(sum(sizes[i] for i in g) for g in got) == sorted(sum(sizes[i] for i in g) for g in rows)


def test_written_files(spark, docs, tmp_path):
    bo.write_packed(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert bo.digests(back).count() == back.count() > 0


def test_empty(empty):
    assert kk.pack(empty).count() == 0 and bo.packed_rows(empty).count() == 0


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        WordIds(default_tokenizer(), "<u1")
