from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.llm import exact_dedup as ed


def test_against_brute_force(docs, plain):
    groups = defaultdict(list)
    for i, t in plain:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i or 0))
    expected = []
    for i, t in plain:
        g = re.sub(r"[\x20\x09-\x0D]", "", t)
        _, missing, keep = min(groups[g])
        keep = None if missing else keep
        expected.append((str(i), str(keep), len(groups[g]), i == keep, hashlib.sha256(g.encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in ed.labelled(docs).collect()]
    assert sorted(got) == sorted(expected)


def test_rows_that_stay(docs, plain):
    kept = ed.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.where("doc_id is not null").collect()]
    assert len(texts) == len(set(texts))


def test_empty(empty):
    assert ed.labelled(empty).count() == 0 and ed.exact_dedup(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_index_is_a_dictionary(steps):
    index, model = ed.CuckooIndex(1), {}
    for put, k in steps:
        key = hashlib.sha256(str(k).encode()).digest()
        if put:
            index.put(key, k)
            model[key] = k
        else:
            assert index.delete(key) == (model.pop(key, None) is not None)
        assert len(index) == len(model)
    assert dict(index.items()) == model and all(index.get(k) == v for k, v in model.items())


def test_index_grows_and_keys_with_equal_filters_stay_apart():
    index = ed.CuckooIndex(1)
    keys = [b"\0" * 10 + i.to_bytes(22, "big") for i in range(6)] + [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert index.bits > 4 and [index.get(k) for k in keys] == list(range(len(keys)))


def test_changes(spark):
    d = [hashlib.sha256(bytes([i])).digest() for i in range(6)]
    index = spark.createDataFrame([(x,) for x in d[:4]], "digest binary")
    changes = spark.createDataFrame([("insert", d[4]), ("delete", d[0]), ("delete", d[5]), ("insert", d[1]), ("insert", None)], "op string, digest binary")
    assert {bytes(r.digest) for r in ed.apply_changes(index, changes).collect()} == set(d[1:5])


def test_one_doc_id_with_two_texts_of_a_group(spark):
    """Only the text with more code points is kept."""
    rows = [(5, "A b"), (5, "Ab"), (6, "A  b"), (7, "A  b"), (8, "c d"), (8, "cd"), (9, "cd")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(5, 6, 4, False), (6, 6, 4, True), (7, 6, 4, False), (8, 8, 3, True), (8, 8, 3, False), (9, 8, 3, False)}
