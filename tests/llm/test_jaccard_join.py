from __future__ import annotations

import random
import re

import pytest

from tremor.llm import jaccard_join as jj
from tremor.llm.components import components


def shingles(text: str) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows: list[tuple]) -> dict:
    sets = {i: shingles(t) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and comp[b] < comp[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_against_brute_force(docs, plain):
    expected = brute(plain)
    for r in jj.component_rows(docs).collect():
        assert r.doc_id is None or (r.n_shingles, r.component_id) == expected[r.doc_id]
    assert jj.component_rows(docs).count() == len(plain)


@pytest.mark.parametrize("seed", range(3))
def test_chains_and_large_groups(spark, seed):
    """Copies that drift: neighbours link, far ones do not; groups meet only through members."""
    rng = random.Random(seed)
    rows, at = [], 0
    for _ in range(3):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 60, 200]))]
        for _ in range(25):
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((at, " ".join(w)))
            at += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.component_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_that_stay(docs, plain):
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = brute(plain)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in expected.items() if i == c}


def test_empty(empty):
    assert jj.component_rows(empty).count() == 0 and jj.one_of_each(empty).count() == 0


def test_components_of_a_path(spark):
    n = 40
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.doc: r.comp for r in components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100}


def test_hot_shingles_hubs_and_tiles_are_split(spark, monkeypatch):
    """Keys of more than two rows are split and tiles hold three sets: the links stay the same."""
    from tremor.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(jj, "TILE_ROWS", 3)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    common_line = " ".join(f"c{i}" for i in range(5))
    rows += [(100 + i, common_line + " " + " ".join(f"y{i}_{k}" for k in range(rng.randint(1, 9)))) for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        monkeypatch.setattr(jj, "HUB_ROUNDS", rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jj.component_rows(frame).collect()} == brute(rows)


def test_split_join_keeps_every_row(spark):
    from tremor.llm.common import hot_keys, split_join

    many = spark.createDataFrame([(i % 3 if i < 30 else 7, i) for i in range(2000)], "k long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c"), (9, "d")], "k long, name string")
    hot = hot_keys(many.groupBy("k").count().withColumnRenamed("count", "n"), "k", 2000)
    got = sorted((r.k, r.v, r.name) for r in split_join(many, one, "k", "v", hot).collect())
    assert got == sorted((r.k, r.v, r.name) for r in many.join(one, "k").collect()) and [r["__hot"] for r in hot.collect()] == [7]


def test_first_text_of_a_repeated_id_is_compared(spark):
    near = " ".join(f"w{i}" for i in range(60))
    for other, component in (("x " * 9, 1), ("b " * 9, 5)):  # after and before the near copy in byte order
        docs = spark.createDataFrame([(1, near), (5, near + " more"), (5, other)], "doc_id long, text string")
        assert {(r["doc_id"], r["component_id"]) for r in jj.component_rows(docs).collect()} == {(1, 1), (5, component)}


def test_shared_classes_miss_none(spark, monkeypatch):
    """Against sets, with deals of a text or two and with one deal: every class that shares 80 % of its shingles is kept, and few others are."""
    import random

    from tremor.llm import jaccard_join as jj

    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for i in range(60):
        own = [f"w{rng.randrange(4000)}" for _ in range(30)]
        texts.append(" ".join(common + own if i % 3 == 0 else own))  # a passage of a third of all texts
        if i % 4 == 0:
            texts.append(" ".join([*own[:28], "x", "y"]))  # a near copy
    texts += [" ".join(common)] * 3 + ["", "a b c d e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = {r.doc_id: (r.one, r.n_shingles) for r in jj.set_digests(docs).collect()}
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in enumerate(texts)}
    by_class = {rows[i][0]: s for i, s in sets.items() if s}
    need = {one for one, s in by_class.items() if 10 * len(s & set().union(*(t for o, t in by_class.items() if o != one))) >= 8 * len(s)}
    for size in (50, 4 << 20):
        monkeypatch.setattr(jj, "DEAL_BYTES", size)
        found = {r.one for r in jj.shared_classes(docs).collect()}
        assert need <= found and len(found - need) <= 2
