"""Operator 13 against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import hard_negatives as hn

KIND = "vec_id long, embedding array<float>, label int, v string, akey string, group int"


def plain(rows):
    sound = [(i, lab, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in sound), default=0)
    ids, labels = np.array([r[0] for r in sound]), np.array([r[1] for r in sound])
    x = np.stack([np.pad(v, (0, width - len(v))) for _, _, v in sound]) if sound else np.zeros((0, 0), np.int64)
    out, asked = [], {}
    for a in range(len(ids)):
        if ids[a] % 50 == 0:
            asked.setdefault((int(ids[a]), int(labels[a]), x[a].tobytes()), a)
    for a in asked.values():
        score = x @ x[a]
        order = np.lexsort((labels, ids, -score))
        near = [i for i in order if ids[i] != ids[a] and labels[i] == labels[a]][:5]
        for p in near:
            far = [i for i in order if ids[i] != ids[a] and labels[i] != labels[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            out += [(int(ids[a]), int(ids[p]), k + 1, int(ids[i]), int(score[p]), int(score[i])) for k, i in enumerate(far)]
    return sorted(out)


def table(seed=1, n=900, dims=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = (centres[i % 6] + rng.normal(size=dims) * rng.choice([0.1, 0.6])) / 3
        v = np.round(v, 1) if i % 5 == 0 else v  # ties
        rows.append((i, v.tolist(), int(rng.integers(0, 4)) if i % 6 else 2))
    hot = rows[7][1]
    rows += [(n + i, hot, i % 2) for i in range(300)]  # one common vector under two labels
    rows += [(50, None, 1), (51, [0.5, None], 1), (52, [float("nan")] * dims, 2), (None, hot, 1), (53, hot, None), (100, [0.25] * 5, 3), (100, [0.25] * 5, 3), (150, [], 1), (200, [0.0] * dims, 0)]
    return [(*r, "x", "y", 3) for r in rows]


def found(spark, rows):
    all_ = hn.mining_rows(spark.createDataFrame(rows, KIND).repartition(4))
    return sorted(tuple(r) for r in hn.mine(all_, all_.where(F.col("vec_id") % 50 == 0)).collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many groups, tiles and blocks; a sample smaller than the table
        for name, value in (("GROUP_ROWS", 150), ("TILE_ROWS", 7), ("BLOCK_ROWS", 40), ("HELD_ROWS", 100), ("SAMPLE_ROWS", 200)):
            monkeypatch.setattr(hn, name, value)
    rows = table()
    assert found(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(7, [1.0, 2.0], 1, "", "", 0)]) == []  # no anchor
    assert found(spark, [(50, [1.0, 2.0], 1, "", "", 0)]) == []  # no candidate


def lists_of(x, ids, labels, clusters=8):
    return hn.Lists(ids, labels, x, hn.kmeans(x, clusters))


def test_bounds_hold_and_save_work():
    """Every score lies within its cluster's bounds; tight clusters are skipped."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(8, 16))[np.arange(4000) % 8] * 300 + rng.normal(size=(4000, 16)) * 10).astype(np.int64)
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    lists, q = lists_of(x, ids, labels), x[:40]
    least, most = lists.bounds(q, lists.radius)
    for c in range(len(lists.centres)):
        score = q @ lists.x[lists.start[c] : lists.start[c + 1]].T
        assert (score >= least[:, c][:, None]).all() and (score <= most[:, c][:, None]).all()
    held, done = hn.positives(lists, ids[:40], labels[:40], q)
    assert done < 0.4 * 40 * np.bincount(labels).min()
    windows = hn.windows_of(np.full((40, 5), int((x[0] @ x[0]))))
    _, visited = hn.negatives(lists, ids[:40], labels[:40], windows, q)
    assert visited < 0.7 * 40 * 4000


def test_windows():
    for p in range(0, 400):
        low, high = hn.windows_of(np.array([p]))[0]
        assert [s for s in range(0, 500) if 50 * p <= 100 * s <= 95 * p] == list(range(low, high + 1))


def test_large_components(spark):
    """Sums beyond 2 ** 53 are taken in integers."""
    rows = [(50, [3e5, 1.0], 1, "", "", 0), (1, [3e5, 2.0], 1, "", "", 0), (2, [2e5, 3.0], 2, "", "", 0), (3, [2e5, 4.0], 2, "", "", 0)]
    assert found(spark, rows) == plain(rows) and len(plain(rows)) == 2
