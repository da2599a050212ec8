"""Linkage by parts and pairing in rounds against their one-group forms."""

from __future__ import annotations

import numpy as np
import pytest

from tremor.operators import merge, stabil

POLES = "setup string, ord int, idx int, f double, d double, lam_re double, lam_im double, phi_re array<double>, phi_im array<double>"


def poles_of(rng, n, setup, spread):
    centres = rng.uniform(-0.7, 0.7, (6, 2))
    rows = []
    for i in range(n):
        re, im = centres[i % 6] + spread * rng.normal(size=2)
        phi = np.eye(3)[i % 3] + 0.2 * rng.normal(size=3)
        rows.append((setup, 2 + i // 7, i % 7, float(i), 1.0, float(re), float(im), phi.tolist(), (0.1 * rng.normal(size=3)).tolist()))
    return rows


def distances(rows):
    lam = np.array([r[5] + 1j * r[6] for r in rows])
    phi = np.array([np.array(r[7]) + 1j * np.array(r[8]) for r in rows])
    phi /= np.linalg.norm(phi, axis=1, keepdims=True)
    return abs(lam[:, None] - lam) / np.maximum(abs(lam)[:, None], abs(lam)) + 1 - abs(phi @ phi.conj().T) ** 2


@pytest.mark.parametrize("cut", [0.02, 0.1, 0.3, 0.9])
def test_linkage_by_parts_equals_that_of_all_poles(spark, cut):
    rng = np.random.default_rng(int(100 * cut))
    setups = {name: poles_of(rng, n, name, spread) for name, n, spread in (("a", 120, 0.03), ("b", 60, 0.2), ("c", 1, 0.1))}
    table = spark.createDataFrame([r for rows in setups.values() for r in rows], POLES)
    got = stabil.clusters(table, table.selectExpr("setup", "ord", "idx", "0.0D AS d_lambda", "0.0D AS d_mac"), cut).toPandas()
    assert len(got) == 181
    for name, rows in setups.items():
        own = got[got["setup"] == name].set_index(["ord", "idx"])["cluster"]
        mine = np.array([own[r[1], r[2]] for r in rows])
        want = stabil.average_linkage(distances(rows), cut)
        assert (np.equal.outer(mine, mine) == np.equal.outer(want, want)).all()
        firsts = [int(np.flatnonzero(mine == c)[0]) for c in range(mine.max() + 1)]
        assert firsts == sorted(firsts)  # numbered by the first pole


def test_parts_are_the_connected_ones():
    rng = np.random.default_rng(2)
    for n in (1, 5, 700):
        x = rng.uniform(0, n, n)
        d = abs(x[:, None] - x)
        parts = stabil.separate(lambda m, d=d: d[m], n, 1.5)
        order = np.argsort(x)
        label = np.empty(n, int)
        label[order] = np.cumsum(np.diff(x[order], prepend=x[order[0]]) > 1.5)
        assert sorted(map(tuple, parts)) == sorted(tuple(np.flatnonzero(label == k)) for k in range(label.max() + 1))


def greedy(rows):
    taken, a, b = [], set(), set()
    for r in sorted(rows, key=lambda r: (r[3], -r[4], r[1], r[2])):
        if r[1] not in a and r[2] not in b:
            taken.append(r)
            a.add(r[1])
            b.add(r[2])
    return taken


@pytest.mark.parametrize("values", [3, 10_000])
def test_pairing_in_rounds_is_greedy(spark, values):
    """Also with many ties."""
    rng = np.random.default_rng(values)
    rows = {s: [(s, int(p), int(q), float(rng.integers(values)) / values, float(rng.integers(values)) / values) for p in range(9) for q in range(11) if rng.random() < 0.6] for s in "xyz"}
    rows["x"] += [("x", 100 + i, 100 + i + j, i + 0.5 * j, 0.0) for i in range(12) for j in (0, 1)]  # one pair frees the next
    table = spark.createDataFrame([r for v in rows.values() for r in v], "setup string, mode_a int, mode_b int, d_f double, mac double")
    got = sorted(tuple(r) for r in merge.pairs(table, ["setup"]).collect())
    assert got == sorted(t for v in rows.values() for t in greedy(v))
    one = merge.pairs(table.where("setup = 'y'").drop("setup"))
    assert sorted(tuple(r) for r in one.collect()) == sorted(t[1:] for t in greedy(rows["y"]))
    assert merge.pairs(table.where("false"), ["setup"]).count() == 0
