"""Identification against systems with known frequencies, damping ratios and shapes."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tremor.operators import identify, merge, signals, stabil

RATE = 20.0
F, D = np.array([1.3, 3.1, 4.7]), np.array([0.01, 0.02, 0.015])
SHAPES = np.array([[1.0, 0.6, -0.4, 0.2], [0.5, 1.0, 0.3, -0.7], [-0.2, 0.4, 1.0, 0.9]])


def free_decay(lags: int, refs: int = 2) -> np.ndarray:
    """Correlation-like functions: sums of decaying cosines weighted by the shapes."""
    t = np.arange(lags) / RATE
    w = 2 * np.pi * F
    decay = np.exp(-np.outer(w * D, t)) * np.cos(np.outer(w * np.sqrt(1 - D**2), t) + 0.3)
    return np.einsum("mc,mr,mt->crt", SHAPES, SHAPES[:, :refs], decay)


def near(modes, f_tol=1e-3, d_tol=0.05):
    for f, d, shape in zip(F, D, SHAPES):
        best = min(modes, key=lambda m: abs(m[0] - f))
        phi = best[3]
        same = abs(phi.conj() @ shape) ** 2 / ((abs(phi) ** 2).sum() * (shape**2).sum())
        assert abs(best[0] - f) < f_tol * f and abs(best[1] - 100 * d) < d_tol * 100 * d and same > 0.999


def test_ssi_cov():
    near(identify.ssi_cov(free_decay(60), 20, 20, 6, RATE))


def test_era():
    near(identify.era(free_decay(60), 20, 20, 6, RATE))


def test_prce():
    near(identify.prce(free_decay(120), 6, RATE))


def test_plscf():
    near(identify.plscf(free_decay(512), 6, RATE), 5e-3, 0.2)


def test_ssi_data_and_its_chunks_agree(spark):
    rng = np.random.default_rng(4)
    w, n = 2 * np.pi * F / RATE, 6000
    lam = np.exp(-D * w + 1j * w * np.sqrt(1 - D**2))
    y = np.zeros((n, 4))
    state = np.zeros(3, complex)
    for k in range(n):
        state = lam * state + rng.normal(size=3)
        y[k] = (SHAPES.T @ state).real
    df = spark.createDataFrame([("s", k, c, float(y[k, c])) for k in range(n) for c in range(4)], "setup string, n int, channel int, y double")
    got = [identify.ssi_data_poles(df, [1, 2], RATE, 15, range(6, 7), chunk=c).toPandas().sort_values("f") for c in (1000, 100000)]
    assert np.allclose(got[0]["f"], got[1]["f"]) and np.allclose(got[0]["d"], got[1]["d"])
    for f in F:
        assert abs(got[0]["f"] - f).min() < 0.02 * f


def test_filters_keep_slow_and_drop_fast():
    t = np.arange(800)
    slow, fast = np.sin(2 * np.pi * 0.01 * t), np.sin(2 * np.pi * 0.4 * t)
    for kind in ("butter", "cheby1"):
        sos = signals.sos_lowpass(5, 0.25, kind)
        out = signals.zero_phase(sos, slow + fast)
        assert abs(out - slow)[50:-50].max() < 0.02
        assert np.allclose(signals.zero_phase(sos, np.ones(100)), 10 ** (-0.05 / 10) if kind == "cheby1" and len(sos) % 2 == 0 else 1.0, atol=0.02)


def test_butterworth_corner():
    sos = signals.sos_lowpass(4, 0.3)
    z = np.exp(1j * np.pi * 0.3)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos])
    assert abs(abs(h) - np.sqrt(0.5)) < 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 100)), min_size=2, max_size=14, unique=True), st.floats(1, 80))
def test_average_linkage_is_the_plain_algorithm(points, cut):
    p = np.array(points) + np.random.default_rng(0).normal(size=(len(points), 2)) * 1e-3
    d = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    groups = [[i] for i in range(len(p))]
    while len(groups) > 1:
        h, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if h > cut:
            break
        groups[i] += groups.pop(j)
    got = stabil.average_linkage(d, cut)
    assert {frozenset(np.flatnonzero(got == k)) for k in set(got)} == {frozenset(g) for g in groups}


def test_selection_finds_the_modes(spark):
    r = free_decay(60) + np.random.default_rng(1).normal(size=(4, 2, 60)) * 1e-3
    corr = spark.createDataFrame([("s", c, k, lag, float(r[c, k, lag])) for c in range(4) for k in range(2) for lag in range(60)], "setup string, channel int, ref int, lag int, r double")
    poles = identify.ssi_cov_poles(corr, RATE, 20, range(6, 25, 2)).persist()
    found = stabil.representatives(stabil.clusters(poles, stabil.clearing(poles)), 3).toPandas()
    assert all(abs(found["f"] - f).min() < 0.01 * f for f in F)


def test_unknown_options():
    with pytest.raises(ValueError):
        signals.sos_lowpass(4, 0.2, "other")


def test_contributions_sum_to_one():
    r = free_decay(60)
    modes = identify.ssi_cov(r, 20, 20, 6, RATE)
    mc = identify.contributions(r, modes)
    assert len(mc) == 3 and abs(mc.sum() - 1) < 1e-6 and (mc > 0).all()
    assert len(identify.contributions(r, [])) == 0


def test_merged_shapes_restore_the_whole(spark):
    rng = np.random.default_rng(3)
    whole = {(m, n): complex(*rng.normal(size=2)) for m in range(2) for n in "abcdef"}
    rows = []
    for setup, nodes in {"s1": "abc", "s2": "abde", "s3": "abf"}.items():
        for m in range(2):
            z = complex(*rng.normal(size=2))
            rows += [(setup, m, n, 0.0, 0.0, (whole[m, n] * z).real, (whole[m, n] * z).imag) for n in nodes]
    df = spark.createDataFrame(rows, "setup string, mode int, node string, azimuth double, elevation double, re double, im double")
    got = {(r["mode"], r.node): complex(r.re, r.im) for r in merge.merged_shapes(df, "s1").collect()}
    for m in range(2):
        top = max((whole[m, n] for n in "abcdef"), key=abs)
        assert all(abs(got[m, n] - whole[m, n] / top) < 1e-9 for n in "abcdef")


