"""Uncertainty against finite differences, merged setups, prediction, synthesis and residues against known systems."""

from __future__ import annotations

import numpy as np
import pytest
from tests.test_modal import RATE, SHAPES, D, F, free_decay, near

from tremor.operators import identify, subspace


def frame(spark, r, setup="s", channels=None):
    rows = [(setup, c if channels is None else channels[c], k, lag, float(r[c, k, lag])) for c in range(r.shape[0]) for k in range(r.shape[1]) for lag in range(r.shape[2])]
    return spark.createDataFrame(rows, "setup string, channel int, ref int, lag int, r double")


def test_sensitivities_are_the_derivatives():
    rng = np.random.default_rng(0)
    r = free_decay(40) + 0.02 * rng.normal(size=(4, 2, 40))
    h = subspace.hankel(r, 12, 12)
    change = rng.normal(size=h.shape) * 0.05
    told = subspace.sensitivities(h, change, np.linalg.svd(h, full_matrices=False), 4, 6, RATE)

    def modes(m):
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        o = u[:, :6] * np.sqrt(s[:6])
        return identify.modal(subspace.transition(o, 4), o[:4], RATE)

    step = 1e-6
    for t, a, b in zip(told, modes(h + step * change), modes(h - step * change)):
        assert np.isclose(t[4], (a[0] - b[0]) / (2 * step), rtol=1e-4, atol=1e-7) and np.isclose(t[5], (a[1] - b[1]) / (2 * step), rtol=1e-4, atol=1e-6)
        assert np.allclose(t[6], (a[3] - b[3]) / (2 * step), rtol=1e-3, atol=1e-6)


def test_uncertain_poles_sum_the_blocks(spark):
    rng = np.random.default_rng(2)
    blocks = [free_decay(30) + 0.01 * rng.normal(size=(4, 2, 30)) for _ in range(5)]
    df = frame(spark, blocks[0]).selectExpr("0 AS block", "*")
    for i, b in enumerate(blocks[1:], 1):
        df = df.unionByName(frame(spark, b).selectExpr(f"{i} AS block", "*"))
    got = subspace.uncertain_poles(df, RATE, 12, range(6, 7)).toPandas().sort_values("f")
    h = [subspace.hankel(b, 12, 12, 0) for b in blocks]
    mean = np.mean(h, 0)
    each = [subspace.sensitivities(mean, x - mean, np.linalg.svd(mean, full_matrices=False), 4, 6, RATE) for x in h]
    for i in range(3):
        assert np.isclose(got["std_f"].iloc[i], np.sqrt(sum(e[i][4] ** 2 for e in each) / 20)) and np.isclose(got["std_d"].iloc[i], np.sqrt(sum(e[i][5] ** 2 for e in each) / 20))
        assert np.allclose(got["std_phi"].iloc[i], np.sqrt(sum(abs(e[i][6]) ** 2 for e in each) / 20))


def test_ways_to_the_state_matrix_agree():
    r = free_decay(60)
    u, s, _ = subspace.observability(r, 20, 20)
    o = u[:, :6] * np.sqrt(s[:6])
    for how in ("pinv", "qr", "limited"):
        near(identify.modal(subspace.transition(o, 4, how, 3), o[:4], RATE))
    with pytest.raises(ValueError):
        subspace.transition(o, 4, "other")


def test_triangular_factors():
    m = np.random.default_rng(1).normal(size=(4, 7))
    low, q = subspace.lq(m)
    assert np.allclose(low @ q, m) and np.allclose(low, np.tril(low)) and (np.diag(low) >= 0).all() and np.allclose(q @ q.T, np.eye(4))
    upper, q = subspace.rq(m)
    assert np.allclose(upper @ q, m) and np.allclose(upper, np.triu(upper)) and np.allclose(q @ q.T, np.eye(4))
    q, low = subspace.ql(m.T)
    assert np.allclose(q @ low, m.T) and np.allclose(low, np.tril(low)) and np.allclose(q.T @ q, np.eye(4))


def test_merged_setups_restore_the_whole(spark):
    """Three setups see two common references and one or two other channels each, excited differently."""
    t = np.arange(60) / RATE
    w = 2 * np.pi * F
    waves = np.exp(-np.outer(w * D, t)) * np.cos(np.outer(w * np.sqrt(1 - D**2), t) + 0.3)
    shapes = np.random.default_rng(5).normal(size=(3, 6))
    shapes[:, :2] += np.sign(shapes[:, :2])
    setups = {"a": [0, 1, 2], "b": [0, 1, 3, 4], "c": [0, 1, 5]}
    corr, dofs = None, []
    for i, (name, places) in enumerate(setups.items()):
        power = 0.5 + np.random.default_rng(i).random(3)
        r = np.einsum("mc,mr,mt,m->crt", shapes[:, places], shapes[:, :2], waves, power)
        one = frame(spark, r, name)
        corr = one if corr is None else corr.unionByName(one)
        dofs += [(name, c, f"n{p}", 0.0, 0.0) for c, p in enumerate(places)]
    got = subspace.merged_poles(corr, spark.createDataFrame(dofs, "setup string, channel int, node string, azimuth double, elevation double"), RATE, 20, range(6, 7)).toPandas()
    for f, d, shape in zip(F, D, shapes):
        row = got.iloc[(got["f"] - f).abs().argmin()]
        phi = np.array(row["phi_re"]) + 1j * np.array(row["phi_im"])
        want = shape[[int(p[1]) for p in (x.split("|")[0] for x in row["places"])]]
        assert len(phi) == 6 and abs(row["f"] - f) < 1e-3 * f and abs(phi.conj() @ want) ** 2 > 0.999 * (abs(phi) ** 2).sum() * (want**2).sum()


def ambient(n, seed):
    rng = np.random.default_rng(seed)
    w = 2 * np.pi * F / RATE
    lam = np.exp(-3 * D * w + 1j * w)
    state, y = np.zeros(3, complex), np.empty((n, 4))
    for k in range(n):
        state = lam * state + rng.normal(size=3)
        y[k] = (SHAPES.T @ state).real
    return y + 0.1 * rng.normal(size=y.shape)


def correlations(y, lags):
    return np.stack([y[lag:].T @ y[: len(y) - lag] / (len(y) - lag) for lag in range(lags)], 2)


def test_synthesis_meets_the_correlations(spark):
    corr = frame(spark, free_decay(60))
    poles = identify.ssi_cov_poles(corr, RATE, 20, range(6, 7))
    synthetic = subspace.synthetic_correlations(corr, poles, 6).cache()
    assert synthetic.count() == 3 * 4 * 2 * 60 and subspace.synthesis_errors(synthetic).toPandas()["rms"].max() < 1e-8
    assert subspace.synthetic_spectra(synthetic, 60).count() == 3 * 4 * 2 * 31


def test_residues_fit_the_spectra(spark):
    got = subspace.residual_poles(frame(spark, free_decay(512)), RATE, 6).toPandas()
    assert got["fit"].iloc[0] < 0.02
    for f, shape in zip(F, SHAPES):
        row = got.iloc[(got["f"] - f).abs().argmin()]
        phi = np.array(row["phi_re"]) + 1j * np.array(row["phi_im"])
        assert abs(row["f"] - f) < 5e-3 * f and abs(phi.conj() @ shape) ** 2 > 0.98 * (abs(phi) ** 2).sum() * (shape**2).sum()


def test_setup_names_may_hold_any_character(spark):
    corr = frame(spark, free_decay(60), "a#b|1")
    synthetic = subspace.synthetic_correlations(corr, identify.ssi_cov_poles(corr, RATE, 20, range(6, 7)), 6)
    found = subspace.synthetic_spectra(synthetic, 60).select("setup", "idx").distinct().toPandas()
    assert set(found["setup"]) == {"a#b|1"} and sorted(found["idx"]) == [0, 1, 2]
