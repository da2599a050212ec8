"""Implicit block Toeplitz matrices and summed normal equations against the gathered forms."""

from __future__ import annotations

import numpy as np
import pytest
from tests.test_modal import RATE, SHAPES, F, free_decay
from tests.test_subspace import frame

from tremor.operators import identify, implicit


def toeplitz(r, rows, cols):
    return np.block([[r[:, :, cols + i - j - 1] for j in range(cols)] for i in range(rows + 1)])


def test_products_are_those_of_the_matrix():
    rng = np.random.default_rng(0)
    r, rows, cols = rng.normal(size=(4, 3, 40)), 13, 17
    t = toeplitz(r, rows, cols)
    z, q = rng.normal(size=(cols * 3, 5)), rng.normal(size=((rows + 1) * 4, 6))
    got = np.stack([implicit.forward(x, z, rows, cols) for x in r], 1).reshape(-1, 5)
    assert np.allclose(got, t @ z)
    assert np.allclose(sum(implicit.backward(r[c], q.reshape(rows + 1, 4, 6)[:, c], rows, cols) for c in range(4)), t.T @ q)


@pytest.mark.parametrize("noise", [1e-3, 0.5])
def test_forty_singular_values(spark, noise):
    """Also with a noise floor on which the singular values hardly fall."""
    r = free_decay(120) + noise * np.random.default_rng(1).normal(size=(4, 2, 120))
    vectors, values = implicit.singular_vectors(frame(spark, r), 50, 50, 40)
    u, s, _ = np.linalg.svd(toeplitz(r, 50, 50), full_matrices=False)
    got = np.array(values.first()["s"])
    assert np.allclose(got, s[:40], rtol=1e-8, atol=1e-8 * s[0])
    rows = {x.channel: np.frombuffer(x.m).reshape(*x.size) for x in vectors.toPandas().itertuples()}
    mine = np.stack([rows[c] for c in range(4)], 1).reshape(-1, 40)
    assert np.allclose(mine.T @ mine, np.eye(40), atol=1e-7) and np.allclose(abs((mine[:, :6] * u[:, :6]).sum(0)), 1, atol=1e-6)


def poles_of(df):
    return df.toPandas().sort_values(["setup", "ord", "f", "d"]).reset_index(drop=True)


def same(one, two, tol=1e-6):
    assert len(one) == len(two) > 0
    for a, b in zip(one.itertuples(), two.itertuples()):
        assert (a.setup, a.ord, a.idx) == (b.setup, b.ord, b.idx) and np.isclose(a.f, b.f, rtol=tol) and np.isclose(a.d, b.d, rtol=tol, atol=tol)
        assert np.allclose(a.phi_re, b.phi_re, atol=1e-4) and np.allclose(a.phi_im, b.phi_im, atol=1e-4)


def test_poles_equal_those_of_the_gathered_matrix(spark):
    rng = np.random.default_rng(3)
    corr = frame(spark, free_decay(90) + 0.05 * rng.normal(size=(4, 2, 90)), "a").unionByName(frame(spark, free_decay(90)[:3] + 0.05 * rng.normal(size=(3, 2, 90)), "b"))
    same(poles_of(implicit.ssi_cov_poles(corr, RATE, 30, range(4, 13, 4))), poles_of(identify.ssi_cov_poles(corr, RATE, 30, range(4, 13, 4))))


@pytest.mark.parametrize("band", [None, (0.5, 0.45 * RATE)])
def test_fraction_by_partial_sums(spark, band):
    corr = frame(spark, free_decay(256) + 0.01 * np.random.default_rng(4).normal(size=(4, 2, 256)))
    same(poles_of(implicit.plscf_poles(corr, RATE, range(2, 7, 2), band=band)), poles_of(identify.plscf_poles(corr, RATE, range(2, 7, 2), band=band)))


def test_complex_coefficients_find_the_poles(spark):
    found = poles_of(implicit.plscf_poles(frame(spark, free_decay(1024)), RATE, range(6, 7), real=False))
    for f, shape in zip(F, SHAPES):
        row = found.iloc[(found["f"] - f).abs().argmin()]
        phi = np.array(row["phi_re"]) + 1j * np.array(row["phi_im"])
        assert abs(row["f"] - f) < 5e-3 * f and abs(phi.conj() @ shape) ** 2 > 0.98 * (abs(phi) ** 2).sum() * (shape**2).sum()


def test_complex_form_on_a_known_fraction():
    """A scalar fraction with complex coefficients is found exactly; real coefficients cannot."""
    angles = 2 * np.pi * np.arange(1, 60) / 120
    z = np.exp(1j * angles)
    top, bottom = np.array([0.3 - 0.2j, 1.1j, 0.5]), np.array([0.4 + 0.3j, -0.7j, 1.0])
    h = (top[:, None] * z ** np.arange(3)[:, None]).sum(0) / (bottom[:, None] * z ** np.arange(3)[:, None]).sum(0)
    for real, exact in ((False, True), (True, False)):
        _, _, m = implicit._normal(h[None], angles, 2, real)
        alpha = -np.linalg.lstsq(m[:2, :2], m[:2, 2:], rcond=None)[0].ravel()
        assert np.allclose(alpha, bottom[:2], atol=1e-9) == exact


def test_many_channels_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(implicit._merged, "__defaults__", (float, 2))
    r = free_decay(60)
    r = np.concatenate([r, 0.5 * r, r[:, :, :] * 0.1]) + 0.01 * np.random.default_rng(8).normal(size=(12, 2, 60))
    same(poles_of(implicit.ssi_cov_poles(frame(spark, r), RATE, 20, range(6, 7))), poles_of(identify.ssi_cov_poles(frame(spark, r), RATE, 20, range(6, 7))))
