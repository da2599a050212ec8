"""Exact quantiles, long transforms, modal spectra."""

from __future__ import annotations

import numpy as np
import pytest
from tests.test_modal import RATE, F, free_decay
from tests.test_subspace import frame

from tremor.operators import identify, longfft, quantiles, spectral, subspace


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(bins)
    groups = {
        "normal": rng.normal(size=401), "ties": rng.integers(0, 3, 300).astype(float), "one": np.array([2.5]), "two": np.array([1.0, 4.0]), "same": np.full(50, -7.25),
        "wide": np.concatenate([10.0 ** rng.uniform(-9, 9, 100), -(10.0 ** rng.uniform(-9, 9, 100))]), "huge": np.array([-1.7e308, 0.0, 1.0, 1.7e308]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None), ("none", None)]
    got = {r["g"]: r for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.05, 0.5, 0.95, 1.0]).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        if g != "huge":  # numpy's own interpolation overflows there
            assert np.allclose([got[g][f"q{i}"] for i in range(4)], np.quantile(values, [0.05, 0.5, 0.95, 1.0]), rtol=1e-12, atol=0), g
    assert got["huge"]["q3"] == 1.7e308


@pytest.mark.parametrize("length", [1, 12, 17, 360, 1024])
def test_long_transform_is_the_transform(spark, length):
    x = np.random.default_rng(length).normal(size=(2, length)) + 1j * np.random.default_rng(1).normal(size=(2, length))
    rows = [(str(c), n, float(x[c, n].real), float(x[c, n].imag)) for c in range(2) for n in range(length)]
    df = spark.createDataFrame(rows, "c string, n int, re double, im double")
    for inverse, want in ((False, np.fft.fft(x)), (True, np.fft.ifft(x))):
        got = longfft.transform(df, ["c"], length, inverse).toPandas().sort_values(["c", "k"])
        assert len(got) == 2 * length and np.allclose(got["re"] + 1j * got["im"], want.ravel(), atol=1e-10)


def test_impulse_responses_and_realisation(spark):
    """A known impulse response convolved with a random force comes back, and so do its poles; long and short forms agree."""
    length = 720
    h = np.zeros((3, length))
    h[:, 1:200] = free_decay(200)[:3, 0, 1:] * np.exp(-0.02 * np.arange(1, 200))
    force = np.random.default_rng(2).normal(size=length)
    window = np.hamming(length)
    y = np.fft.irfft(np.fft.rfft(h) * np.fft.rfft(window * force), length) / window  # the window divides out
    signals = spark.createDataFrame([("s", n, c, float(y[c, n])) for n in range(length) for c in range(3)], "setup string, n int, channel int, y double")
    forces = spark.createDataFrame([("s", n, float(force[n])) for n in range(length)], "setup string, n int, f double")
    found = longfft.impulse_responses(longfft.response_lines(signals, forces, length), length).toPandas().pivot(index="channel", columns="n", values="y").to_numpy()
    assert np.allclose(found, h, atol=1e-8)
    short = spectral.frequency_response(signals, forces, length).toPandas().sort_values("channel")
    assert np.allclose(np.stack(short["irf"]), found, atol=1e-8)
    poles = longfft.era_poles(signals, forces, length, RATE, 30, range(6, 7)).toPandas()
    assert all((poles["f"] - f).abs().min() < 0.02 * f for f in F)


def test_modal_spectra_sum_up_to_the_fit(spark):
    corr = frame(spark, free_decay(256) + 0.01 * np.random.default_rng(3).normal(size=(4, 2, 256)))
    parts = subspace.modal_spectra(corr, RATE, 6).toPandas()
    poles = subspace.residual_poles(corr, RATE, 6).toPandas()
    whole = parts.groupby(["channel", "ref", "k"])[["re", "im"]].sum()
    data = parts.groupby(["channel", "ref", "k"])[["data_re", "data_im"]].first()
    left = ((whole.to_numpy() - data.to_numpy()) ** 2).sum() / (data.to_numpy() ** 2).sum()
    assert np.isclose(left, poles["fit"].iloc[0], rtol=1e-8) and left < 0.1
    assert set(parts["idx"]) == {-2, -1, *range(len(poles))}
    shares = subspace.spectral_contributions(spark.createDataFrame(parts)).toPandas().set_index("idx")
    fit, x = whole.to_numpy() @ [1, 1j], data.to_numpy() @ [1, 1j]
    pairs = np.array([i[:2] for i in whole.index])
    for idx in (0, -1):
        own = parts[parts["idx"] == idx].set_index(["channel", "ref", "k"]).loc[whole.index]
        p = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        want = np.mean([(x[m].conj() @ p[m]) / np.sqrt((abs(x[m]) ** 2).sum() * (abs(fit[m]) ** 2).sum()) for c in range(4) for r in range(2) for m in [(pairs == (c, r)).all(1)]])
        assert np.isclose(complex(shares.loc[idx, "mc_re"], shares.loc[idx, "mc_im"]), want)
    assert 0.8 < shares["mc_re"].sum() <= 1 + 1e-9


def test_contributions_use_the_poles_of_every_order(spark):
    r = free_decay(60) + 0.01 * np.random.default_rng(1).normal(size=(4, 2, 60))
    got = identify.ssi_cov_contributions(frame(spark, r), RATE, 20, range(4, 9, 2)).toPandas().sort_values(["ord", "idx"])
    for order, own in got.groupby("ord"):
        modes = identify.ssi_cov(r, 20, 20, int(order), RATE)
        assert np.allclose(own["mc"], identify.contributions(r, modes)) and np.allclose(own["f"], [m[0] for m in modes])
