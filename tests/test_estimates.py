"""Conjugate removal, estimates by method, random phases and the caller's own functions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import identify, longfft, spectral, stabil
from tremor.operators.estimates import Estimates
from tremor.sources import store

KIND = "setup string, ord int, idx int, re double, im double"


def removed_plainly(roots: list[complex], exact: bool) -> list[int]:
    used = [i for i, z in enumerate(roots) if z.imag != 0 and (exact or z.real**2 + z.imag**2 <= 1)]
    gone = set()
    for i in used:
        same = (j for j in used if j > i and (roots[j] == roots[i].conjugate() if exact else np.isclose(roots[j], np.conj(roots[i]))))
        gone.add(next(same, None))
    return [i for i in used if i not in gone]


@pytest.mark.parametrize("exact", [True, False])
def test_conjugates(spark, exact):
    rng = np.random.default_rng(2)
    z = [complex(a, b) for a, b in rng.uniform(-0.7, 0.7, (6, 2))]
    groups = {
        1: [*z, *(v.conjugate() for v in z[::-1])],
        2: [z[0], z[0], z[0].conjugate(), z[0].conjugate(), 0.5 + 0j, -0.0 + 0j],
        3: [z[1], z[1].conjugate() + 3e-7, z[2].conjugate(), z[2] - 2e-7j, 1.2 + 0.3j, 1.2 - 0.3j, z[3], z[3].conjugate() + 1e-3],
        4: [0.3 + 0.1j, 0.30000000001 - 0.1j, 0.2999 - 0.1j],
    }
    df = spark.createDataFrame([("s", o, i, v.real, v.imag) for o, of in groups.items() for i, v in enumerate(of)], KIND)
    got = {o: [] for o in groups}
    for r in identify.without_conjugates(df, exact).orderBy("ord", "idx").collect():
        got[r.ord].append(r.idx)
    assert got == {o: removed_plainly(of, exact) for o, of in groups.items()}
    assert identify.without_conjugates(df.limit(0), exact).count() == 0


def signals_of(spark, y: np.ndarray):
    return spark.createDataFrame([("s", n, c, float(v)) for n, row in enumerate(y) for c, v in enumerate(row)], "setup string, n int, channel int, y double").cache()


def test_method_used_last(spark):
    y = np.random.default_rng(3).normal(size=(256, 2))
    found = Estimates(signals_of(spark, y), [0], 256, 8.0)
    assert found.corr_matrix is None and found.psd_matrix is None and found.lags() is None and found.n_lines is None
    for call in (found.correlations, found.correlation, found.psd, lambda: found.psd(16, "multitaper"), lambda: found.correlation(1), lambda: found.correlation(200)):
        with pytest.raises(ValueError):
            call()
    assert found.last is None
    key = ["channel", "ref", "lag"]
    table = lambda df, key: df.orderBy(*key).toPandas()["r" if "lag" in key else "re"].to_numpy()
    r = table(found.correlation(5), key)
    assert found.last == "blackman-tukey" and (found.m_lags, found.n_lines) == (5, 8)
    np.testing.assert_allclose(r[:5], [y[k:, 0] @ y[: 256 - k, 0] / (256 - k) for k in range(5)])
    welch = table(found.psd(15, "welch"), ["channel", "ref", "k"])  # an odd number is raised by one
    assert found.last == "welch" and found.n_lines == 16 and len(welch) == 18
    np.testing.assert_allclose(table(found.psd_matrix, ["channel", "ref", "k"]), welch)
    assert len(table(found.correlation(), key)) == 18 and found.last == "welch"  # the last method, not this call's default
    assert [q.tau for q in found.lags("blackman-tukey").orderBy("lag").collect()] == [0.0, 0.125, 0.25, 0.375, 0.5] and found.lags().count() == 9
    assert [q.freq for q in found.frequencies().orderBy("k").collect()] == [0.5 * k for k in range(9)]
    assert {(q.method, q.is_last) for q in found.correlations().select("method", "is_last").distinct().collect()} == {("blackman-tukey", False), ("welch", True)}
    with pytest.warns(DeprecationWarning):
        corr, psd = found.welch(32)
    assert corr.count() == 2 * 17 and psd.count() == 2 * 17
    later = found.correlation(5, "blackman-tukey")
    assert found.last == "blackman-tukey" and later.count() == 10 and found.psd().count() == 10


def test_dispatched_cross_spectra_have_a_phase(spark):
    y = np.random.default_rng(5).normal(size=200)
    both = signals_of(spark, np.stack([y, np.roll(y, 1)], 1))
    cross = spectral.spectra(both, [0, 1], 16, 200, "blackman-tukey").where("channel <> ref").toPandas()
    assert abs(cross["im"]).max() > 0.1 * abs(cross["re"]).max()
    a, b = (cross[cross["channel"] == c].sort_values("k") for c in (0, 1))
    np.testing.assert_allclose(a["re"].to_numpy(), b["re"].to_numpy(), atol=1e-9)
    np.testing.assert_allclose(a["im"].to_numpy(), -b["im"].to_numpy(), atol=1e-9)


@pytest.mark.parametrize("length", [96, 105])
def test_random_phases_keep_spectra(spark, length):
    y = np.random.default_rng(6).normal(size=(length, 2))
    lines = longfft.transform(signals_of(spark, y).select("setup", "channel", "n", F.col("y").alias("re"), F.lit(0.0).alias("im")), ["setup", "channel"], length)
    wide = lambda df: df.toPandas().pivot(index="n", columns="channel", values="y").to_numpy()
    one, same, other = (wide(longfft.random_phases(lines, length, seed)) for seed in (1, 1, 2))
    x, z = np.fft.fft(y, axis=0), np.fft.fft(one, axis=0)
    np.testing.assert_allclose(abs(z), abs(x), atol=1e-9)
    np.testing.assert_allclose(z[:, 0] * z[:, 1].conj(), x[:, 0] * x[:, 1].conj(), atol=1e-8)  # channels turn alike
    assert np.array_equal(one, same) and abs(one - other).max() > 0.1 and abs(one - y).max() > 0.1
    turned = np.angle(z[1 : length // 2, 0] / x[1 : length // 2, 0])
    assert turned.std() > 1.2  # about pi / sqrt(3) where phases spread evenly


def test_response_of_an_oscillator_to_random_phases(spark):
    frf = store.oscillator_frf(spark, 2.0, 0.02, 16.0, 128).select(F.lit("s").alias("setup"), F.lit(0).alias("channel"), "k", "re", "im")
    y = longfft.random_phases(frf, 128, 4).orderBy("n").toPandas()["y"].to_numpy()
    want = frf.orderBy("k").toPandas()
    size = np.hypot(want["re"], want["im"])
    size.iloc[-1] = abs(want["re"].iloc[-1])  # a real record has a real line at half the rate
    np.testing.assert_allclose(abs(np.fft.rfft(y)), size, rtol=1e-9)


def test_own_scale_and_own_values(spark):
    poles = spark.createDataFrame([("s", "m", o, 0, 1.0 + o / 10, 2.0, 0.1 * o, 0.5, [1.0, 2.0 * o], [0.0, 0.5]) for o in (1, 2)], identify.POLES)
    chosen = spark.createDataFrame([("s", 2, 0)], "setup string, ord int, idx int")
    doubled = identify.rescaled(poles, lambda re, im: (F.transform(re, lambda x: 2 * x), F.transform(im, lambda x: 2 * x)))
    got = stabil.modal_values(doubled, chosen, {"last": F.element_at("phi_re", -1)}).first()
    assert got["last"] == 8.0 and got["f"] == 1.2
    assert got.asDict().keys() - {"last"} == set(stabil.VALUES)
    turned = identify.rescaled(poles, lambda re, im: (im, F.transform(re, lambda x: -x)))  # each part comes from both old ones
    assert turned.columns == poles.columns and {(tuple(r.phi_re), tuple(r.phi_im)) for r in turned.collect()} == {((0.0, 0.5), (-1.0, -2.0)), ((0.0, 0.5), (-1.0, -4.0))}
    with pytest.raises(ValueError, match="f already"):
        stabil.modal_values(poles, chosen, {"f": F.lit(1)})
