"""Setup and method files to modes, windows, cross spectra with phase, deviations of phases."""

from __future__ import annotations

import numpy as np
import pytest
from tests.test_kalman import frame
from tests.test_modal import RATE, F
from tests.test_subspace import ambient

from tremor.functions import modal
from tremor.operators import flow, spectral
from tremor.sources import setup_files, store

SETUP = "Setup:\nblock one\nrate\n{rate}\nrefs\n0 1\ndeleted\n4\naccel\n0 1 2 3\nvelo\n\ndisp\n\n"
FILES = {"ssi-cov": "columns\n25\norder\n20\n", "ssi-data": "columns\n12\norder\n12\n", "era": "columns\n25\norder\n16\n", "prce": "samples\n120\norder\n16\n", "plscf": "from\n0.5\nto\n{high}\nlines\n256\norder\n10\n"}


@pytest.mark.parametrize("method", list(FILES))
def test_one_call_from_files_to_modes(spark, tmp_path, method):
    y = np.hstack([ambient(3000, 3), np.zeros((3000, 1))])
    (tmp_path / "setup.txt").write_text(SETUP.format(rate=RATE))
    (tmp_path / "method.txt").write_text(FILES[method].format(high=0.45 * RATE))
    info = setup_files.setup_info(spark, str(tmp_path / "setup.txt"))
    options = flow.method_file(spark, str(tmp_path / "method.txt"), method)
    table, poles, modes = flow.single_setup(frame(spark, y), info, 3000, method, options, number=6)
    assert table.count() == 4 and {r["setup"] for r in poles.select("setup").distinct().collect()} == {"block one"}
    found = modes.toPandas()
    assert len(found) and sum((abs(found["f"] - f) < 0.03 * f).any() for f in F) >= 2


def test_bad_methods(spark):
    with pytest.raises(ValueError):
        flow.identified(None, [0], 1.0, 10, "other", {})
    with pytest.raises(ValueError):
        flow.identified(None, [0], 1.0, 10, "era", {"max_order": "4"})


def test_windows(spark):
    assert np.allclose(spectral.taper("hamming", 16), 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(16) / 16)) and np.allclose(spectral.taper("boxcar", 5), 1)
    assert np.allclose(spectral.taper("blackman", 64)[:1], 0, atol=1e-12)
    with pytest.raises(ValueError):
        spectral.taper("other", 4)
    y = ambient(640, 1)
    for window in spectral.WINDOWS:
        long, short = (spectral.psd_welch(frame(spark, y), [0], 64, 10, fft, window=window).toPandas().sort_values(["channel", "k"]) for fft in (True, False))
        assert np.allclose(long["re"], short["re"]) and np.allclose(long["im"], short["im"])


def test_cross_spectra_have_the_phase_of_a_delay(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4003)
    y = np.stack([x[3:], x[:-3]], 1)  # channel 1 is three samples late
    corr = spectral.corr_bt_chunked(frame(spark, y), [0, 1], 33, 4000)
    found = spectral.cross_spectra_bt(corr, 32, 4000).toPandas()
    late = found[(found["channel"] == 1) & (found["ref"] == 0)].sort_values("k")
    phase = np.unwrap(np.angle(late["re"] + 1j * late["im"]))
    assert np.allclose(np.diff(phase[2:30]).mean(), -3 * np.pi / 32, atol=0.02)
    own = found[found["channel"] == found["ref"]]
    assert abs(own["im"]).max() < 1e-6 * abs(own["re"]).max()


def test_deviations_of_phases(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 6)) + 1j * rng.normal(size=(20, 6))
    df = spark.createDataFrame([(i, z.real.tolist(), z.imag.tolist()) for i, z in enumerate(v)], "i int, re array<double>, im array<double>")
    for weighted in (True, False):
        for about in ("ortho", "arithm"):
            mp, mpd = modal.phase_spread(df["re"], df["im"], about, weighted)
            for row in df.select("i", mp.alias("mp"), mpd.alias("mpd")).collect():
                z = v[row["i"]]
                w = abs(z) if weighted else np.ones(6)
                if about == "ortho":
                    turn = np.arctan2(2 * (z.real @ z.imag), z.real @ z.real - z.imag @ z.imag) / 2
                    p = np.angle(z * np.exp(-1j * turn), deg=True)
                    p = np.where(p > 90, p - 180, np.where(p < -90, p + 180, p))
                    at, centre = np.degrees(turn) % 180, p.mean()
                else:
                    p = np.angle(z, deg=True) % 180
                    at = centre = np.average(p, weights=w)
                assert np.isclose(row["mp"] % 180, at) and np.isclose(row["mpd"], np.sqrt(np.average((p - centre) ** 2, weights=w)))
    with pytest.raises(ValueError):
        modal.phase_spread(df["re"], df["im"], "other")


def test_empty_state(spark, tmp_path):
    store.save_state(str(tmp_path / "s"), "alone")
    assert store.load_state(spark, str(tmp_path / "s"), "alone") == {}
