"""Filters against the plain recurrence and their defining properties; stored states; channel metadata from files."""

from __future__ import annotations

import numpy as np
import pytest

from tremor.operators import channels, geometry, signals
from tremor.sources import setup_files, store


def response(sos, share):
    z = np.exp(1j * np.pi * np.asarray(share, float))
    return np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos], axis=0)


def plain_zero_phase(sos, x):
    """Forward and backward recurrence with the steady state of the first value, sample by sample."""

    def one_way(x):
        for b0, b1, b2, _, a1, a2 in sos:
            y = (b0 + b1 + b2) / (1 + a1 + a2) * x[0]
            s2 = b2 * x[0] - a2 * y
            s1 = b1 * x[0] - a1 * y + s2
            out = []
            for v in x:
                y = b0 * v + s1
                s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
                out.append(y)
            x = np.array(out)
        return x

    pad = signals.edge(sos)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return one_way(one_way(wide)[::-1])[::-1][pad : pad + len(x)]


KINDS = ("butter", "cheby1", "cheby2", "ellip", "bessel")


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("corners", [(0.3, None), (None, 0.3), (0.5, 0.2)])
@pytest.mark.parametrize("order", [3, 4])
def test_filters_are_the_plain_recurrence(kind, corners, order):
    sos = signals.sections(order, *corners, kind, 0.5, 40.0)
    x = np.cumsum(np.random.default_rng(order).normal(size=700))
    assert np.allclose(signals.zero_phase(sos, x), plain_zero_phase(sos, x), atol=1e-8 * abs(x).max())


@pytest.mark.parametrize("order", [4, 5])
def test_responses_hold_their_limits(order):
    f = np.linspace(0.001, 0.999, 2000)
    size = lambda *a: 20 * np.log10(abs(response(signals.sections(order, 0.3, None, *a), f)) + 1e-300)
    corner = lambda *a: 20 * np.log10(abs(response(signals.sections(order, 0.3, None, *a), 0.3)))
    assert abs(corner("butter") + 10 * np.log10(2)) < 1e-9 and abs(corner("cheby1", 0.5) + 0.5) < 1e-9 and abs(corner("cheby2", 3, 40) + 40) < 1e-9 and abs(corner("ellip", 0.5, 40) + 0.5) < 1e-6
    for kind in ("cheby1", "ellip"):
        g = size(kind, 0.5, 40)
        assert g[f <= 0.3].max() < 1e-6 and g[f <= 0.3].min() > -0.5 - 1e-6
    for kind, edge in (("cheby2", 0.3), ("ellip", 0.45)):
        assert size(kind, 0.5, 40)[f >= edge].max() < -40 + 1e-6
    high, band = abs(response(signals.sections(order, None, 0.3), f)), abs(response(signals.sections(order, 0.5, 0.2), f))
    assert high[f > 0.6].min() > 0.99 and high[f < 0.1].max() < 0.02 and band[(f > 0.3) & (f < 0.35)].min() > 0.99 and band[(f < 0.05) | (f > 0.9)].max() < 0.02
    phase = np.unwrap(np.angle(response(signals.sections(order, 0.05, None, "bessel"), f[:100])))
    assert np.ptp(np.diff(phase)[:60]) < 0.02 * abs(np.diff(phase)[0])  # constant group delay


def test_chunks_are_the_whole(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=(900, 2)), 0)
    df = spark.createDataFrame([("s", n, c, float(x[n, c])) for n in range(900) for c in range(2)], "setup string, n int, channel int, y double")
    for kind, low, high in (("cheby1", 3.0, None), ("butter", 4.0, 1.0), ("ellip", None, 2.0)):
        sos = signals.sections(4, low and low / 10, high and high / 10, kind, 0.5, 40.0)
        got = signals.filter_signals(df, 20.0, low, high, 4, kind, 0.5, 40.0, chunk=64).toPandas().pivot(index="n", columns="channel", values="y")
        assert got.shape == x.shape and all(np.allclose(got[c], plain_zero_phase(sos, x[:, c]), atol=1e-8 * abs(x).max()) for c in range(2))
    with pytest.raises(ValueError):
        signals.filter_signals(df, 20.0)


def test_taps():
    for low, high, at in ((0.3, None, 0.0), (None, 0.3, 1.0), (0.5, 0.2, 0.35)):
        t = np.array(signals.band_taps(81, low, high))
        h = abs(np.exp(-1j * np.pi * np.outer([at, 0.05 if low is None else 0.9], np.arange(81))) @ t)
        assert abs(h[0] - 1) < 1e-9 and h[1] < 0.01


def test_states_and_loaders(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "k int, f double")
    store.save_state(str(tmp_path / "state"), "m1", psd=a, poles=a.withColumn("d", a["f"]))
    back = store.load_state(spark, str(tmp_path / "state"), "m1")
    assert set(back) == {"psd", "poles"} and back["poles"].first().d == 2.0
    with pytest.raises(ValueError):
        store.load_state(spark, str(tmp_path / "state"), "m2")
    (tmp_path / "y.txt").write_text("1 2\n3 4\n")
    assert store.load_measurement(spark, str(tmp_path / "y.txt"), "m1").count() == 4
    store.register_loader(".dat", lambda s, path, setup: s.createDataFrame([(setup, 0, 0, 1.0)], "setup string, n int, channel int, y double"))
    assert store.load_measurement(spark, "x.dat", "m1").first().y == 1.0
    with pytest.raises(ValueError):
        store.load_measurement(spark, "x.unknown")
    (tmp_path / "grid.txt").write_text("node x y z\na 0 0 0\n")
    assert {k: v.count() for k, v in store.load_geometry(spark, str(tmp_path / "grid.txt")).items()} == {"nodes": 1, "lines": 0, "parent_childs": 0}
    store.export_modes(spark.createDataFrame([(0, 1.25, 2.5)], "mode int, f double, d double"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/text")).first().value == "0\t1.250000\t2.500000" and spark.read.json(str(tmp_path / "out/json")).first().f == 1.25


def test_synthetic_signals_have_their_modes(spark):
    y = store.ambient_response(spark, [1.3, 3.1], [0.02, 0.02], [[1.0, 0.5], [-0.4, 1.0]], 20.0, 20000, block=5000)
    wide = y.toPandas().pivot(index="n", columns="channel", values="y")
    assert wide.shape == (20000, 2)
    psd = abs(np.fft.rfft(wide[0].to_numpy().reshape(-1, 1000), axis=1)).mean(0)
    assert abs(psd[20:100].argmax() + 20 - 65) <= 2
    frf = store.oscillator_frf(spark, 5.0, 0.05, 50.0, 1000).toPandas()
    assert abs(frf.loc[np.hypot(frf["re"], frf["im"]).idxmax(), "freq"] - 5.0 * np.sqrt(1 - 2 * 0.05**2)) < 0.05


def test_setup_files_end_to_end(spark, tmp_path):
    info = setup_files.Setup("m1", 10.0, [2, 3], [1], {"accel": [0], "velo": [2, 3], "disp": []})
    y = spark.createDataFrame([("", n, c, float(10 * n + c)) for n in range(3) for c in range(4)], "setup string, n int, channel int, y double")
    dofs = spark.createDataFrame([(0, "a", 0.0, 0.0, "ax"), (2, "b", 0.0, 0.0, None), (3, "b", 90.0, 0.0, "by")], "channel int, node string, azimuth double, elevation double, name string")
    moved, table = channels.prepared(y, info, dofs)
    assert sorted((r.setup, r.n, r.channel, r.y) for r in moved.collect()) == [("m1", n, c, float(10 * n + o)) for n in range(3) for c, o in enumerate((0, 2, 3))]
    assert [tuple(r) for r in table.select("channel", "name", "quantity", "is_ref").orderBy("channel").collect()] == [(0, "ax", "accel", False), (1, "Channel_1", "velo", True), (2, "by", "velo", True)]
    with pytest.raises(ValueError):
        channels.retagged(table, "force", [0])


def test_cycles_of_dependent_nodes_stay_without(spark):
    links = spark.createDataFrame([("a", 1.0, 0.0, 0.0, "b", 1.0, 0.0, 0.0), ("x", 1.0, 0.0, 0.0, "y", 1.0, 0.0, 0.0), ("y", 1.0, 0.0, 0.0, "x", 1.0, 0.0, 0.0)], "parent string, px double, py double, pz double, child string, cx double, cy double, cz double")
    moves = spark.createDataFrame([(0, "a", axis, 1.0, 0.0) for axis in "xyz"], "mode int, node string, axis string, re double, im double")
    assert {r.node for r in geometry.with_dependent(moves, links).collect()} == {"a", "b"}
