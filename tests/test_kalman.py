"""Factors of Hankel matrices, models with noise covariances, the Riccati equation and the recursion over chunks, against plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from tests.test_modal import RATE, SHAPES, F
from tests.test_subspace import ambient

from tremor.operators import factors, identify, kalman, spectral, subspace

KIND = "setup string, n int, channel int, y double"
ROWS = 8


def frame(spark, y, setup="s"):
    return spark.createDataFrame([(setup, n, c, float(y[n, c])) for n in range(len(y)) for c in range(y.shape[1])], KIND).repartition(5)


def explicit(y, refs, rows, keep=lambda n: True):
    order = [*refs, *(c for c in range(y.shape[1]) if c not in refs)]
    columns = factors.hankel_columns(y[:, order], len(refs), rows)
    use = np.array([keep(n) for n in range(len(columns))])
    return factors.triangular(columns[use]), int(use.sum())


def square(df):
    row = next(df.toPandas().itertuples(index=False))
    return factors.unpacked(row), row


def straight(a, c, k, y):
    """Predictor states, sample after sample."""
    x = np.zeros((len(y) + 1, len(a)))
    for n, v in enumerate(y):
        x[n + 1] = a @ x[n] + k @ (v - c @ x[n])
    return x[:-1]


@pytest.fixture(scope="module")
def y():
    return ambient(1000, 7)


def test_factors_do_not_depend_on_chunks(spark, y):
    want, cols = explicit(y, [2, 0], ROWS)
    for length, chunk in ((1000, 1000), (1000, 130), (300, 70)):
        leaves = factors.block_factors(frame(spark, y), [2, 0], ROWS, length, chunk)
        blocks = factors.merged(leaves, ["setup", "block"], "part", fan=2)
        got, row = square(factors.merged(blocks, ["setup"], "block", fan=2))
        assert row.cols == cols and list(row.channels) == [2, 0, 1, 3] and np.allclose(got, want, atol=1e-9 * abs(want).max())


def test_each_fold_leaves_out_its_block(spark, y):
    length = 210  # five blocks, the last one shorter
    leaves = factors.merged(factors.block_factors(frame(spark, y), [0, 1], ROWS, length, 60), ["setup", "block"], "part")
    for row in factors.leave_one_out(leaves).toPandas().itertuples(index=False):
        want, cols = explicit(y, [0, 1], ROWS, lambda n: n // length != row.block)
        assert row.cols == cols and np.allclose(factors.unpacked(row), want, atol=1e-9 * abs(want).max())


def test_one_block_has_no_others(spark, y):
    with pytest.raises(ValueError):
        factors.leave_one_out(factors.block_factors(frame(spark, y), [0], ROWS, 5000, 5000))


def test_doubling_equals_a_long_iteration():
    rng = np.random.default_rng(1)
    for n, m in ((2, 1), (6, 4), (12, 3)):
        a = rng.normal(size=(n, n))
        a *= 0.98 / abs(np.linalg.eigvals(a)).max()
        c, w = rng.normal(size=(m, n)), rng.normal(size=(n + m, n + m))
        noise = w @ w.T
        q, r, s = noise[:n, :n], noise[n:, n:], noise[:n, n:]
        p, k, residual = kalman.riccati(a, c, q, r, s)
        x = q.copy()
        for _ in range(20_000):
            gain = np.linalg.solve((c @ x @ c.T + r).T, (a @ x @ c.T + s).T).T
            x = a @ x @ a.T + q - gain @ (a @ x @ c.T + s).T
        assert residual < 1e-10 and np.allclose(p, x, rtol=1e-8, atol=1e-8) and np.allclose(k, gain, rtol=1e-7, atol=1e-8)


def test_no_gain_without_a_solution():
    """Correlations of no process: a lag larger than lag 0."""
    with pytest.raises(ArithmeticError):
        kalman.riccati(np.array([[0.9]]), np.array([[1.0]]), np.zeros((1, 1)), np.array([[1.0]]), np.array([[5.0]]))


def test_model_from_blocks_equals_projections(y):
    """The same least squares with explicit states over all columns."""
    r, cols = explicit(y, [0, 1], ROWS)
    low, nr, nl, n, a = r.T / np.sqrt(cols), 2, 4, 6, 2 * ROWS
    got = kalman.state_model(low, ROWS, nr, nl, n)
    h = factors.hankel_columns(y, nr, ROWS).T / np.sqrt(cols)
    project = lambda future, past: future @ np.linalg.pinv(past) @ past
    p0, p1 = project(h[a:], h[:a]), project(h[a + nl :], h[: a + nr])
    u, s, vt = np.linalg.svd(p0, full_matrices=False)
    o = u[:, :n] * np.sqrt(s[:n])
    o *= np.sign((o * (np.linalg.svd(low[a:, :a], full_matrices=False)[0][:, :n])).sum(0))
    now, after = np.linalg.pinv(o) @ p0, np.linalg.pinv(o[:-nl]) @ p1
    both = np.vstack([after, h[a : a + nl]])
    model = both @ np.linalg.pinv(now)
    rest = both - model @ now
    noise = rest @ rest.T
    for mine, want in zip(got, (model[:n], model[n:], noise[:n, :n], noise[n:, n:], noise[:n, n:])):
        assert np.allclose(mine, want, atol=1e-8 * max(abs(want).max(), 1))


def test_states_equal_a_straight_pass():
    rng = np.random.default_rng(4)
    f = rng.normal(size=(5, 5))
    f *= 0.97 / abs(np.linalg.eigvals(f)).max()
    for n in (0, 1, 2, 7, 1000):
        u, x = rng.normal(size=(n, 5)), [rng.normal(size=5)]
        for v in u:
            x.append(f @ x[-1] + v)
        assert np.allclose(kalman.states(f, u, x[0]), x, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize(("chunk", "fan"), [(2000, 64), (64, 64), (7, 3), (64, 2)])
def test_modal_parts_do_not_depend_on_chunks(spark, monkeypatch, y, chunk, fan):
    monkeypatch.setattr(kalman.carried, "__defaults__", (fan,))
    signals = frame(spark, y)
    models = kalman.kalman_models(factors.merged(factors.block_factors(signals, [0, 1], ROWS, 1000, 300), ["setup"], "part"), ["setup"], ROWS, [6])
    row = next(models.toPandas().itertuples(index=False))
    a, c, k = kalman.matrices(row)
    assert row.residual < 1e-8 and row.radius < 1
    parts = kalman.modal_signals(signals, models, RATE, chunk).toPandas()
    whole = parts.groupby(["n", "channel"])["y"].sum().unstack().to_numpy()
    want = straight(a, c, k, y) @ c.T
    assert whole.shape == y.shape and np.allclose(whole, want, rtol=0, atol=1e-10 * abs(y).max())
    assert all(abs(parts["f"].unique() - f).min() < 0.03 * f for f in F)
    assert ((y - want)[200:] ** 2).mean() < 0.6 * (y**2).mean()


def test_gaps_count_as_zeros(spark, y):
    """Samples and whole chunks may be missing."""
    zeroed = y.copy()
    zeroed[100:260] = 0
    signals = frame(spark, y).where("n < 100 OR n >= 260")
    models = kalman.kalman_models(factors.merged(factors.block_factors(frame(spark, y), [0], ROWS, 1000, 300), ["setup"], "part"), ["setup"], ROWS, [6])
    a, c, k = kalman.matrices(next(models.toPandas().itertuples(index=False)))
    parts = kalman.modal_signals(signals, models, RATE, 32).toPandas()
    whole = parts.groupby(["n", "channel"])["y"].sum().unstack()
    assert np.allclose(whole.loc[300:].to_numpy(), (straight(a, c, k, zeroed) @ c.T)[300:], atol=1e-9)


def test_signal_contributions(spark, y):
    signals = frame(spark, y)
    models = kalman.kalman_models(factors.merged(factors.block_factors(signals, [0, 1], ROWS, 1000, 300), ["setup"], "part"), ["setup"], ROWS, [6])
    mc = subspace.signal_contributions(signals, kalman.modal_signals(signals, models, RATE, 128)).toPandas()
    assert 0.5 < mc["mc"].sum() < 1.2 and len(mc) == 3


def test_cross_validation_by_factors(spark):
    y, length = ambient(1500, 4), 400  # the last fold is shorter
    got = subspace.cross_validated_lq(frame(spark, y), [0, 1], ROWS, [2, 6], length, chunk=150).toPandas().sort_values(["fold", "ord"])
    assert len(got) == 8
    for row in got.itertuples():
        r, cols = explicit(y, [0, 1], ROWS, lambda n: n // length != row.fold)
        a, c, *noise = kalman.state_model(r.T / np.sqrt(cols), ROWS, 2, 4, row.ord)
        _, k, _ = kalman.riccati(a, c, *noise)
        own = y[row.fold * length : (row.fold + 1) * length]
        wrong = (own - straight(a, c, k, own) @ c.T)[length // 5 :]
        assert np.isclose(row.error, np.sqrt((wrong**2).sum() / (own[length // 5 :] ** 2).sum()), rtol=1e-8)
    error = got.groupby("ord")["error"].mean()
    assert error[6] < error[2] < 1.05


def test_cross_validation_by_covariances(spark):
    y = ambient(3000, 4)
    rows = []
    for b in range(3):
        part = y[1000 * b : 1000 * b + 1000]
        r = np.stack([part[lag:].T @ part[: 1000 - lag] / (1000 - lag) for lag in range(32)], 2)
        rows += [("s", b, c, k, lag, float(r[c, k, lag])) for c in range(4) for k in range(4) for lag in range(32)]
    got = subspace.cross_validated(frame(spark, y), spark.createDataFrame(rows, "setup string, block int, channel int, ref int, lag int, r double"), 12, [2, 6], 1000, chunk=130).toPandas()
    known = got[got["error"].notna()]
    assert len(got) == 6 and len(known) and (known["error"] < 0.9).all()
    for row in got[got["error"].isna()].itertuples():  # null only where the correlations are those of no process
        r = np.zeros((4, 4, 32))
        for _, b, c, k, lag, v in rows:
            if b != row.fold:
                r[c, k, lag] += v / 2
        with pytest.raises(ArithmeticError):
            subspace.innovation_model(r, range(4), 12, row.ord)


def test_projections_of_blocks(spark, y):
    """They equal the rotation of every block's factor by the orthonormal factor of all past parts beside one another."""
    length, refs, a = 250, [1, 3], 2 * ROWS
    leaves = factors.merged(factors.block_factors(frame(spark, y), refs, ROWS, length, 90), ["setup", "block"], "part").cache()
    from pyspark.sql import functions as S

    whole = factors.merged(leaves, ["setup"], "block").withColumn("blocks", S.lit(4).cast("long"))
    got = factors.projections(leaves, whole, ROWS).toPandas().sort_values("block")
    lows = [explicit(y, refs, ROWS, lambda n, b=b: n // length == b)[0].T for b in range(4)]
    _, q = subspace.lq(np.hstack([x[:a, :a] for x in lows]))
    for b, row in enumerate(got.itertuples()):
        want = 4 * lows[b][a:, :a] @ q[:, b * a : (b + 1) * a].T
        assert np.allclose(np.frombuffer(row.h).reshape(*row.size), want, atol=1e-8 * abs(want).max())
    total, _ = explicit(y, refs, ROWS)
    assert np.allclose(sum(np.frombuffer(h).reshape(*s) for h, s in zip(got["h"], got["size"])) / 4, total.T[a:, :a], atol=1e-8 * abs(total).max())


@pytest.mark.parametrize("how", ["pinv", "qr"])
def test_deviations_of_both_routes(spark, how):
    """On a known system projections and covariances tell deviations of one size, and a true value lies within a few of them."""
    y = ambient(6000, 9)
    signals = frame(spark, y)
    own = subspace.uncertain_poles_of_projections(signals, [0, 1], RATE, 12, range(6, 7), 300, chunk=150, how=how).toPandas().sort_values("f")
    cov = subspace.uncertain_poles(spectral.block_covariances(signals, [0, 1], 26, 300, 20), RATE, 12, range(6, 7), how).toPandas().sort_values("f")
    for f, shape, p, c in zip(F, SHAPES, own.itertuples(), cov.itertuples()):
        assert abs(p.f - f) < 4 * p.std_f and abs(c.f - f) < 4 * c.std_f
        assert 0.5 < p.std_f / c.std_f < 2 and 0.4 < p.std_d / c.std_d < 2.5 and len(p.std_phi) == 4


def test_derivatives_by_qr():
    """Finite differences, whichever way the shift equation is solved."""
    rng = np.random.default_rng(0)
    h = rng.normal(size=(40, 8)) @ rng.normal(size=(8, 24)) + 0.1 * rng.normal(size=(40, 24))
    change = rng.normal(size=h.shape) * 0.05
    svd = np.linalg.svd(h, full_matrices=False)
    one, two = (subspace.sensitivities(h, change, svd, 4, 6, RATE, how) for how in ("pinv", "qr"))

    def modes(m):
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        o = u[:, :6] * np.sqrt(s[:6])
        return identify.modal(subspace.transition(o, 4, "qr"), o[:4], RATE)

    step = 1e-6
    assert one and len(one) == len(two)
    for s, t, a, b in zip(one, two, modes(h + step * change), modes(h - step * change)):
        assert np.isclose(s[4], t[4]) and np.isclose(s[5], t[5]) and np.allclose(s[6], t[6])
        assert np.isclose(t[4], (a[0] - b[0]) / (2 * step), rtol=1e-4, atol=1e-6) and np.isclose(t[5], (a[1] - b[1]) / (2 * step), rtol=1e-4, atol=1e-5)
