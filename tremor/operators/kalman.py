"""State-space models with noise covariances, the steady Kalman predictor, and its recursion as a scan over chunks.

Models come from the triangular factor of a block Hankel matrix alone.  The gain solves the Riccati equation by
structure-preserving doubling; its residual is checked, so no gain is returned that does not solve it.  The recursion
x[n + 1] = (A - K C) x[n] + K y[n] is affine: a chunk of samples is a map (power of the matrix, vector), maps are
composed over chunks in rounds of ``FAN``, and every chunk then runs from its exact first state.  Results do not depend on the chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.factors import unpacked
from tremor.operators.identify import one_of_pairs

FAN = 64
#: Largest residual of the Riccati equation, over the size of its terms.
TOLERANCE = 1e-8
MODEL = "ord int, channels array<int>, cols long, a array<double>, c array<double>, k array<double>, q array<double>, r array<double>, s array<double>, residual double, radius double"


def riccati(a: np.ndarray, c: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P, K, residual) of P = A P A' + Q - K (C P C' + R) K' with K = (A P C' + S)(C P C' + R)^-1; the closed loop A - K C is stable.

    Raises ArithmeticError where no such P was found."""
    ri_c, ri_s = np.linalg.solve(r, c), np.linalg.solve(r, s.T)
    f, g, h = (a - s @ ri_c).T, c.T @ ri_c, q - s @ ri_s
    eye = np.eye(len(a))
    for _ in range(60):  # the error is squared every round
        w = eye + g @ h
        half = np.linalg.solve(w, np.hstack([f, g]))
        f1, g1 = half[:, : len(a)], half[:, len(a) :]
        step = f.T @ h @ f1
        f, g, h = f @ f1, g + f @ g1 @ f.T, h + step
        g, h = (g + g.T) / 2, (h + h.T) / 2
        if not np.isfinite(h).all():
            break
        if abs(step).max() <= 1e-15 * abs(h).max():
            break
    if not np.isfinite(h).all():
        raise ArithmeticError("the Riccati equation has no finite solution")
    inner, cross = c @ h @ c.T + r, a @ h @ c.T + s
    k = np.linalg.solve(inner.T, cross.T).T
    left = a @ h @ a.T + q - k @ cross.T - h
    residual = float(abs(left).max() / max(abs(h).max(), abs(q).max(), abs(a @ h @ a.T).max(), 1e-300))
    if residual > TOLERANCE or abs(np.linalg.eigvals(a - k @ c)).max() > 1 + 1e-9:
        raise ArithmeticError(f"the Riccati equation is not solved: residual {residual:.1e}")
    return h, k, residual


def state_model(low: np.ndarray, rows: int, nr: int, nl: int, order: int) -> tuple[np.ndarray, ...]:
    """(A, C, Q, R, S) from the lower triangular factor of a Hankel matrix over the square root of its columns.

    States are projections of the future onto the past, one step apart; all are combinations of the same orthonormal rows, so the
    least-squares problem and the covariances of its residuals need the factor's blocks only."""
    past = rows * nr
    here, wide = slice(past, past + nl), past + nl
    u, s, vt = np.linalg.svd(low[past:, :past], full_matrices=False)
    n = min(order, int((s > 1e-12 * s[0]).sum()))
    o = u[:, :n] * np.sqrt(s[:n])
    now, after = np.zeros((n, wide)), np.zeros((n, wide))
    now[:, :past] = np.sqrt(s[:n])[:, None] * vt[:n]
    after[:, : past + nr] = np.linalg.lstsq(o[:-nl], low[past + nl :, : past + nr], rcond=None)[0]
    both = np.vstack([after, low[here, :wide]])
    model = both @ np.linalg.pinv(now)
    rest = both - model @ now
    noise = rest @ rest.T
    return model[:n], model[n:], noise[:n, :n], noise[n:, n:], noise[:n, n:]


def kalman_models(factors: DataFrame, keys: Sequence[str], rows: int, orders: Sequence[int]) -> DataFrame:
    """keys, ord, channels, A, C, K, Q, R, S, residual and radius (of the closed loop) from one factor per ``keys``; channels in their own order."""
    kinds = dict(factors.dtypes)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                low, channels = unpacked(row).T / np.sqrt(row.cols), np.array(row.channels)
                at = np.argsort(channels)
                for order in orders:
                    a, c, q, r, s = state_model(low, rows, row.nr, len(channels), order)
                    c, r, s = c[at], r[np.ix_(at, at)], s[:, at]
                    _, k, residual = riccati(a, c, q, r, s)
                    radius = float(abs(np.linalg.eigvals(a - k @ c)).max())
                    yield pd.DataFrame(
                        {x: [getattr(row, x)] for x in keys}
                        | {"ord": [int(order)], "channels": [channels[at].tolist()], "cols": [row.cols]}
                        | {n: [m.ravel().tolist()] for n, m in zip("ackqrs", (a, c, k, q, r, s))}
                        | {"residual": [residual], "radius": [radius]}
                    )

    return factors.mapInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {MODEL}")


def matrices(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, C, K) of a row of a model table."""
    nl = len(row.channels)
    n = len(row.c) // nl
    return np.array(row.a).reshape(n, n), np.array(row.c).reshape(nl, n), np.array(row.k).reshape(n, nl)


def states(f: np.ndarray, inputs: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """x[0 .. n] of x[i + 1] = f x[i] + inputs[i]: each round adds the sums that end twice as far back."""
    s = inputs.copy()
    if len(s):
        s[0] += f @ x0
    power, back = f, 1
    while back < len(s):
        s[back:] += s[:-back] @ power.T
        power, back = power @ power, 2 * back
    return np.vstack([x0, s])


def packed(signals: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """keys, place, samples: one row per chunk of every key."""
    place = F.floor(F.col("n") / chunk).cast("long").alias("place")
    return signals.groupBy(*keys, place).agg(F.collect_list(F.struct((F.col("n") % chunk).cast("int").alias("n"), "channel", "y")).alias("samples"))


def dense(samples: list, channels: Sequence[int]) -> np.ndarray:
    """(samples up to the last one, channels); missing samples are 0."""
    at = {c: i for i, c in enumerate(channels)}
    n = np.array([x["n"] for x in samples])
    out = np.zeros((int(n.max()) + 1, len(at)))
    out[n, [at[x["channel"]] for x in samples]] = [x["y"] for x in samples]
    return out


def _loop(row) -> tuple[np.ndarray, np.ndarray]:
    a, c, k = matrices(row)
    return a - k @ c, k


def carried(ends: DataFrame, models: DataFrame, keys: Sequence[str], length: int, fan: int = FAN) -> DataFrame:
    """keys, place, x0: the state at the start of every place, from 0 at the start of place 0.

    ``ends``: keys, place, b, where b is the state that a place of ``length`` samples ends in from 0.  Places are composed in groups of ``fan``,
    the groups are carried the same way, and each group's places then start from its first state."""
    kinds = dict(ends.dtypes)
    most = ends.agg(F.max("place")).first()[0] or 0
    home = F.floor(F.col("place") / fan).alias("home")
    groups = ends.groupBy(*keys, home).agg(F.sort_array(F.collect_list(F.struct("place", "b"))).alias("ends"))
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def walk(row, x: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        power = np.linalg.matrix_power(_loop(row)[0], length)
        at, seen = row.home * fan, []
        for end in row.ends:
            x = np.linalg.matrix_power(power, end["place"] - at) @ x  # places without samples
            seen.append((end["place"], x))
            x, at = power @ x + np.array(end["b"]), end["place"] + 1
        return seen, np.linalg.matrix_power(power, (row.home + 1) * fan - at) @ x

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _, x = walk(row, np.zeros(len(row.ends[0]["b"])))
                yield pd.DataFrame({k: [getattr(row, k)] for k in keys} | {"place": [row.home], "b": [x.tolist()]})

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                seen, _ = walk(row, np.array(row.x0) if row.x0 is not None else np.zeros(len(row.ends[0]["b"])))
                yield pd.DataFrame({k: [getattr(row, k)] * len(seen) for k in keys} | {"place": [p for p, _ in seen], "x0": [x.tolist() for _, x in seen]})

    known = groups.join(models, list(keys))
    if most >= fan:
        starts = carried(known.mapInPandas(up, f"{head}, place long, b array<double>"), models, keys, length * fan, fan)
        known = known.join(starts.withColumnRenamed("place", "home"), [*keys, "home"])
    else:
        known = known.withColumn("x0", F.lit(None).cast("array<double>"))
    return known.mapInPandas(down, f"{head}, place long, x0 array<double>")


def filtered(signals: DataFrame, models: DataFrame, keys: Sequence[str], chunk: int, emit: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``emit(row, first, y, x)`` for every chunk: its first sample number, samples (n, channels) and predictor states x[0 .. n - 1].

    Models meet chunks, one row each, not samples.  Samples are numbered from 0 in every key; missing ones count as 0."""
    own = models.select(*keys, "channels", "a", "c", "k")
    chunks = packed(signals, keys, chunk)
    kinds = dict(signals.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                loop, k = _loop(row)
                y = dense(row.samples, row.channels)
                x = states(loop, y @ k.T, np.zeros(len(loop)))[-1]
                x = np.linalg.matrix_power(loop, chunk - len(y)) @ x
                yield pd.DataFrame({k: [getattr(row, k)] for k in keys} | {"place": [row.place], "b": [x.tolist()]})

    starts = carried(chunks.join(own, list(keys)).mapInPandas(end, f"{head}, place long, b array<double>"), own, keys, chunk)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                loop, k = _loop(row)
                y = dense(row.samples, row.channels)
                yield emit(row, int(row.place) * chunk, y, states(loop, y @ k.T, np.array(row.x0))[:-1])

    return chunks.join(starts, [*keys, "place"]).join(own, list(keys)).mapInPandas(run, schema)


def modal_signals(signals: DataFrame, models: DataFrame, rate: float, chunk: int = 1 << 14) -> DataFrame:
    """setup, n, channel, idx, f, y: the part of every mode in the predicted signals of one model per setup."""

    def emit(row, first: int, y: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        a, c, _ = matrices(row)
        lam, psi = np.linalg.eig(a)
        modal = x @ np.linalg.inv(psi).T
        out = []
        for place, i in enumerate(sorted(one_of_pairs(lam), key=lambda i: abs(np.log(lam[i])))):
            n, ch = np.meshgrid(np.arange(first, first + len(y)), row.channels, indexing="ij")
            part = 2 * np.outer(modal[:, i], c @ psi[:, i]).real
            out.append(pd.DataFrame({"setup": row.setup, "n": n.ravel(), "channel": ch.ravel(), "idx": place, "f": rate * abs(np.log(lam[i])) / (2 * np.pi), "y": part.ravel()}))
        return pd.concat(out) if out else pd.DataFrame(columns=["setup", "n", "channel", "idx", "f", "y"])

    return filtered(signals, models, ["setup"], chunk, emit, "setup string, n int, channel int, idx int, f double, y double")


def prediction_errors(signals: DataFrame, models: DataFrame, keys: Sequence[str], warm_up: int, chunk: int = 1 << 14) -> DataFrame:
    """keys, error: root of the squared one-step prediction errors over that of the samples, from sample ``warm_up`` on."""
    kinds = dict(signals.dtypes)

    def emit(row, first: int, y: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        use = np.arange(first, first + len(y)) >= warm_up
        wrong = (y - x @ matrices(row)[1].T)[use]
        return pd.DataFrame({k: [getattr(row, k)] for k in keys} | {"wrong": [float((wrong**2).sum())], "whole": [float((y[use] ** 2).sum())]})

    sums = filtered(signals, models, keys, chunk, emit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", wrong double, whole double")
    return sums.groupBy(*keys).agg(F.sqrt(F.sum("wrong") / F.sum("whole")).alias("error"))
