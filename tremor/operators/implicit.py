"""Subspace identification and rational fractions of setups whose matrices no task could hold.

The block Toeplitz matrix of a setup's correlations is used through its products only.  A channel's rows of a product are
convolutions of its correlation functions with the other factor, done by FFT; so every channel is a row of its own, products with the
matrix stay with the channels, and products with its transpose are partial sums that Spark adds up.  The same holds for the normal
equations of the frequency-domain fraction, whose terms are sums over channels.  A task holds one channel's
functions, or ``FAN`` small matrices that are merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.factors import FAN, triangular
from tremor.operators.identify import POLES, modal
from tremor.scratch import written

MATRIX = "size array<int>, m binary"
TOLERANCE = 1e-11


def _row(m: np.ndarray) -> dict:
    return {"size": [list(m.shape)], "m": [np.ascontiguousarray(m).tobytes()]}


def _matrix(row, name: str = "m", size: str = "size", kind: type = float) -> np.ndarray:
    return np.frombuffer(getattr(row, name), kind).reshape(*getattr(row, size))


def channel_rows(corr: DataFrame) -> DataFrame:
    """setup, channel, size, r: one row per channel with its correlation functions (references, lags)."""
    own = corr.groupBy("setup", "channel").agg(F.sort_array(F.collect_list(F.struct("ref", "lag", "r"))).alias("values"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                refs = len({v["ref"] for v in row.values})
                r = np.array([v["r"] for v in row.values]).reshape(refs, -1)
                yield pd.DataFrame({"setup": [row.setup], "channel": [row.channel], "size": [list(r.shape)], "r": [r.tobytes()]})

    return own.mapInPandas(pack, "setup string, channel int, size array<int>, r binary")


def forward(r: np.ndarray, z: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """A channel's rows (rows + 1, k) of the Toeplitz matrix times z (cols * references, k)."""
    nr, n = len(r), 1 << int(rows + 2 * cols).bit_length()
    z = z.reshape(cols, nr, -1)
    total = sum(np.fft.rfft(r[k, : rows + cols], n)[:, None] * np.fft.rfft(z[:, k], n, axis=0) for k in range(nr))
    return np.fft.irfft(total, n, axis=0)[cols - 1 : cols + rows]


def backward(r: np.ndarray, q: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """The channel's part (cols * references, k) of the transpose times q, of which it has rows + 1 rows."""
    n = 1 << int(2 * rows + cols + 1).bit_length()
    turned = np.fft.rfft(q[::-1], n, axis=0)
    parts = [np.fft.irfft(np.fft.rfft(r[k, : rows + cols], n)[:, None] * turned, n, axis=0)[rows : rows + cols][::-1] for k in range(len(r))]
    return np.stack(parts, 1).reshape(cols * len(r), -1)


def _merged(parts: DataFrame, keys: Sequence[str], merge: Callable[[list[np.ndarray]], np.ndarray], kind: type = float, fan: int = FAN) -> DataFrame:
    """One matrix per ``keys`` from rows keys, place, size, m; at most ``fan`` meet in a task."""
    kinds = dict(parts.dtypes)
    most = parts.agg(F.max("place")).first()[0] or 0

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [v] for k, v in zip([*keys, "place"], key)} | _row(merge([np.frombuffer(m, kind).reshape(*s) for m, s in zip(pdf["m"], pdf["size"])])))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", place int, {MATRIX}"
    while True:
        parts = parts.withColumn("place", F.floor(F.col("place") / fan).cast("int")).groupBy(*keys, "place").applyInPandas(run, schema)
        most //= fan
        if most == 0:
            return parts.drop("place")


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    r = triangular(np.vstack(parts))
    return r if len(r) >= r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def singular_vectors(corr: DataFrame, rows: int, cols: int, wanted: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(setup, channel, size, m: a channel's rows of the ``wanted`` leading left singular vectors of the block Toeplitz matrix; setup, s).

    Block Krylov method: the basis of the row space starts at random and grows by the transpose times its own image, until
    the wanted singular values of all setups have settled; a basis of the whole row space is exact, so it ends at the latest there."""
    own = written(channel_rows(corr), "channels")
    step = wanted + 8

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                wide = cols * row.nr
                yield pd.DataFrame({"setup": [row.setup]} | _row(np.linalg.qr(np.random.default_rng(5).normal(size=(wide, min(step, wide))))[0]))

    basis = written(own.groupBy("setup").agg(F.max(F.col("size")[0]).alias("nr")).mapInPandas(start, f"setup string, {MATRIX}"), "basis")

    def image(row) -> np.ndarray:
        return forward(_matrix(row, "r", "size"), _matrix(row, "z", "z_size"), rows, cols)

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"setup": [row.setup], "place": [row.channel]} | _row(triangular(image(row))))

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y = image(row) @ _matrix(row, "turn", "turn_size")
                yield pd.DataFrame({"setup": [row.setup], "place": [row.channel]} | _row(backward(_matrix(row, "r", "size"), y, rows, cols)))

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Right singular vectors of the image's factor over the singular values: what makes the image orthonormal."""
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                _, s, vt = np.linalg.svd(_matrix(row))
                keep = s > 1e-14 * s.max(initial=0)
                yield pd.DataFrame({"setup": [row.setup], "s": [s[:wanted].tolist()]} | _row(vt[keep].T / s[keep]))

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                z, w = _matrix(row, "z", "z_size"), _matrix(row)[:, :step]
                for _ in range(2):
                    w = w - z @ (z.T @ w)
                u, s, _ = np.linalg.svd(w, full_matrices=False)
                room = len(z) - z.shape[1]
                yield pd.DataFrame({"setup": [row.setup]} | _row(np.hstack([z, u[:, s > 1e-10 * max(s.max(initial=0), 1e-300)][:, :room]])))

    kinds, known = f"setup string, place int, {MATRIX}", {}
    while True:
        z = basis.select("setup", F.col("m").alias("z"), F.col("size").alias("z_size"))
        meet = own.join(z, "setup")
        turn = written(_merged(meet.mapInPandas(factor, kinds), ["setup"], _stack).mapInPandas(turned, f"setup string, s array<double>, {MATRIX}"), "turn")
        now = {r["setup"]: (np.array(r["s"]), r["full"]) for r in turn.join(z, "setup").select("setup", "s", (F.col("z_size")[0] <= F.col("z_size")[1]).alias("full")).collect()}  # a few numbers per setup
        if all(full or (k in known and len(known[k]) == len(s) and np.allclose(s, known[k], rtol=tolerance, atol=tolerance * s[:1].max(initial=0))) for k, (s, full) in now.items()):
            break
        known = {k: s for k, (s, _) in now.items()}
        shift = turn.select("setup", F.col("m").alias("turn"), F.col("size").alias("turn_size"))
        added = _merged(meet.join(shift, "setup").mapInPandas(back, kinds), ["setup"], sum)
        basis = written(added.join(z, "setup").mapInPandas(grown, f"setup string, {MATRIX}"), "basis")

    shift = turn.select("setup", F.col("m").alias("turn"), F.col("size").alias("turn_size"))

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"setup": [row.setup], "channel": [row.channel]} | _row(image(row) @ _matrix(row, "turn", "turn_size")[:, :wanted]))

    return meet.join(shift, "setup").mapInPandas(left, f"setup string, channel int, {MATRIX}"), turn.select("setup", "s")


def _collected(shapes: DataFrame) -> DataFrame:
    """Poles from rows setup, method, ord, idx, f, d, lam_re, lam_im, channel, re, im; shapes get a largest component of 1."""
    keys = ["setup", "method", "ord", "idx", "f", "d", "lam_re", "lam_im"]
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    flat = shapes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel", "re", "im"))).alias("phi"), F.max_by(F.struct("re", "im"), size).alias("top"))
    power = "(top.re * top.re + top.im * top.im)"
    return flat.selectExpr(*keys, f"transform(phi, v -> (v.re * top.re + v.im * top.im) / {power}) AS phi_re", f"transform(phi, v -> (v.im * top.re - v.re * top.im) / {power}) AS phi_im")


def ssi_cov_poles(corr: DataFrame, rate: float, cols: int, orders: range) -> DataFrame:
    """Covariance-driven subspace identification on the implicit block Toeplitz matrix; the same poles as ``identify.ssi_cov_poles``.

    The shift of the observability matrix is solved from the triangular factor of its two parts beside one another, merged over the channels."""
    most = max(orders)
    vectors, values = singular_vectors(corr, cols, cols, most)
    o = written(vectors.join(values, "setup"), "observability")

    def observed(row) -> np.ndarray:
        u = _matrix(row)
        return u * np.sqrt(np.array(row.s))[: u.shape[1]]

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                m = observed(row)
                yield pd.DataFrame({"setup": [row.setup], "place": [row.channel]} | _row(triangular(np.hstack([m[:-1], m[1:]]))))

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(row.setup, row.channel, observed(row)[0].tolist()) for row in pdf.itertuples(index=False)], columns=["setup", "channel", "c"])

    both = _merged(o.mapInPandas(shifts, f"setup string, place int, {MATRIX}"), ["setup"], _stack)
    first = o.mapInPandas(heads, "setup string, channel int, c array<double>").groupBy("setup").agg(F.sort_array(F.collect_list(F.struct("channel", "c"))).alias("c"))
    n = corr.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))
    names = [k.split()[0] for k in POLES.split(", ")]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r, c = _matrix(row), np.array([v["c"] for v in row.c])
                w, k = r.shape[1] // 2, min(row.ord, r.shape[1] // 2)
                a = np.linalg.lstsq(r[:, :k], r[:, w : w + k], rcond=None)[0]
                rows = [(row.setup, "ssi-cov", row.ord, i, f, d, lam.real, lam.imag, phi.real.tolist(), phi.imag.tolist()) for i, (f, d, lam, phi) in enumerate(modal(a, c[:, :k], rate))]
                yield pd.DataFrame(rows, columns=names)

    return both.join(first, "setup").crossJoin(F.broadcast(n)).repartition("setup", "ord").mapInPandas(solve, POLES)  # one row of small matrices per order


# --- matrix fraction in the frequency domain --------------------------------------------------------


def _spectra(r: np.ndarray, rate: float, decay: float, band: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, float]:
    """(half spectra (references, lines), their angles, decay per sample)."""
    m = r.shape[1]
    factor = -np.log(decay) / m
    spectra, k = np.fft.rfft(r * np.exp(-factor * np.arange(m)), axis=1), np.arange(m // 2 + 1)
    freq = k * rate / m
    use = (freq > band[0]) & (freq < band[1]) if band else k > 0
    return spectra[:, use], 2 * np.pi * k[use] / m, factor


def _normal(spectra: np.ndarray, angles: np.ndarray, order: int, real: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inverse of the numerator's part, mixed part, reduced part) of a channel's normal equations."""
    part = (lambda m: m.real) if real else (lambda m: m)
    x = np.exp(1j * np.outer(angles, np.arange(order + 1)))
    y = -np.einsum("kr,kj->krj", x, spectra.T).reshape(len(x), -1)
    inv, mixed = np.linalg.pinv(part(x.conj().T @ x)), part(x.conj().T @ y)
    return inv, mixed, part(y.conj().T @ y) - mixed.conj().T @ inv @ mixed


def plscf_poles(corr: DataFrame, rate: float, orders: range, decay: float = 0.001, band: tuple[float, float] | None = None, real: bool = True) -> DataFrame:
    """Poles of the right matrix fraction with real or complex coefficients.

    A channel adds its reduced normal equations of every order to those of the others; denominators and eigenvectors, small, go back to
    the channels, where each gives its component of the shapes.  With complex coefficients poles do not come in pairs; those above the real axis stay."""
    kind = float if real else complex
    own = written(channel_rows(corr), "channels")
    n = corr.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))
    each = own.crossJoin(F.broadcast(n)).repartition("setup", "channel", "ord")

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                spectra, angles, _ = _spectra(_matrix(row, "r"), rate, decay, band)
                yield pd.DataFrame({"setup": [row.setup], "ord": [row.ord], "place": [row.channel]} | _row(_normal(spectra, angles, row.ord, real)[2]))

    sums = _merged(each.mapInPandas(equations, f"setup string, ord int, place int, {MATRIX}"), ["setup", "ord"], sum, kind)

    def denominators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total = _matrix(row, kind=kind)
                nr = len(total) // (row.ord + 1)
                k = row.ord * nr
                alpha = np.vstack([-np.linalg.lstsq(total[:k, :k], total[:k, k:], rcond=None)[0], np.eye(nr)])
                a = np.zeros((k, k), total.dtype)
                a[nr:, : k - nr] = np.eye(k - nr)
                a[:nr] = np.hstack([-alpha[(row.ord - 1 - i) * nr : (row.ord - i) * nr] for i in range(row.ord)])
                lam, psi = np.linalg.eig(a)
                up = lam.imag > 1e-12 * abs(lam)
                yield pd.DataFrame({"setup": [row.setup], "ord": [row.ord], "nr": [nr], "alpha": [alpha.astype(complex).tobytes()], "lam": [lam[up].tobytes()], "psi": [np.ascontiguousarray(psi[:, up]).tobytes()]})

    solved = written(sums.mapInPandas(denominators, "setup string, ord int, nr int, alpha binary, lam binary, psi binary"), "denominators")

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                spectra, angles, factor = _spectra(_matrix(row, "r"), rate, decay, band)
                inv, mixed, _ = _normal(spectra, angles, row.ord, real)
                alpha = np.frombuffer(row.alpha, complex).reshape(-1, row.nr)
                beta = -inv @ mixed @ alpha  # (order + 1, references)
                wide = np.hstack([beta[row.ord - 1 - i] - beta[row.ord] @ alpha[(row.ord - 1 - i) * row.nr : (row.ord - i) * row.nr] for i in range(row.ord)])
                lam = np.frombuffer(row.lam, complex)
                phi = wide @ np.frombuffer(row.psi, complex).reshape(-1, len(lam))
                mu = np.log(lam) * rate
                f, d = abs(mu) / (2 * np.pi), -100 * (mu.real + factor * rate) / abs(mu)  # without the decay of the window
                rows = [(i, f[j], d[j], lam[j].real, lam[j].imag, phi[j].real, phi[j].imag) for i, j in enumerate(np.lexsort((d, f))) if f[j] > 0]
                yield pd.DataFrame(rows, columns=["idx", "f", "d", "lam_re", "lam_im", "re", "im"]).assign(setup=row.setup, method="plscf" if real else "plscf-complex", ord=row.ord, channel=row.channel)[names]

    names = ["setup", "method", "ord", "idx", "f", "d", "lam_re", "lam_im", "channel", "re", "im"]
    kinds = "setup string, method string, ord int, idx int, f double, d double, lam_re double, lam_im double, channel int, re double, im double"
    found = _collected(own.join(solved, "setup").mapInPandas(shapes, kinds)).where("d > 0")
    place = F.row_number().over(Window.partitionBy("setup", "ord").orderBy("f", "d")) - 1
    return found.withColumn("idx", place.cast("int")).select(*(k.split()[0] for k in POLES.split(", ")))
