"""System identification: correlation functions or spectra of a setup to a table of poles.

The reduced matrices of a setup (correlations, half spectra) are gathered once per setup; the work for
each model order is a group of its own, so orders run in parallel.  Poles: (setup, method, ord, idx,
f, d, lam_re, lam_im, phi_re, phi_im), one row per pole of positive frequency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POLES = "setup string, method string, ord int, idx int, f double, d double, lam_re double, lam_im double, phi_re array<double>, phi_im array<double>"


def one_of_pairs(lam: np.ndarray) -> np.ndarray:
    """Indices of stable complex eigenvalues, one of each conjugate pair, in order."""
    kept: list[int] = []
    for i, v in enumerate(lam):
        if v.imag != 0 and abs(v) <= 1 and not any(np.isclose(v, np.conj(lam[j])) for j in kept):
            kept.append(i)
    return np.array(kept, int)


def modal(a: np.ndarray, c: np.ndarray, rate: float) -> list[tuple]:
    """(f, d, lambda, shape) of a discrete state-space model, sorted by frequency; shapes have a largest component of 1."""
    lam, psi = np.linalg.eig(a)
    out = []
    for i in one_of_pairs(lam):
        arg, log = abs(np.angle(lam[i])), np.log(abs(lam[i]))
        size = np.hypot(arg, log)
        phi = c @ psi[:, i]
        out.append((rate * size / (2 * np.pi), 100 * abs(log) / size, lam[i], phi / phi[np.argmax(abs(phi))]))
    return sorted(out, key=lambda r: (r[0], r[1]))


def _rows(setup: str, method: str, order: int, modes: list[tuple]) -> pd.DataFrame:
    rows = [(setup, method, order, i, f, d, lam.real, lam.imag, phi.real.tolist(), phi.imag.tolist()) for i, (f, d, lam, phi) in enumerate(modes)]
    return pd.DataFrame(rows, columns=[k.split()[0] for k in POLES.split(", ")])


def gathered(corr: DataFrame) -> DataFrame:
    """setup, channel, ref and lags of every correlation function as one array.

    What follows holds all functions of a setup in one task; ``implicit`` has forms that hold those of one channel."""
    return corr.groupBy("setup", "channel", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("r"))


def tensor(pdf: pd.DataFrame) -> np.ndarray:
    """(channels, references, lags)."""
    channels, refs = np.sort(pdf["channel"].unique()), np.sort(pdf["ref"].unique())
    out = np.zeros((len(channels), len(refs), min(map(len, pdf["r"]))))
    for row in pdf.itertuples():
        out[np.searchsorted(channels, row.channel), np.searchsorted(refs, row.ref)] = row.r[: out.shape[2]]
    return out


def _second_order(signals: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(correlations r0, r1, r2 of every channel with channel c in every block o; power, a1, a2 of the recursion y[n] = a1 y[n-1] + a2 y[n-2])."""
    block = signals.select("setup", F.floor(F.col("n") / length).cast("int").alias("o"), (F.col("n") % length).cast("int").alias("n"), "channel", "y")
    early = block.select("setup", "o", F.col("channel").alias("c"), F.col("y").alias("x"), F.posexplode(F.array(F.col("n"), F.col("n") + 1, F.col("n") + 2)).alias("lag", "n"))
    r = block.join(early, ["setup", "o", "n"]).groupBy("setup", "o", "c", "channel").agg(*(F.sum(F.when(F.col("lag") == k, F.col("y") * F.col("x"))).alias(f"r{k}") for k in range(3)))
    r0, r1, r2 = (F.col(f"r{k}") for k in range(3))
    own = r.where("channel = c").select("setup", "o", "c", r0.alias("power"), (r1 * (r0 - r2)).alias("u"), (r0 * r2 - r1 * r1).alias("v"), (r0 * r0 - r1 * r1).alias("w")).where("w > 0")
    return r, own.select("setup", "o", "c", "power", (F.col("u") / F.col("w")).alias("a1"), (F.col("v") / F.col("w")).alias("a2"))


def ar_roots(signals: DataFrame, length: int) -> DataFrame:
    """setup, ord, idx, re, im: both roots of every channel's second-order autoregression in every block, real ones too; idx is twice the channel, and one more for the second root."""
    half, inner = F.col("a1") / 2, F.col("a1") * F.col("a1") + 4 * F.col("a2")
    wide = F.sqrt(F.abs(inner)) / 2
    root = lambda sign, at: F.struct(F.lit(at).alias("at"), F.when(inner < 0, half).otherwise(half + sign * wide).alias("re"), F.when(inner < 0, sign * wide).otherwise(0.0).alias("im"))
    rows = _second_order(signals, length)[1].select("setup", (F.col("o") + 2).alias("ord"), "c", F.explode(F.array(root(1, 0), root(-1, 1))).alias("z"))
    return rows.select("setup", "ord", (2 * F.col("c") + F.col("z.at")).cast("int").alias("idx"), "z.re", "z.im")


def without_conjugates(roots: DataFrame, exact: bool = False) -> DataFrame:
    """setup, ord, idx, re, im without real roots and without the first later conjugate of every root.

    ``exact``: only equal parts make a conjugate, and roots of any size take part.  Else roots outside the unit circle go first, and
    parts may differ by rounding (1e-8 and 1e-5 of the root).  Of roots that occur twice each looks for its conjugate alone, so both may find the same one."""
    key = ["setup", "ord"]
    left = roots.where("im <> 0").select(*key, "idx", "re", "im")
    if not exact:
        left = left.where("re * re + im * im <= 1")
    other = left.select(*key, F.col("idx").alias("later"), F.col("re").alias("c"), (-F.col("im")).alias("d"))
    if exact:
        pairs = other.join(left.withColumnsRenamed({"re": "c", "im": "d"}), [*key, "c", "d"])
    else:
        cell = lambda name: F.floor(F.col(name) * 10_000)  # noqa: E731  (wider than the tolerance inside the unit circle)
        near = lambda name: F.explode(F.array(*(cell(name) + i for i in (-1, 0, 1))))
        dealt = other.withColumns({"a": cell("c"), "b": cell("d")})
        spread = left.withColumn("a", near("re")).withColumn("b", near("im"))
        apart = F.sqrt((F.col("re") - F.col("c")) ** 2 + (F.col("im") - F.col("d")) ** 2)
        pairs = dealt.join(spread, [*key, "a", "b"]).where(apart <= 1e-8 + 1e-5 * F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    gone = pairs.where("later > idx").groupBy(*key, "idx").agg(F.min("later").alias("later")).select(*key, F.col("later").alias("idx")).distinct()
    return left.join(gone, [*key, "idx"], "left_anti").select(*key, "idx", "re", "im")


def rescaled(poles: DataFrame, scale: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Poles whose shapes (arrays of real and imaginary parts) went through ``scale``."""
    re, im = scale(F.col("phi_re"), F.col("phi_im"))
    told = poles.withColumn("__scaled", F.struct(re.alias("re"), im.alias("im")))  # a new phi_re in withColumns would be the one that the new phi_im sees
    return told.select(*(F.col(f"__scaled.{c[4:]}").alias(c) if c in ("phi_re", "phi_im") else F.col(c) for c in poles.columns))


def ar_poles(signals: DataFrame, length: int, rate: float) -> DataFrame:
    """Poles of an autoregression of second order of every channel in every block of ``length`` samples, with shapes over all channels.

    The block's number plus 2 stands for the order, so blocks follow one another like orders in a stabilisation diagram.  The recursion comes from the
    channel's correlations at lags 0 to 2 (Yule-Walker); a channel with real poles gives none.  The shape is the decaying wave of the pole that meets the
    correlations of all channels with this one at lags 0 and 1."""
    r, own = _second_order(signals, length)
    r0, r1 = F.col("r0"), F.col("r1")
    own = own.where("a1 * a1 + 4 * a2 < 0").select("setup", "o", "c", "power", (F.col("a1") / 2).alias("lam_re"), (F.sqrt(-F.col("a1") * F.col("a1") - 4 * F.col("a2")) / 2).alias("lam_im"))
    re, im = r0 / F.col("power"), (r0 / F.col("power") * F.col("lam_re") - r1 / F.col("power")) / F.col("lam_im")
    shapes = own.join(r, ["setup", "o", "c"]).groupBy("setup", "o", "c", "lam_re", "lam_im").agg(F.sort_array(F.collect_list(F.struct("channel", re.alias("re"), im.alias("im")))).alias("phi"))
    size, turn = F.log(F.col("lam_re") ** 2 + F.col("lam_im") ** 2) / 2, F.atan2("lam_im", "lam_re")
    whole = F.sqrt(size * size + turn * turn)
    found = shapes.select("setup", F.lit("ar").alias("method"), (F.col("o") + 2).alias("ord"), "c", (rate * whole / (2 * np.pi)).alias("f"), (-100 * size / whole).alias("d"), "lam_re", "lam_im", F.col("phi.re").alias("phi_re"), F.col("phi.im").alias("phi_im"))
    place = F.row_number().over(Window.partitionBy("setup", "ord").orderBy("f", "c")) - 1
    return found.withColumn("idx", place.cast("int")).select(*(k.split()[0] for k in POLES.split(", ")))


def per_order(corr: DataFrame, orders: range, method: str, solve: Callable[[np.ndarray, int], list[tuple]]) -> DataFrame:
    """Poles of every order: the gathered tensor goes to each order's own group."""
    n = corr.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))
    spread = gathered(corr).crossJoin(F.broadcast(n))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = int(pdf["ord"].iloc[0])
        return _rows(pdf["setup"].iloc[0], method, order, solve(tensor(pdf), order))

    return spread.groupBy("setup", "ord").applyInPandas(run, POLES)


def toeplitz_factors(r: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values of the block Toeplitz matrix of correlations."""
    t = np.block([[r[:, :, cols + i - j - 1] for j in range(cols)] for i in range(rows + 1)])
    return np.linalg.svd(t, full_matrices=False)[:2]


def ssi_cov(r: np.ndarray, rows: int, cols: int, order: int, rate: float) -> list[tuple]:
    """Covariance-driven stochastic subspace identification on a block Toeplitz matrix."""
    u, s = toeplitz_factors(r, rows, cols)
    return _shifted(u[:, :order] * np.sqrt(s[:order]), r.shape[0], rate)


def _shifted(o: np.ndarray, channels: int, rate: float) -> list[tuple]:
    return modal(np.linalg.pinv(o[:-channels]) @ o[channels:], o[:channels], rate)


def era_factors(r: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left vectors, singular values, shifted matrix between the singular vectors) of responses from lag 1 on."""
    h0 = np.block([[r[:, :, 1 + i + j] for j in range(cols)] for i in range(rows)])
    h1 = np.block([[r[:, :, 2 + i + j] for j in range(cols)] for i in range(rows)])
    u, s, vt = np.linalg.svd(h0, full_matrices=False)
    return u, s, u.T @ h1 @ vt.T


def _realised(u: np.ndarray, s: np.ndarray, middle: np.ndarray, channels: int, order: int, rate: float) -> list[tuple]:
    root = np.sqrt(s[:order])
    return modal(middle[:order, :order] / root[:, None] / root, u[:channels, :order] * root, rate)


def era(r: np.ndarray, rows: int, cols: int, order: int, rate: float) -> list[tuple]:
    """Eigensystem realisation on the block Hankel matrices of responses from lag 1 on."""
    return _realised(*era_factors(r, rows, cols), r.shape[0], order, rate)


def prce(r: np.ndarray, order: int, rate: float) -> list[tuple]:
    """Poly-reference complex exponential: an autoregression of the references, then residues by least squares."""
    nl, nr, m = r.shape
    ns = m - order
    lhs = np.vstack([np.hstack([r[c, :, i : i + ns] for c in range(nl)]) for i in range(order)])
    rhs = -np.hstack([r[c, :, order : order + ns] for c in range(nl)])
    b = rhs @ np.linalg.pinv(lhs)
    companion = np.vstack([np.hstack([np.zeros((nr * (order - 1), nr)), np.eye(nr * (order - 1))]), -b])
    mu, vec = np.linalg.eig(companion)
    w = vec[:nr]
    basis = np.vstack([w * mu**i for i in range(order + 1)])
    res = np.stack([np.linalg.lstsq(basis, r[c, :, : order + 1].T.reshape(-1).astype(complex), rcond=None)[0] for c in range(nl)])
    out = []
    for i in one_of_pairs(mu):
        arg, log = abs(np.angle(mu[i])), np.log(abs(mu[i]))
        size, phi = np.hypot(arg, log), res[:, i]
        if abs(phi).max() > 0:
            out.append((rate * size / (2 * np.pi), 100 * abs(log) / size, mu[i], phi / phi[np.argmax(abs(phi))]))
    return sorted(out, key=lambda x: (x[0], x[1]))


def _half(r: np.ndarray, rate: float, decay: float, band: tuple[float, float] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(spectra of the lines used, their numbers, their frequencies, decay per sample) of exponentially windowed correlations."""
    m = r.shape[2]
    factor = -np.log(decay) / m
    spectra = np.fft.rfft(r * np.exp(-factor * np.arange(m)), axis=2)
    k = np.arange(spectra.shape[2])
    freq = k * rate / m
    use = (freq > band[0]) & (freq < band[1]) if band else k > 0
    return spectra[:, :, use], k[use], freq[use], factor


def _fraction(r: np.ndarray, order: int, rate: float, decay: float, band: tuple[float, float] | None) -> tuple:
    nl, nr, m = r.shape
    spectra, k, freq, factor = _half(r, rate, decay, band)
    x = np.exp(2j * np.pi * np.outer(k / m, np.arange(order + 1)))
    inv = np.linalg.pinv((x.conj().T @ x).real)
    total = np.zeros(((order + 1) * nr, (order + 1) * nr))
    terms = []
    for c in range(nl):
        y = -np.einsum("kr,kj->krj", x, spectra[c].T).reshape(len(x), -1)
        s, t = (x.conj().T @ y).real, (y.conj().T @ y).real
        total += 2 * (t - s.T @ inv @ s)
        terms.append(s)
    n = order * nr
    alpha = np.vstack([-np.linalg.lstsq(total[:n, :n], total[:n, n:], rcond=None)[0], np.eye(nr)])
    beta = np.stack([-inv @ s @ alpha for s in terms], 1)  # (order + 1, channels, references)
    return spectra, freq, alpha, beta, factor


def plscf_model(r: np.ndarray, order: int, rate: float, decay: float = 0.001, band: tuple[float, float] | None = None) -> tuple:
    """(spectra, frequencies, denominator coefficients, decay per sample) of the right matrix fraction."""
    spectra, freq, alpha, _, factor = _fraction(r, order, rate, decay, band)
    return spectra, freq, alpha, factor


def plscf(r: np.ndarray, order: int, rate: float, decay: float = 0.001, band: tuple[float, float] | None = None) -> list[tuple]:
    """Poly-reference least-squares complex frequency method on half spectra of the correlation."""
    nr = r.shape[1]
    _, _, alpha, beta, factor = _fraction(r, order, rate, decay, band)
    n = order * nr
    a = np.zeros((n, n))
    a[nr:, : n - nr] = np.eye(n - nr)
    blocks = [beta[order - 1 - i] - beta[order] @ alpha[(order - 1 - i) * nr : (order - i) * nr] for i in range(order)]
    a[:nr] = np.hstack([-alpha[(order - 1 - i) * nr : (order - i) * nr] for i in range(order)])
    lam, psi = np.linalg.eig(a)
    out = []
    for i in one_of_pairs(lam / np.maximum(1, abs(lam))):
        mu = np.log(lam[i]) * rate
        f = abs(mu) / (2 * np.pi)
        d = -100 * (mu.real + factor * rate) / abs(mu)  # without the decay of the window
        phi = np.hstack(blocks) @ psi[:, i]
        if f > 0 and d > 0 and abs(phi).max() > 0:
            out.append((f, d, lam[i], phi / phi[np.argmax(abs(phi))]))
    return sorted(out, key=lambda v: (v[0], v[1]))


def _factored(corr: DataFrame, orders: range, method: str, factors: Callable[[np.ndarray], list[np.ndarray]], solve: Callable[..., list[tuple]]) -> DataFrame:
    """Poles of every order: a setup's matrix is decomposed once, the orders are groups of their own and get the factors."""

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        r = tensor(pdf)
        parts = factors(r)
        return pd.DataFrame({"setup": [pdf["setup"].iloc[0]], "channels": [r.shape[0]], "shapes": [[int(n) for x in parts for n in (len(x), x.size // len(x))]], "parts": [[x.tobytes() for x in parts]]})

    n = corr.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))
    found = gathered(corr).groupBy("setup").applyInPandas(factor, "setup string, channels int, shapes array<int>, parts array<binary>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        parts = [np.frombuffer(x).reshape(row["shapes"][2 * i], row["shapes"][2 * i + 1]) for i, x in enumerate(row["parts"])]
        return _rows(row["setup"], method, int(row["ord"]), solve(*parts, int(row["channels"]), int(row["ord"])))

    return found.crossJoin(F.broadcast(n)).groupBy("setup", "ord").applyInPandas(run, POLES)  # one row of factors per order


def ssi_cov_poles(corr: DataFrame, rate: float, cols: int, orders: range) -> DataFrame:
    most = max(orders)

    def factors(r: np.ndarray) -> list[np.ndarray]:
        u, s = toeplitz_factors(r, cols, cols)
        return [u[:, :most] * np.sqrt(s[:most])]

    return _factored(corr, orders, "ssi-cov", factors, lambda o, channels, n: _shifted(o[:, :n], channels, rate))


def era_poles(corr: DataFrame, rate: float, cols: int, orders: range) -> DataFrame:
    most = max(orders)

    def factors(r: np.ndarray) -> list[np.ndarray]:
        u, s, middle = era_factors(r, cols, cols)
        return [np.ascontiguousarray(u[: r.shape[0], :most]), s[:most, None], np.ascontiguousarray(middle[:most, :most])]

    return _factored(corr, orders, "era", factors, lambda u, s, middle, channels, n: _realised(u, s.ravel(), middle, channels, n, rate))


def prce_poles(corr: DataFrame, rate: float, orders: range) -> DataFrame:
    return per_order(corr, orders, "prce", lambda r, n: prce(r, n, rate))


def plscf_poles(corr: DataFrame, rate: float, orders: range, decay: float = 0.001, band: tuple[float, float] | None = None) -> DataFrame:
    return per_order(corr, orders, "plscf", lambda r, n: plscf(r, n, rate, decay, band))


def ssi_data_poles(signals: DataFrame, refs: list[int], rate: float, rows: int, orders: range, chunk: int = 8192) -> DataFrame:
    """Data-driven subspace identification.

    The block Hankel matrix is never built: chunks of samples give triangular factors, which are merged in rounds; the projection of a
    setup is decomposed once, then its orders are groups of their own."""
    from tremor.operators import factors

    most = signals.agg(F.max("n")).first()[0] or 0
    whole = factors.merged(factors.block_factors(signals, refs, rows, most + 1, chunk), ["setup"], "part")

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                u, s, _ = np.linalg.svd(factors.split(factors.unpacked(row), rows, row.nr)[1], full_matrices=False)
                o = u[:, : max(orders)] * np.sqrt(s[: max(orders)])
                yield pd.DataFrame({"setup": [row.setup], "channels": [list(row.channels)], "width": [o.shape[1]], "o": [np.ascontiguousarray(o).tobytes()]})

    n = signals.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                nl, o = len(row.channels), np.frombuffer(row.o).reshape(-1, row.width)[:, : row.ord]
                yield _rows(row.setup, "ssi-data", row.ord, modal(np.linalg.pinv(o[:-nl]) @ o[nl:], o[:nl][np.argsort(row.channels)], rate))

    found = whole.mapInPandas(decompose, "setup string, channels array<int>, width int, o binary")
    return found.crossJoin(F.broadcast(n)).repartition("setup", "ord").mapInPandas(solve, POLES)  # one row of small matrices per order


def contributions(r: np.ndarray, modes: list[tuple]) -> np.ndarray:
    """Share of each mode in the correlation functions.

    The participation of the references is fitted by least squares to the known poles and shapes; a
    share is the mean over channel pairs of the correlation of one mode's part with the data, over
    the norms of the data and of the whole synthesis."""
    nl, nr, m = r.shape
    if not modes:
        return np.zeros(0)
    waves = np.stack([np.outer(phi, lam ** np.arange(m)).ravel() for _, _, lam, phi in modes], 1)
    basis = np.hstack([2 * waves.real, -2 * waves.imag])
    fit = np.linalg.lstsq(basis, r.transpose(0, 2, 1).reshape(nl * m, nr), rcond=None)[0]
    k = len(modes)
    parts = np.stack([(basis[:, [i, k + i]] @ fit[[i, k + i]]).reshape(nl, m, nr) for i in range(k)])
    data, whole = r.transpose(0, 2, 1), parts.sum(0)
    norm = np.sqrt((data**2).sum(1) * (whole**2).sum(1))
    return np.where(norm > 0, (parts * data).sum(2) / np.where(norm > 0, norm, 1), 0.0).mean((1, 2))


def ssi_cov_contributions(corr: DataFrame, rate: float, cols: int, orders: range) -> DataFrame:
    """setup, ord, idx, f, mc: modal contributions of the covariance-driven poles of every order."""
    modes = ssi_cov_poles(corr, rate, cols, orders).groupBy("setup", "ord").agg(F.sort_array(F.collect_list(F.struct("idx", "f", "lam_re", "lam_im", "phi_re", "phi_im"))).alias("modes"))
    whole = gathered(corr).groupBy("setup").agg(F.collect_list(F.struct("channel", "ref", "r")).alias("functions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r = tensor(pd.DataFrame([(x["channel"], x["ref"], x["r"]) for x in row.functions], columns=["channel", "ref", "r"]))
                of = [(x["f"], 0.0, complex(x["lam_re"], x["lam_im"]), np.array(x["phi_re"]) + 1j * np.array(x["phi_im"])) for x in row.modes]
                yield pd.DataFrame({"setup": row.setup, "ord": row.ord, "idx": range(len(of)), "f": [x[0] for x in of], "mc": contributions(r, of)})

    return modes.join(whole, "setup").mapInPandas(run, "setup string, ord int, idx int, f double, mc double")
