"""Subspace identification beyond the poles: uncertainty, merged setups, prediction, cross-validation, synthesis.

Spark gathers and aggregates correlations, deals setups, blocks and chunks of samples to groups, and sums what they
find; a group works on the small matrices of one setup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators import factors, kalman
from tremor.operators.identify import POLES, gathered, modal, one_of_pairs, plscf_model, tensor
from tremor.operators.spectral import half_spectra, over_blocks
from tremor.scratch import written


def observability(r: np.ndarray, rows: int, cols: int, first: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin singular value decomposition of the block Hankel matrix of a tensor (channels, references, lags) from ``first`` on."""
    return np.linalg.svd(hankel(r, rows, cols, first), full_matrices=False)


def hankel(r: np.ndarray, rows: int, cols: int, first: int = 1) -> np.ndarray:
    return np.block([[r[:, :, first + i + j] for j in range(cols)] for i in range(rows + 1)])


def transition(o: np.ndarray, channels: int, how: str = "pinv", max_modes: int | None = None) -> np.ndarray:
    """State matrix from the shift of an observability matrix: by pseudo-inverse, by QR, or by as many singular values as two per mode."""
    up, down = o[:-channels], o[channels:]
    if how == "qr":
        q, tri = np.linalg.qr(up)
        return np.linalg.solve(tri, q.T @ down)
    if how == "limited":
        u, s, vt = np.linalg.svd(up, full_matrices=False)
        k = min(len(s), 2 * (max_modes or len(s)))
        return vt[:k].T @ ((u[:, :k].T @ down) / s[:k, None])
    if how != "pinv":
        raise ValueError(f"unknown way {how!r}")
    return np.linalg.pinv(up) @ down


def lq(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower triangular L with a diagonal of at least 0, and Q with orthonormal rows; L Q = m."""
    q, tri = np.linalg.qr(m.T)
    sign = np.where(np.diag(tri) < 0, -1.0, 1.0)
    return (tri * sign[:, None]).T, (q * sign).T


def rq(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangular R and Q with orthonormal rows; R Q = m."""
    low, q = lq(m[::-1])
    return low[::-1, ::-1], q[::-1]


def ql(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Q with orthonormal columns and lower triangular L; Q L = m."""
    upper, q = rq(m.T)
    return q.T, upper.T


# --- uncertainty -----------------------------------------------------------------------------------


def sensitivities(h: np.ndarray, change: np.ndarray, factors: tuple, channels: int, order: int, rate: float, how: str = "pinv") -> list[tuple]:
    """(f, d, lambda, shape, df, dd, dshape) of every mode: first-order changes when the subspace matrix changes by ``change``.

    ``how``: the shift equation is solved by pseudo-inverse or by QR."""
    u, s, vt = factors
    n = order
    un, sn, vn = u[:, :n], s[:n], vt[:n].T
    p = u.T @ change @ vt.T
    gap = sn[None] ** 2 - s[:, None] ** 2
    np.fill_diagonal(gap, np.inf)
    mixed = (p[:, :n] * sn + s[:, None] * p.T[:, :n]) / gap
    rest = change @ vn
    du = u @ mixed + (rest - u @ (u.T @ rest)) / sn
    root = np.sqrt(sn)
    o, do = un * root, du * root + un * (np.diag(p)[:n] / (2 * root))
    up, down = o[:-channels], o[channels:]
    a = transition(o, channels, how)
    moving, bent = do[channels:] - do[:-channels] @ a, do[:-channels].T @ (down - up @ a)
    if how == "qr":
        q, tri = np.linalg.qr(up)
        da = np.linalg.solve(tri, q.T @ moving + np.linalg.solve(tri.T, bent))
    else:
        inverse = np.linalg.pinv(up)
        da = inverse @ moving + inverse @ (inverse.T @ bent)
    lam, right = np.linalg.eig(a)
    left = np.linalg.inv(right)
    moved = left @ da @ right
    out = []
    for i in one_of_pairs(lam):
        mu, dmu = np.log(lam[i]), moved[i, i] / lam[i]
        size = abs(mu)
        dsize = (np.conj(mu) * dmu).real / size
        apart = lam[i] - lam
        apart[i] = np.inf
        dpsi = right @ (moved[:, i] / apart)
        phi, dphi = o[:channels] @ right[:, i], do[:channels] @ right[:, i] + o[:channels] @ dpsi
        top = np.argmax(abs(phi))
        shape = phi / phi[top]
        out.append((rate * size / (2 * np.pi), 100 * abs(mu.real) / size, lam[i], shape, rate * dsize / (2 * np.pi), 100 * (-dmu.real / size + mu.real * dsize / size**2), (dphi - shape * dphi[top]) / phi[top]))
    return sorted(out, key=lambda v: (v[0], v[1]))


MATRIX = "channels array<int>, size array<int>, h binary"


def _matrix_row(channels: Sequence[int], h: np.ndarray) -> dict:
    return {"channels": [list(channels)], "size": [list(h.shape)], "h": [np.ascontiguousarray(h).tobytes()]}


def _carried(blocks: DataFrame, means: DataFrame, rate: float, orders: Sequence[int], how: str) -> DataFrame:
    """Poles of ``means`` (setup, channels, size, h) with std_f, std_d, std_phi from ``blocks`` (setup, block, channels, size, h).

    A mean is decomposed once and meets every block's one row; a block is carried to first order to all modes; squares are summed by Spark."""

    def factor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                u, s, vt = np.linalg.svd(np.frombuffer(row.h).reshape(*row.size), full_matrices=False)
                yield pd.DataFrame({"setup": [row.setup], "u": [u.tobytes()], "s": [s.tobytes()], "vt": [vt.tobytes()]})

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = np.frombuffer(row.s)
                factors = np.frombuffer(row.u).reshape(-1, len(s)), s, np.frombuffer(row.vt).reshape(len(s), -1)
                whole = (factors[0] * s) @ factors[2]
                change = np.frombuffer(row.h).reshape(*row.size) - whole
                at, rows = np.argsort(row.channels), []
                for order in orders:
                    for i, (f, d, lam, phi, df, dd, dphi) in enumerate(sensitivities(whole, change, factors, len(row.channels), order, rate, how)):
                        phi, dphi = phi[at], dphi[at]
                        rows.append((row.setup, order, i, f, d, lam.real, lam.imag, phi.real.tolist(), phi.imag.tolist(), df**2, dd**2, (abs(dphi) ** 2).tolist()))
                yield pd.DataFrame(rows, columns=["setup", "ord", "idx", "f", "d", "lam_re", "lam_im", "phi_re", "phi_im", "df", "dd", "dphi"])

    kinds = POLES.replace("method string, ", "") + ", df double, dd double, dphi array<double>"
    found = blocks.join(means.mapInPandas(factor, "setup string, u binary, s binary, vt binary"), "setup").mapInPandas(carry, kinds)
    n = F.count(F.lit(1))
    norm = n * (n - 1)
    kept = [F.first(c).alias(c) for c in ("f", "d", "lam_re", "lam_im", "phi_re", "phi_im")]
    sums = found.groupBy("setup", "ord", "idx").agg(*kept, F.sqrt(F.sum("df") / norm).alias("std_f"), F.sqrt(F.sum("dd") / norm).alias("std_d"), norm.alias("norm"))
    shapes = found.select("setup", "ord", "idx", F.posexplode("dphi").alias("at", "v")).groupBy("setup", "ord", "idx", "at").agg(F.sum("v").alias("v"))
    flat = shapes.groupBy("setup", "ord", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))
    return sums.join(flat, ["setup", "ord", "idx"]).select(*(c for c in sums.columns if c != "norm"), F.lit("ssi-var").alias("method"), F.transform("v", lambda v: F.sqrt(v / F.col("norm"))).alias("std_phi"))


def uncertain_poles(covariances: DataFrame, rate: float, cols: int, orders: range, how: str = "pinv") -> DataFrame:
    """Poles with std_f, std_d, std_phi from block covariances (setup, block, channel, ref, lag from 1 on, r)."""

    def matrix(r: DataFrame, keys: list[str]) -> DataFrame:
        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({k: [v] for k, v in zip(keys, key)} | _matrix_row(sorted(pdf["channel"].unique()), hankel(tensor(pdf), cols, cols, 0)))

        kinds = dict(r.dtypes)
        return r.groupBy(*keys).applyInPandas(build, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {MATRIX}")

    mean = gathered(over_blocks(covariances).select("setup", "channel", "ref", "lag", "r"))
    own = covariances.groupBy("setup", "block", "channel", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda x: x["r"]).alias("r"))
    return _carried(matrix(own, ["setup", "block"]), matrix(mean, ["setup"]), rate, orders, how)


def uncertain_poles_of_projections(signals: DataFrame, refs: Sequence[int], rate: float, rows: int, orders: range, length: int, chunk: int = 8192, how: str = "pinv") -> DataFrame:
    """The same from projections of the future onto the past of every block of ``length`` samples (factor tree, see ``factors``)."""
    leaves = written(factors.merged(factors.block_factors(signals, refs, rows, length, chunk), ["setup", "block"], "part"), "leaves")
    blocks = leaves.groupBy("setup").agg(F.count(F.lit(1)).alias("blocks"))
    whole = written(factors.merged(leaves, ["setup"], "block").join(blocks, "setup"), "whole")

    def mean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"setup": [row.setup]} | _matrix_row(row.channels, factors.split(factors.unpacked(row), rows, row.nr)[1]))

    return _carried(factors.projections(leaves, whole, rows).drop("nr"), whole.mapInPandas(mean, f"setup string, {MATRIX}"), rate, orders, how)


# --- setups merged before identification -----------------------------------------------------------


def scale_of_setups(refs: np.ndarray) -> np.ndarray:
    """Complex factor of every setup from the reference parts (setups, references) of one shape, by least squares.

    The products of the largest reference over the setups is set to 1 on average; all references shall agree between every two setups."""
    n = len(refs)
    top = int(np.argmax(np.prod(abs(refs), axis=0)))
    rows, rhs = [refs[:, top]], [n]
    for i in range(n):
        for j in range(i + 1, n):
            block = np.zeros((refs.shape[1], n), complex)
            block[:, i], block[:, j] = refs[i], -refs[j]
            rows.extend(block)
            rhs += [0] * refs.shape[1]
    return np.linalg.pinv(np.array(rows)) @ np.array(rhs, complex)


def merged_poles(corr: DataFrame, dofs: DataFrame, rate: float, cols: int, orders: range) -> DataFrame:
    """ord, idx, f, d, lam_re, lam_im, places, phi_re, phi_im of all setups at once.

    ``corr``: setup, channel, ref, lag, r; ``dofs``: setup, channel, node, azimuth, elevation.  References are directions that all
    setups measure and refer to.  The correlations of all setups stand above one another in one Hankel matrix; every
    shape's setups are brought to one scale by their references, then come the references and all other directions."""
    place = F.concat_ws("|", "node", "azimuth", "elevation")
    named = dofs.where(F.col("node").isNotNull()).select("setup", "channel", place.alias("place"))
    both = gathered(corr).join(named, ["setup", "channel"]).join(named.select("setup", F.col("channel").alias("ref"), F.col("place").alias("of")), ["setup", "ref"])
    setups = corr.select("setup").distinct().count()
    common = both.select("of", "setup").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == setups).select("of")
    rows = both.join(common, "of", "left_semi").select("setup", "place", "of", "r")

    def stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, list[tuple[str, str]], list[str]]:
        refs, lines = sorted(pdf["of"].unique()), sorted(set(zip(pdf["setup"], pdf["place"])))
        out = np.zeros((len(lines), len(refs), min(map(len, pdf["r"]))))
        at = {x: i for i, x in enumerate(lines)}
        for setup, spot, of, r in zip(pdf["setup"], pdf["place"], pdf["of"], pdf["r"]):
            out[at[setup, spot], refs.index(of)] = r[: out.shape[2]]
        return out, lines, refs

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        r, lines, refs = stacked(pdf)
        u, s, _ = observability(r, cols, cols)
        n = min(max(orders), len(s))
        o = u[:, :n] * np.sqrt(s[:n])
        return pd.DataFrame({"o": [o.tobytes()], "width": [n], "setups": [[a for a, _ in lines]], "places": [[b for _, b in lines]], "refs": [refs]})

    factors = rows.groupBy(F.lit(0).alias("all")).applyInPandas(factor, "o binary, width int, setups array<string>, places array<string>, refs array<string>")
    n = corr.sparkSession.range(len(orders)).select((F.col("id") * orders.step + orders.start).cast("int").alias("ord"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row, out = pdf.iloc[0], []
        setups_, places, refs = list(row["setups"]), list(row["places"]), list(row["refs"])
        o = np.frombuffer(row["o"]).reshape(-1, row["width"])[:, : row["ord"]]
        names = sorted(set(setups_))
        spots = [[next(i for i, (a, b) in enumerate(zip(setups_, places)) if a == s and b == ref) for ref in refs] for s in names]
        for i, (f, d, lam, phi) in enumerate(modal(transition(o, len(places)), o[: len(places)], rate)):
            scale = scale_of_setups(phi[np.array(spots)])
            moved = phi * scale[[names.index(s) for s in setups_]]
            whole = [(ref, moved[spots[0][k]]) for k, ref in enumerate(refs)] + [(b, v) for b, v in zip(places, moved) if b not in refs]
            values = np.array([v for _, v in whole])
            values = values / values[np.argmax(abs(values))]
            out.append((int(row["ord"]), i, f, d, lam.real, lam.imag, [b for b, _ in whole], values.real.tolist(), values.imag.tolist()))
        return pd.DataFrame(out, columns=["ord", "idx", "f", "d", "lam_re", "lam_im", "places", "phi_re", "phi_im"])

    kinds = "ord int, idx int, f double, d double, lam_re double, lam_im double, places array<string>, phi_re array<double>, phi_im array<double>"
    return factors.crossJoin(F.broadcast(n)).groupBy("ord").applyInPandas(solve, kinds)  # one row of factors per order


# --- prediction ------------------------------------------------------------------------------------


def innovation_model(r: np.ndarray, refs: Sequence[int], cols: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, C, K) of the one-step predictor x[k + 1] = A x[k] + K (y[k] - C x[k]) from correlations (channels, references, lags).

    All channels have to be references.  The state covariance solves the Riccati equation of the innovation form; estimated
    correlations need not belong to any process, and then ArithmeticError is raised (models from factors always do)."""
    if len(refs) != r.shape[0]:
        raise ValueError("prediction needs the correlations of all channels with all channels")
    nl = r.shape[0]
    u, s, vt = observability(r, cols, cols)
    root = np.sqrt(s[:order])
    o, ctr = u[:, :order] * root, root[:, None] * vt[:order]
    a, c, g = transition(o, nl), o[:nl], ctr[:, :nl]
    return a, c, kalman.riccati(a, c, np.zeros((order, order)), r[:, :, 0], g)[1]


def correlation_models(corr: DataFrame, keys: Sequence[str], cols: int, orders: Sequence[int]) -> DataFrame:
    """keys, ord, channels, a, c, k of the innovation models of gathered correlations (keys, channel, ref, r array from lag 0 on).

    a, c and k are null where the correlations of no process come close (see ``innovation_model``)."""
    kinds = dict(corr.dtypes)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, out = tensor(pdf), []
        for order in orders:
            try:
                model = [m.ravel().tolist() for m in innovation_model(r, range(r.shape[1]), cols, order)]
            except ArithmeticError:
                model = [None] * 3
            out.append((*key, int(order), sorted(int(c) for c in pdf["channel"].unique()), *model))
        return pd.DataFrame(out, columns=[*keys, "ord", "channels", "a", "c", "k"])

    return corr.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ord int, channels array<int>, a array<double>, c array<double>, k array<double>")


def signal_contributions(signals: DataFrame, parts: DataFrame) -> DataFrame:
    """setup, idx, f, mc: mean over the channels of the correlation of a mode's part with the signal, over the norms of the signal and of all parts."""
    whole = parts.groupBy("setup", "n", "channel").agg(F.sum("y").alias("s"))
    norms = signals.join(whole, ["setup", "n", "channel"]).groupBy("setup", "channel").agg(F.sqrt(F.sum(F.col("y") * F.col("y")) * F.sum(F.col("s") * F.col("s"))).alias("norm"))
    own = parts.withColumnRenamed("y", "p").join(signals, ["setup", "n", "channel"]).groupBy("setup", "channel", "idx").agg(F.first("f").alias("f"), F.sum(F.col("p") * F.col("y")).alias("dot"))
    return own.join(norms, ["setup", "channel"]).groupBy("setup", "idx").agg(F.first("f").alias("f"), F.avg(F.when(F.col("norm") > 0, F.col("dot") / F.col("norm")).otherwise(0.0)).alias("mc"))


def _by_fold(signals: DataFrame, orders: Sequence[int], length: int) -> DataFrame:
    """setup, fold, ord, n (from 0 in every fold), channel, y."""
    fold = F.floor(F.col("n") / length).cast("int").alias("fold")
    return signals.select("setup", fold, F.explode(F.array(*map(F.lit, orders))).alias("ord"), (F.col("n") % length).cast("int").alias("n"), "channel", "y")


def cross_validated(signals: DataFrame, covariances: DataFrame, cols: int, orders: Sequence[int], length: int, chunk: int = 1 << 14) -> DataFrame:
    """setup, fold, ord, error: one-step prediction error on each block by the covariances of all other blocks, over the block's deviation.

    ``covariances``: setup, block, channel, ref, lag, r of blocks of ``length`` samples, lag 0 included, all channels as references.
    A fifth of the block warms the predictor up.  The error is null where the other blocks' covariances have no predictor."""
    others = Window.partitionBy("setup", "channel", "ref", "lag")
    n = F.count(F.lit(1)).over(others)
    left = covariances.withColumn("r", (F.sum("r").over(others) - F.col("r")) / (n - 1)).withColumnRenamed("block", "fold")
    tensors = left.groupBy("setup", "fold", "channel", "ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda x: x["r"]).alias("r"))
    keys = ["setup", "fold", "ord"]
    models = written(correlation_models(tensors, ["setup", "fold"], cols, orders), "models")
    errors = kalman.prediction_errors(_by_fold(signals, orders, length), models.where("k IS NOT NULL"), keys, length // 5, chunk)
    return models.select(*keys).join(errors, keys, "left")


def cross_validated_lq(signals: DataFrame, refs: Sequence[int], rows: int, orders: Sequence[int], length: int, chunk: int = 8192) -> DataFrame:
    """The same with models from the triangular factors of all other blocks; the last block may be shorter."""
    leaves = factors.merged(factors.block_factors(signals, refs, rows, length, chunk), ["setup", "block"], "part")
    left = factors.leave_one_out(leaves).withColumnRenamed("block", "fold")
    models = written(kalman.kalman_models(left, ["setup", "fold"], rows, orders), "models")
    return kalman.prediction_errors(_by_fold(signals, orders, length), models, ["setup", "fold", "ord"], length // 5, chunk)


# --- synthesis -------------------------------------------------------------------------------------


def synthetic_correlations(corr: DataFrame, poles: DataFrame, order: int) -> DataFrame:
    """setup, idx, channel, ref, lag, r, part: the correlations beside each mode's part in them.

    The participation of the references is fitted by least squares to the poles and shapes of one order."""
    modes = poles.where(F.col("ord") == order).groupBy("setup").agg(F.sort_array(F.collect_list(F.struct("idx", "lam_re", "lam_im", "phi_re", "phi_im"))).alias("modes"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, out = tensor(pdf), []
        modes = pdf["modes"].iloc[0]
        nl, nr, m = r.shape
        waves = np.stack([np.outer(np.array(x["phi_re"]) + 1j * np.array(x["phi_im"]), complex(x["lam_re"], x["lam_im"]) ** np.arange(m)).ravel() for x in modes], 1)
        basis = np.hstack([2 * waves.real, -2 * waves.imag])
        fit = np.linalg.lstsq(basis, r.transpose(0, 2, 1).reshape(nl * m, nr), rcond=None)[0]
        channels, refs = np.sort(pdf["channel"].unique()), np.sort(pdf["ref"].unique())
        c, lag, k = np.meshgrid(channels, np.arange(m), refs, indexing="ij")
        for i, x in enumerate(modes):
            part = basis[:, [i, len(modes) + i]] @ fit[[i, len(modes) + i]]
            out.append(pd.DataFrame({"setup": pdf["setup"].iloc[0], "idx": x["idx"], "channel": c.ravel(), "ref": k.ravel(), "lag": lag.ravel(), "r": r.transpose(0, 2, 1).ravel(), "part": part.ravel()}))
        return pd.concat(out)

    return gathered(corr).join(modes, "setup").groupBy("setup").applyInPandas(run, "setup string, idx int, channel int, ref int, lag int, r double, part double")


def synthesis_errors(synthetic: DataFrame) -> DataFrame:
    """setup, channel, ref, rms: root mean squared distance of all modes' sum from the correlations."""
    whole = synthetic.groupBy("setup", "channel", "ref", "lag").agg(F.first("r").alias("r"), F.sum("part").alias("s"))
    return whole.groupBy("setup", "channel", "ref").agg(F.sqrt(F.avg(F.pow(F.col("s") - F.col("r"), 2))).alias("rms"))


def synthetic_spectra(synthetic: DataFrame, lags: int, decay: float = 0.001) -> DataFrame:
    """setup, idx, channel, ref, k, re, im: half spectra of each mode's part."""
    names = synthetic.select("setup", "idx").distinct().withColumn("one", F.sha2(F.to_json(F.struct("setup", "idx")), 256))
    parts = synthetic.join(names, ["setup", "idx"]).select(F.col("one").alias("setup"), "channel", "ref", "lag", F.col("part").alias("r"))
    return half_spectra(parts, lags, decay).withColumnRenamed("setup", "one").join(names, "one").select("setup", "idx", "channel", "ref", "k", "re", "im")


def residue_parts(spectra: np.ndarray, s: np.ndarray, mu: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shapes (channels, modes), parts (modes + 2, channels, references, lines)) by least squares: poles with participation vectors, and an upper and a lower residual.

    ``spectra``: (channels, references, lines); ``part``: (references, modes).  The last two parts are the residuals."""
    nl, nr, m = spectra.shape
    one, two = part.T[:, :, None] / (s - mu[:, None])[:, None], part.conj().T[:, :, None] / (s - mu.conj()[:, None])[:, None]
    waves = [np.concatenate([one + two, 1j * (one - two)]).reshape(2 * len(mu), -1).T]
    for line in (np.ones(m), 1 / np.where(s == 0, np.inf, s) ** 2):
        for k in range(nr):
            unit = np.zeros((nr, m), complex)
            unit[k] = line
            waves += [unit.reshape(-1, 1), 1j * unit.reshape(-1, 1)]
    basis = np.hstack(waves)
    real = np.vstack([basis.real, basis.imag])
    y = spectra.reshape(nl, -1)
    fit = np.linalg.lstsq(real, np.hstack([y.real, y.imag]).T, rcond=None)[0]
    k = len(mu)
    columns = [[i, k + i] for i in range(k)] + [list(range(2 * k, 2 * k + 2 * nr)), list(range(2 * k + 2 * nr, 2 * k + 4 * nr))]
    return (fit[:k] + 1j * fit[k : 2 * k]).T, np.stack([(basis[:, c] @ fit[c]).T.reshape(spectra.shape) for c in columns])


def residues(spectra: np.ndarray, s: np.ndarray, mu: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shapes (channels, modes), fitted spectra)."""
    shapes, parts = residue_parts(spectra, s, mu, part)
    return shapes, parts.sum(0)


def fraction_modes(r: np.ndarray, rate: float, order: int, decay: float, band: tuple[float, float] | None) -> tuple:
    """(spectra, frequencies, continuous poles with the window's decay, participation of the references, decay per sample) of one order."""
    spectra, freq, alpha, factor = plscf_model(r, order, rate, decay, band)
    nr = r.shape[1]
    blocks = [alpha[i * nr : (i + 1) * nr] for i in range(order + 1)]
    companion = np.zeros((order * nr, order * nr))
    companion[nr:, :-nr] = np.eye((order - 1) * nr)
    companion[:nr] = np.hstack([-blocks[order - 1 - i] for i in range(order)])
    lam = np.linalg.eigvals(companion)
    lam = lam[one_of_pairs(lam / np.maximum(1, abs(lam)))]
    mu = np.log(lam) * rate
    keep = (mu.imag > 0) & (-(mu.real + factor * rate) > 0)
    lam, mu = lam[keep], mu[keep]
    part = [np.linalg.svd(sum(b * v**i for i, b in enumerate(blocks)))[0][:, -1].conj() for v in lam]
    return spectra, freq, mu, np.stack(part, 1) if part else np.zeros((nr, 0), complex), factor


def modal_spectra(corr: DataFrame, rate: float, order: int, decay: float = 0.001, band: tuple[float, float] | None = None) -> DataFrame:
    """setup, idx, f, channel, ref, k, re, im, data_re, data_im: every mode's part of the half spectra of the frequency-domain fit, beside these.

    Modes are numbered by frequency; idx -1 and -2 are the residuals of modes above and below the band.  The parts sum up to the fit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, out = tensor(pdf), []
        spectra, freq, mu, part, _ = fraction_modes(r, rate, order, decay, band)
        parts = residue_parts(spectra, 2j * np.pi * freq, mu, part)[1]
        place = {int(i): n for n, i in enumerate(np.argsort(abs(mu), kind="stable"))} | {len(mu): -1, len(mu) + 1: -2}
        c, ref, k = np.meshgrid(np.sort(pdf["channel"].unique()), np.sort(pdf["ref"].unique()), np.rint(freq * r.shape[2] / rate).astype(int), indexing="ij")
        for i, p in enumerate(parts):
            f = abs(mu[i]) / (2 * np.pi) if i < len(mu) else np.nan
            out.append(pd.DataFrame({"setup": pdf["setup"].iloc[0], "idx": place[i], "f": f, "channel": c.ravel(), "ref": ref.ravel(), "k": k.ravel(), "re": p.real.ravel(), "im": p.imag.ravel(), "data_re": spectra.real.ravel(), "data_im": spectra.imag.ravel()}))
        return pd.concat(out)

    return gathered(corr).groupBy("setup").applyInPandas(run, "setup string, idx int, f double, channel int, ref int, k int, re double, im double, data_re double, data_im double")


def spectral_contributions(parts: DataFrame) -> DataFrame:
    """setup, idx, f, mc_re, mc_im: mean over the pairs of the product of a mode's part with the spectra over the norms of the spectra and of the fit (complex share)."""
    key = ["setup", "channel", "ref"]
    lines = parts.groupBy(*key, "k").agg(F.sum("re").alias("s"), F.sum("im").alias("t"), F.first("data_re").alias("x"), F.first("data_im").alias("y"))
    norms = lines.groupBy(*key).agg(F.sqrt(F.sum(F.col("s") ** 2 + F.col("t") ** 2) * F.sum(F.col("x") ** 2 + F.col("y") ** 2)).alias("norm"))
    x, y, a, b = (F.col(c) for c in ("data_re", "data_im", "re", "im"))
    dots = parts.groupBy(*key, "idx").agg(F.first("f").alias("f"), F.sum(x * a + y * b).alias("u"), F.sum(x * b - y * a).alias("v"))
    share = lambda c: F.avg(F.when(F.col("norm") > 0, F.col(c) / F.col("norm")).otherwise(0.0))
    return dots.join(norms, key).groupBy("setup", "idx").agg(F.first("f").alias("f"), share("u").alias("mc_re"), share("v").alias("mc_im"))


def residual_poles(corr: DataFrame, rate: float, order: int, decay: float = 0.001, band: tuple[float, float] | None = None) -> DataFrame:
    """setup, idx, f, d, phi_re, phi_im, fit: poles of the poly-reference frequency-domain method with shapes from residues and residuals.

    ``fit``: share of the spectra's power that the synthesis leaves unexplained, the same in all rows of a setup."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spectra, freq, mu, part, factor = fraction_modes(tensor(pdf), rate, order, decay, band)
        if not len(mu):
            return pd.DataFrame(columns=["setup", "idx", "f", "d", "phi_re", "phi_im", "fit"])
        shapes, fitted = residues(spectra, 2j * np.pi * freq, mu, part)
        left = (abs(spectra - fitted) ** 2).sum() / (abs(spectra) ** 2).sum()
        rows = []
        for f, d, phi in sorted(((abs(v) / (2 * np.pi), -100 * (v.real + factor * rate) / abs(v), shapes[:, i]) for i, v in enumerate(mu)), key=lambda x: (x[0], x[1])):
            phi = phi / phi[np.argmax(abs(phi))]
            rows.append((pdf["setup"].iloc[0], len(rows), f, d, phi.real.tolist(), phi.imag.tolist(), left))
        return pd.DataFrame(rows, columns=["setup", "idx", "f", "d", "phi_re", "phi_im", "fit"])

    return gathered(corr).groupBy("setup").applyInPandas(run, "setup string, idx int, f double, d double, phi_re array<double>, phi_im array<double>, fit double")
