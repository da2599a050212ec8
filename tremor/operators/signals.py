"""Pre-processing of signals (setup, n, channel, y): everything is partitioned by setup and channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.operators.kalman import states
from tremor.operators.quantiles import quantiles

KEY = ("setup", "channel")


def power_and_rms(signals: DataFrame) -> DataFrame:
    """setup, channel, power, rms."""
    power = F.avg(F.col("y") * F.col("y"))
    return signals.groupBy(*KEY).agg(power.alias("power"), F.sqrt(power).alias("rms"))


def correct_offset(signals: DataFrame) -> DataFrame:
    """y minus the mean of its channel: a small aggregate joined back, so no channel has to fit one task."""
    means = signals.groupBy(*KEY).agg(F.avg("y").alias("mean"))
    return signals.join(means, list(KEY)).select("setup", "n", "channel", (F.col("y") - F.col("mean")).alias("y"))


def scale_factors(signals: DataFrame, method: str = "iqr") -> DataFrame:
    """setup, channel, factor: the spread between the 5th and 95th percentile, or the range."""
    if method == "iqr":
        return quantiles(signals, KEY, "y", [0.05, 0.95]).select(*KEY, (F.col("q1") - F.col("q0")).alias("factor"))
    if method == "range":
        spread = F.max("y") - F.min("y")
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return signals.groupBy(*KEY).agg(spread.alias("factor"))


def precondition(signals: DataFrame, method: str = "iqr") -> DataFrame:
    centred = correct_offset(signals)
    return centred.join(scale_factors(centred, method), list(KEY)).select("setup", "n", "channel", (F.col("y") / F.col("factor")).alias("y"))


def add_noise(signals: DataFrame, amplitude: float = 0.0, snr: float = 0.0, seed: int = 0) -> DataFrame:
    """Gaussian noise of an absolute amplitude, or of a fraction of each channel's RMS."""
    if not snr:
        return signals.withColumn("y", F.col("y") + amplitude * F.randn(seed))
    rms = power_and_rms(signals).select(*KEY, "rms")
    return signals.join(rms, list(KEY)).select("setup", "n", "channel", (F.col("y") + snr * F.col("rms") * F.randn(seed)).alias("y"))


def delete_channels(signals: DataFrame, gone: list[int]) -> DataFrame:
    """Drop channels and number the others anew, in order; ``old`` keeps the number they had."""
    kept = signals.where(~F.col("channel").isin(*gone)) if gone else signals
    dense = Window.partitionBy("setup").orderBy("channel")
    names = kept.select(*KEY).distinct().withColumn("new", (F.row_number().over(dense) - 1).cast("int"))
    return kept.join(names, list(KEY)).select("setup", "n", F.col("new").alias("channel"), F.col("channel").alias("old"), "y")


def fir(signals: DataFrame, taps: list[float]) -> DataFrame:
    """Causal convolution with zero initial state, as an equi-join on shifted sample numbers."""
    table = signals.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(taps)], "lag int, tap double")
    spread = signals.crossJoin(F.broadcast(table)).select("setup", "channel", (F.col("n") + F.col("lag")).alias("n"), (F.col("y") * F.col("tap")).alias("part"))
    summed = spread.groupBy("setup", "channel", "n").agg(F.sum("part").alias("y"))
    return summed.join(signals.select("setup", "channel", "n"), ["setup", "channel", "n"], "left_semi").select("setup", "n", "channel", "y")


def moving_average(signals: DataFrame, order: int) -> DataFrame:
    """Causal mean over ``order`` samples; the divisor is ``order`` from the start."""
    return fir(signals, [1.0 / order] * order)


def brickwall_taps(order: int, cutoff: float) -> list[float]:
    """Low-pass window-design taps (Hamming), cutoff as a fraction of the Nyquist rate, unit gain at 0."""
    k = np.arange(order) - (order - 1) / 2
    h = cutoff * np.sinc(cutoff * k) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order) / max(1, order - 1)))
    return (h / h.sum()).tolist()


def _landen(k: float) -> list[float]:
    out = []
    while k > 1e-16 and len(out) < 12:
        k = (k / (1 + np.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _elliptic(start: np.ndarray, k: float) -> np.ndarray:
    """cd or sn at a point whose circular cosine or sine is ``start``, by ascending Landen steps."""
    w = np.asarray(start, complex)
    for v in reversed(_landen(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _elliptic_inverse_sn(w: complex, k: float) -> complex:
    """u with sn(u K, k) = w, in units of the quarter period."""
    before = k
    for v in _landen(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - w * w * before * before + 0j)))
        before = v
    return 2 / np.pi * np.arcsin(w + 0j)


def prototype(kind: str, order: int, ripple: float, attenuation: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(zeros, poles, gain) of the analogue low-pass with its corner at 1 rad/s; ripple and attenuation in dB."""
    m = np.arange(-order + 1, order, 2)
    none = np.zeros(0, complex)
    if kind == "butter":
        return none, -np.exp(1j * np.pi * m / (2 * order)), 1.0
    if kind == "cheby1":
        eps = np.sqrt(10 ** (0.1 * ripple) - 1)
        poles = -np.sinh(np.arcsinh(1 / eps) / order + 1j * np.pi * m / (2 * order))
        return none, poles, np.prod(-poles).real / (np.sqrt(1 + eps * eps) if order % 2 == 0 else 1.0)
    if kind == "cheby2":
        mu = np.arcsinh(np.sqrt(10 ** (0.1 * attenuation) - 1)) / order
        zeros = 1j / np.sin(np.pi * m[m != 0] / (2 * order))
        round_ = -np.exp(1j * np.pi * m / (2 * order))
        poles = 1 / (np.sinh(mu) * round_.real + 1j * np.cosh(mu) * round_.imag)
        return zeros, poles, (np.prod(-poles) / np.prod(-zeros)).real
    if kind == "bessel":
        rising = [1.0]  # reverse Bessel polynomial, highest power first
        for j in range(1, order + 1):
            rising.append(rising[-1] * (order + j) * (order - j + 1) / (2 * j))
        poles = np.roots(rising)
        return none, poles / rising[-1] ** (1 / order), 1.0
    if kind == "ellip":
        if not 0 < ripple < attenuation:
            raise ValueError("an elliptic filter needs 0 < ripple < attenuation")
        ep, es = np.sqrt(10 ** (0.1 * ripple) - 1), np.sqrt(10 ** (0.1 * attenuation) - 1)
        k1 = ep / es
        half = np.arange(1, order // 2 + 1)
        u = (2 * half - 1) / order
        k1c = np.sqrt(1 - k1 * k1)
        kc = k1c**order * np.prod(_elliptic(np.sin(u * np.pi / 2), k1c).real) ** 4
        k = np.sqrt(1 - kc * kc)
        v0 = (-1j * _elliptic_inverse_sn(1j / ep, k1) / order).real
        zeros = 1j / (k * _elliptic(np.cos(u * np.pi / 2), k).real)
        upper = 1j * _elliptic(np.cos((u - 1j * v0) * np.pi / 2), k)
        poles = np.concatenate([upper, upper.conj(), 1j * _elliptic(np.sin(1j * v0 * np.pi / 2), k).ravel()[: order % 2]])
        zeros = np.concatenate([zeros, zeros.conj()])
        level = 10 ** (-ripple / 20) if order % 2 == 0 else 1.0
        return zeros, poles, (level * np.prod(-poles) / np.prod(-zeros)).real
    raise ValueError(f"unknown filter {kind!r}")


def _coefficients(roots: np.ndarray) -> list[list[float]]:
    """[1, b, c] of conjugate pairs and of pairs of real roots; an odd one gives [1, b, 0]."""
    out = [[1.0, -2 * q.real, abs(q) ** 2] for q in sorted((q for q in roots if q.imag > 1e-10), key=abs)]
    reals = sorted((q.real for q in roots if abs(q.imag) <= 1e-10), key=abs)
    for i in range(0, len(reals) - 1, 2):
        out.append([1.0, -reals[i] - reals[i + 1], reals[i] * reals[i + 1]])
    return out + ([[1.0, -reals[-1], 0.0]] if len(reals) % 2 else [])


def sections(order: int, low: float | None = None, high: float | None = None, kind: str = "butter", ripple: float = 3.0, attenuation: float = 3.0) -> np.ndarray:
    """Second-order sections of a digital filter by the bilinear transform; corners in fractions of the Nyquist rate.

    ``low`` alone: what lies below it passes; ``high`` alone: what lies above it; both: the band between them."""
    if low is None and high is None:
        raise ValueError("no corner frequency")
    z, p, gain = prototype(kind, order, ripple, attenuation)
    extra = len(p) - len(z)
    warp = lambda f: 4 * np.tan(np.pi * f / 2)
    if high is None:
        w = warp(low)
        z, p, gain = z * w, p * w, gain * w**extra
    elif low is None:
        w = warp(high)
        gain *= (np.prod(-z) / np.prod(-p)).real
        z, p = np.concatenate([w / z, np.zeros(extra)]), w / p
    else:
        a, b = sorted((warp(low), warp(high)))
        width, middle = b - a, a * b
        wide = lambda r: np.concatenate([r * width / 2 + s * np.sqrt((r * width / 2) ** 2 - middle + 0j) for s in (1, -1)])
        z, p, gain = np.concatenate([wide(z), np.zeros(extra)]), wide(p), gain * width**extra
    extra = len(p) - len(z)
    gain *= (np.prod(4 - z) / np.prod(4 - p)).real
    z, p = np.concatenate([(4 + z) / (4 - z), -np.ones(extra)]), (4 + p) / (4 - p)
    top, bottom = _coefficients(z), _coefficients(p)
    sos = np.array([[*t, *b] for t, b in zip(top, bottom)])
    sos[0, :3] *= gain
    return sos


def sos_lowpass(order: int, cutoff: float, kind: str = "butter", ripple: float = 0.05) -> np.ndarray:
    """Second-order sections of a digital low-pass; ``cutoff`` in fractions of Nyquist."""
    return sections(order, cutoff, None, kind, ripple, 40.0)


def _sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    for b0, b1, b2, _, a1, a2 in sos:
        inputs = np.outer(x, [b1 - a1 * b0, b2 - a2 * b0])
        x = b0 * x + states(np.array([[-a1, 1.0], [-a2, 0.0]]), inputs, np.zeros(2))[:-1, 0]
    return x


def impulse_response(sos: np.ndarray, floor: float = 1e-16) -> np.ndarray:
    """The response until it has died away, which the largest pole tells."""
    radius = max(abs(np.roots([1, a1, a2])).max(initial=0.0) for *_, a1, a2 in sos)
    if radius >= 1:
        raise ValueError("the filter is not stable")
    n = 8 * len(sos) + (int(np.ceil(np.log(floor) / np.log(radius))) if radius > 0 else 1)
    return _sections(sos, np.eye(1, n)[0])


def _convolved(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Causal filtering of ``x``, which stood at its first value for ever."""
    wide = np.concatenate([np.full(len(h) - 1, x[0]), x])
    size = 1 << int(len(wide) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(wide, size) * np.fft.rfft(h, size), size)[len(h) - 1 : len(wide)]


def edge(sos: np.ndarray) -> int:
    """Samples by which the ends of a signal are extended."""
    return 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))


def zero_phase(sos: np.ndarray, x: np.ndarray, left: bool = True, right: bool = True, h: np.ndarray | None = None) -> np.ndarray:
    """Forward and backward filtering; ``left`` and ``right``: these ends are those of the signal and extended oddly."""
    h = impulse_response(sos) if h is None else h
    pad = min(len(x) - 1, edge(sos))
    parts = [2 * x[0] - x[pad:0:-1]] if left and pad > 0 else []
    wide = np.concatenate([*parts, x, *([2 * x[-1] - x[-2 : -pad - 2 : -1]] if right and pad > 0 else [])])
    back = _convolved(h, _convolved(h, wide)[::-1])[::-1]
    at = len(parts[0]) if parts else 0
    return back[at : at + len(x)]


def filter_signals(signals: DataFrame, rate: float, lowpass: float | None = None, highpass: float | None = None, order: int | None = None, kind: str = "butter", ripple: float = 3.0, attenuation: float = 3.0, chunk: int = 1 << 16) -> DataFrame:
    """Filtered signals; corners in the unit of ``rate``.

    Recursive kinds (butter, cheby1, cheby2, ellip, bessel) run forwards and backwards.  A channel is cut into chunks; each
    takes as many samples of its neighbours along as the impulse response lasts, so chunks are tasks of their own.
    moving_average and brickwall are causal and meet by a join."""
    if kind == "moving_average":
        return moving_average(signals, order or 21)
    if kind == "brickwall":
        return fir(signals, band_taps(order or 21, lowpass and 2 * lowpass / rate, highpass and 2 * highpass / rate))
    if order is not None and order <= 1:
        raise ValueError("the order must be greater than 1")
    share = lambda f: None if f is None else 2 * f / rate
    sos = sections(order or 4, share(lowpass), share(highpass), kind, ripple, attenuation)
    h = impulse_response(sos)
    halo = max(len(h), edge(sos) + 1)
    size = max(chunk, halo)
    ends = signals.groupBy("setup").agg(F.max("n").alias("last"))
    first = F.greatest(F.floor((F.col("n") - halo) / size).cast("int"), F.lit(0))
    last = F.least(F.floor((F.col("n") + halo) / size), F.floor(F.col("last") / size)).cast("int")
    spread = signals.join(F.broadcast(ends), "setup").withColumn("chunk", F.explode(F.sequence(first, last)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        y = zero_phase(sos, pdf["y"].to_numpy(float), pdf["n"].iloc[0] == 0, pdf["n"].iloc[-1] == pdf["last"].iloc[0], h)
        return pdf.assign(y=y)[pdf["n"] // size == pdf["chunk"].iloc[0]][["setup", "n", "channel", "y"]]

    return spread.groupBy(*KEY, "chunk").applyInPandas(run, "setup string, n int, channel int, y double")


def filter_lowpass(signals: DataFrame, cutoff: float, order: int = 4, kind: str = "butter", ripple: float = 0.05) -> DataFrame:
    """Zero-phase recursive low-pass; ``cutoff`` in fractions of Nyquist."""
    return filter_signals(signals, 2.0, cutoff, None, order, kind, ripple, 40.0)


def band_taps(order: int, low: float | None, high: float | None) -> list[float]:
    """Window-design taps (Hamming) below ``low``, above ``high`` or between them; gain 1 in the middle of what passes."""
    if low is None and high is None:
        raise ValueError("no corner frequency")
    a, b = (0.0, low) if high is None else (high, 1.0) if low is None else sorted((low, high))
    k = np.arange(order) - (order - 1) / 2
    h = (b * np.sinc(b * k) - a * np.sinc(a * k)) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order) / max(1, order - 1)))
    middle = 0.0 if high is None else 1.0 if low is None else (a + b) / 2
    return (h / (h * np.cos(np.pi * k * middle)).sum()).tolist()


def decimated(signals: DataFrame, factor: int, rate: float, nyquist_ratio: float = 2.5, highpass: float | None = None, order: int | None = None, kind: str = "cheby1") -> DataFrame:
    """Anti-alias filter at the new rate over ``nyquist_ratio``, then every ``factor``-th sample times ``factor``."""
    if factor < 1 or nyquist_ratio < 2:
        raise ValueError("factor is at least 1 and nyquist_ratio at least 2")
    default = 21 * factor - 1 if kind in ("brickwall", "moving_average") else 8
    return decimate(filter_signals(signals, rate, rate / factor / nyquist_ratio, highpass, order or default, kind, 0.05, 0.05), factor)


def decimate(filtered: DataFrame, factor: int, rescale: bool = True) -> DataFrame:
    """Every ``factor``-th sample of the whole groups, scaled by ``factor`` as the time step grows."""
    ends = filtered.groupBy("setup").agg((F.floor((F.max("n") + 1) / factor) * factor).alias("end"))
    taken = filtered.join(ends, "setup").where((F.col("n") % factor == 0) & (F.col("n") < F.col("end")))
    return taken.select("setup", (F.col("n") / factor).cast("int").alias("n"), "channel", (F.col("y") * (factor if rescale else 1)).alias("y"))
