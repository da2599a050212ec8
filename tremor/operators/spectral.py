"""Correlation functions and power spectra of signals (setup, n, channel, y)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TWO_PI = 2 * np.pi


def _blocks(signals: DataFrame, length: int, blocks: int) -> DataFrame:
    """Tumbling blocks of ``length`` samples; trailing samples are left out."""
    return signals.where(F.col("n") < length * blocks).select("setup", F.floor(F.col("n") / length).cast("int").alias("block"), (F.col("n") % length).cast("int").alias("n"), "channel", "y")


def corr_bt(signals: DataFrame, refs: Sequence[int], lags: int, length: int, blocks: int = 1) -> DataFrame:
    """setup, block, channel, ref, lag, r: unbiased correlation of each block of ``length`` samples.

    References are spread over the lags, then meet all channels by an equi-join on the sample number."""
    cut = _blocks(signals, length, blocks)
    lag = F.explode(F.sequence(F.lit(0), F.lit(lags - 1))).alias("lag")
    spread = cut.where(F.col("channel").isin(*refs)).select("setup", "block", "n", F.col("channel").alias("ref"), F.col("y").alias("x"), lag).withColumn("n", F.col("n") + F.col("lag"))
    return cut.join(spread, ["setup", "block", "n"]).groupBy("setup", "block", "channel", "ref", "lag").agg((F.sum(F.col("y") * F.col("x")) / (F.lit(length) - F.col("lag"))).alias("r"))


def corr_bt_chunked(signals: DataFrame, refs: Sequence[int], lags: int, length: int, chunk: int = 4096) -> DataFrame:
    """The same for one block and many lags: chunks of samples with a halo give partial sums per lag."""
    at = F.floor(F.col("n") / chunk).cast("int")
    homes = F.when(F.col("n") >= chunk, F.sequence(F.greatest(F.floor((F.col("n") - lags + 1) / chunk).cast("int"), F.lit(0)), at)).otherwise(F.array(at))
    spread = signals.where(F.col("n") < length).withColumn("chunk", F.explode(homes))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf["chunk"].iloc[0]) * chunk
        wide = pdf.pivot_table(index="n", columns="channel", values="y")
        size = int(wide.index.max()) - base + 1
        y = np.zeros((size, wide.shape[1]))
        y[wide.index.to_numpy() - base] = wide.to_numpy()
        channels, mine = wide.columns.to_numpy(), min(chunk, size)
        x = y[:mine][:, [int(np.flatnonzero(channels == r)[0]) for r in refs]]
        out = []
        for lag in range(min(lags, size)):
            n = min(mine, size - lag)
            s = y[lag : lag + n].T @ x[:n]
            out.append(pd.DataFrame({"channel": np.repeat(channels, len(refs)), "ref": np.tile(refs, len(channels)), "lag": lag, "part": s.ravel()}))
        res = pd.concat(out)
        res.insert(0, "setup", pdf["setup"].iloc[0])
        return res

    parts = spread.groupBy("setup", "chunk").applyInPandas(partial, "setup string, channel int, ref int, lag int, part double")
    return parts.groupBy("setup", "channel", "ref", "lag").agg((F.sum("part") / (F.lit(length) - F.col("lag"))).alias("r"))


def over_blocks(corr: DataFrame) -> DataFrame:
    """Mean and population variance over the blocks."""
    return corr.groupBy("setup", "channel", "ref", "lag").agg(F.avg("r").alias("r"), F.var_pop("r").alias("var_r"))


#: Periodic windows as sums of cosines with alternating signs.
WINDOWS = {"boxcar": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411)}


def taper(window: str, length: int) -> np.ndarray:
    """A window of ``length`` points of a longer period, for spectra."""
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    n = np.arange(length)
    return sum((-1) ** i * a * np.cos(TWO_PI * i * n / length) for i, a in enumerate(WINDOWS[window])) + np.zeros(length)


def _taper(window: str, length: int) -> Column:
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    return sum((F.lit((-1) ** i * a) * F.cos(F.lit(TWO_PI * i) * F.col("n") / length) for i, a in enumerate(WINDOWS[window])), F.lit(0.0))


def fourier(signals: DataFrame, length: int, segments: int, window: str = "hamming", last: int = 0) -> DataFrame:
    """setup, block, channel, k, re, im of each segment's mean-free, tapered transform.

    ``last``: samples of a shorter last segment; they have a mean and a taper of their own, and zeros follow."""
    cut = _blocks(signals, length, segments)
    means = cut.groupBy("setup", "block", "channel").agg(F.avg("y").alias("mean"))
    shape = F.when(F.col("block") == segments - 1, _taper(window, last)).otherwise(_taper(window, length)) if last else _taper(window, length)
    tapered = cut.join(means, ["setup", "block", "channel"]).select("setup", "block", "channel", "n", ((F.col("y") - F.col("mean")) * shape).alias("y"))
    waves = tapered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length // 2))))
    angle = F.lit(TWO_PI) * ((F.col("k") * F.col("n")) % length) / length
    return waves.groupBy("setup", "block", "channel", "k").agg(F.sum(F.col("y") * F.cos(angle)).alias("re"), (-F.sum(F.col("y") * F.sin(angle))).alias("im"))


def fourier_fft(signals: DataFrame, length: int, segments: int, window: str = "hamming", last: int = 0) -> DataFrame:
    """The same by FFT, for long segments: one group per segment and channel."""
    whole, short = taper(window, length), taper(window, last)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        shape = short if last and head["block"] == segments - 1 else whole
        y = np.zeros(len(shape))
        y[pdf["n"].to_numpy()] = pdf["y"]
        z = np.fft.rfft((y - y.mean()) * shape, length)
        return pd.DataFrame({"setup": head["setup"], "block": head["block"], "channel": head["channel"], "k": np.arange(len(z), dtype="int32"), "re": z.real, "im": z.imag})

    return _blocks(signals, length, segments).groupBy("setup", "block", "channel").applyInPandas(run, "setup string, block int, channel int, k int, re double, im double")


def psd_welch(signals: DataFrame, refs: Sequence[int], length: int, segments: int, fft: bool = False, by_segment: bool = False, window: str = "hamming", last: int = 0) -> DataFrame:
    """setup, channel, ref, k, re, im: averaged cross spectra; first and last line are halved.

    ``last``: samples of the last segment where it is shorter than ``length``; it counts by its share of all samples. By segment there are also block and that share."""
    z = (fourier_fft if fft else fourier)(signals, length, segments, window, last)
    x = z.where(F.col("channel").isin(*refs)).select("setup", "block", "k", F.col("channel").alias("ref"), F.col("re").alias("xr"), F.col("im").alias("xi"))
    samples = length * segments - (length - last if last else 0)
    size = F.when(F.col("block") == segments - 1, F.lit(last or length)).otherwise(F.lit(length))
    scale = F.lit(samples * length / (2 * float(np.sum(taper(window, length) ** 2)))) / size
    side = F.when((F.col("k") == 0) | (F.col("k") == length // 2), scale / 2).otherwise(scale)
    products = z.join(x, ["setup", "block", "k"]).select("setup", "block", "channel", "ref", "k", (size / F.lit(samples)).alias("share"), (side * (F.col("re") * F.col("xr") + F.col("im") * F.col("xi"))).alias("re"), (side * (F.col("re") * F.col("xi") - F.col("im") * F.col("xr"))).alias("im"))
    if by_segment:
        return products
    return products.groupBy("setup", "channel", "ref", "k").agg(*[(F.sum(F.col("share") * F.col(c)) / F.sum("share")).alias(c) for c in ("re", "im")])


def over_segments(products: DataFrame) -> DataFrame:
    """setup, channel, ref, k, re, im and var: the mean squared distance of the segments from their mean, each by its share of all samples."""
    pair = ["setup", "channel", "ref", "k"]
    # Segments of one size have plain moments; those of the (at most two) sizes of a line are put together.
    sizes = products.groupBy(*pair, "share").agg((F.count("*") * F.col("share")).alias("weight"), F.avg("re").alias("re"), F.avg("im").alias("im"), (F.var_pop("re") + F.var_pop("im")).alias("var"))
    line = Window.partitionBy(*pair)
    means = sizes.withColumns({f"mean_{c}": F.sum(F.col("weight") * F.col(c)).over(line) / F.sum("weight").over(line) for c in ("re", "im")})
    off = F.col("var") + (F.col("re") - F.col("mean_re")) ** 2 + (F.col("im") - F.col("mean_im")) ** 2
    return means.groupBy(*pair).agg(F.first("mean_re").alias("re"), F.first("mean_im").alias("im"), (F.sum(F.col("weight") * off) / F.sum("weight")).alias("var"))


def scaling_factors(psd: DataFrame) -> DataFrame:
    """setup, channel, ref, re, im: the largest line of every pair, by real and then imaginary part."""
    return psd.groupBy("setup", "channel", "ref").agg(F.max(F.struct("re", "im")).alias("top")).select("setup", "channel", "ref", "top.re", "top.im")


def in_band(lines: DataFrame, rate: float, length: int, low: float, high: float, closed: bool = False) -> DataFrame:
    """The lines k whose frequency lies in a band, open or closed."""
    f = F.col("k") * rate / length
    return lines.where((f >= low) & (f <= high) if closed else (f > low) & (f < high))


def scaled(psd: DataFrame, scale: str) -> DataFrame:
    """setup, channel, ref, k, value: the spectra as 'db', 'power', 'rms' or 'phase' in degrees."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    kinds = {"db": 10 * F.log10(size), "power": size, "rms": F.sqrt(size), "phase": F.degrees(F.atan2("im", "re"))}
    if scale not in kinds:
        raise ValueError(f"unknown scale {scale!r}")
    return psd.select("setup", "channel", "ref", "k", kinds[scale].alias("value"))


def sv_decibels(sv: DataFrame) -> DataFrame:
    """setup, k, place, db: singular values over the largest of the setup."""
    flat = sv.select("setup", "k", F.posexplode("sigma").alias("place", "sigma"))
    most = flat.groupBy("setup").agg(F.max("sigma").alias("most"))
    return flat.join(F.broadcast(most), "setup").select("setup", "k", "place", (10 * F.log10(F.col("sigma") / F.col("most"))).alias("db"))


def correlation(signals: DataFrame, refs: Sequence[int], lags: int, length: int, method: str = "blackman-tukey", segments: int = 1) -> DataFrame:
    """setup, channel, ref, lag, r by either method; ``length``: samples, or those of a segment of the Welch method."""
    if method == "blackman-tukey":
        return corr_bt_chunked(signals, refs, lags, length)
    if method == "welch":
        return corr_from_psd(psd_welch(signals, refs, length, segments, fft=True), lags)
    raise ValueError(f"unknown method {method!r}")


def spectra(signals: DataFrame, refs: Sequence[int], lines: int, samples: int, method: str = "welch") -> DataFrame:
    """setup, channel, ref, k, re, im by either method over ``samples`` samples."""
    if method == "welch":
        return psd_welch(signals, refs, lines, samples // lines, fft=True)
    if method == "blackman-tukey":
        return cross_spectra_bt(corr_bt_chunked(signals, refs, lines // 2, samples).drop("block"), lines // 2, samples)
    raise ValueError(f"unknown method {method!r}")


def block_covariances(signals: DataFrame, refs: Sequence[int], lags: int, length: int, blocks: int) -> DataFrame:
    """setup, block, channel, ref, lag, r of lags 1 .. ``lags``: products whose earlier sample lies in the block, over its length.

    The later sample may lie in the next block, so no product is lost at the borders."""
    used = signals.where(F.col("n") < length * blocks)
    lag = F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag")
    early = used.where(F.col("channel").isin(*refs)).select("setup", F.floor(F.col("n") / length).cast("int").alias("block"), "n", F.col("channel").alias("ref"), F.col("y").alias("x"), lag)
    moved = early.withColumn("n", F.col("n") + F.col("lag"))
    return used.join(moved, ["setup", "n"]).groupBy("setup", "block", "channel", "ref", "lag").agg((F.sum(F.col("y") * F.col("x")) / length).alias("r"))


def frequency_response(signals: DataFrame, force: DataFrame, length: int) -> DataFrame:
    """setup, channel, re array, im array, irf array: response over force, both under a symmetric Hamming window.

    ``force``: setup, n, f; one group per channel of one recorded test of ``length`` samples."""
    both = signals.where(F.col("n") < length).join(force, ["setup", "n"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, f = np.zeros(length), np.zeros(length)
        y[pdf["n"]], f[pdf["n"]] = pdf["y"], pdf["f"]
        h = np.fft.rfft(np.hamming(length) * y) / np.fft.rfft(np.hamming(length) * f)
        return pd.DataFrame({"setup": [pdf["setup"].iloc[0]], "channel": [pdf["channel"].iloc[0]], "re": [h.real.tolist()], "im": [h.imag.tolist()], "irf": [np.fft.irfft(h, length).tolist()]})

    return both.groupBy("setup", "channel").applyInPandas(run, "setup string, channel int, re array<double>, im array<double>, irf array<double>")


def power_check(signals: DataFrame, psd: DataFrame, corr: DataFrame) -> DataFrame:
    """setup, channel, ref, spectral, correlated, power: mean magnitude of the lines, lag 0, and mean |y x| of every pair."""
    spectral = psd.groupBy("setup", "channel", "ref").agg(F.avg(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("spectral"))
    lag0 = corr.where("lag = 0").select("setup", "channel", "ref", F.col("r").alias("correlated"))
    refs = psd.select(F.col("ref")).distinct()
    x = signals.join(F.broadcast(refs), signals["channel"] == refs["ref"]).select("setup", "n", "ref", F.col("y").alias("x"))
    product = signals.join(x, ["setup", "n"]).groupBy("setup", "channel", "ref").agg(F.avg(F.abs(F.col("y") * F.col("x"))).alias("power"))
    return spectral.join(lag0, ["setup", "channel", "ref"]).join(product, ["setup", "channel", "ref"])


def corr_from_psd(psd: DataFrame, lags: int) -> DataFrame:
    """setup, channel, ref, lag, r: inverse transform of the one-sided spectrum over 2 (m - 1) lines."""
    n = 2 * (lags - 1)
    spread = psd.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))))
    angle = F.lit(TWO_PI) * ((F.col("k") * F.col("lag")) % n) / n
    weight = F.when((F.col("k") == 0) | (F.col("k") == lags - 1), 1.0).otherwise(2.0)
    wave = F.col("re") * F.cos(angle) - F.when((F.col("k") == 0) | (F.col("k") == lags - 1), 0.0).otherwise(F.col("im")) * F.sin(angle)
    return spread.groupBy("setup", "channel", "ref", "lag").agg((F.sum(weight * wave) / (n * n)).alias("r"))


def lag_window(half: int, window: str = "hamming") -> list[float]:
    """A window of ``half`` points convolved with itself, from lag 0 on."""
    w = taper(window, half)
    return [float(w[: half - d] @ w[d:]) / half for d in range(half)] + [0.0]


def _lagged(corr: DataFrame, half: int, window: str) -> tuple[DataFrame, float]:
    w = taper(window, half)
    windows = corr.sparkSession.createDataFrame(list(enumerate(lag_window(half, window))), "lag int, w double")
    return corr.join(F.broadcast(windows), "lag"), float(np.sum(w**2) / np.sum(w) ** 2 * half)


def psd_bt(corr: DataFrame, half: int, samples: int) -> DataFrame:
    """setup, channel, ref, k, s: cosine transform of the evenly extended correlation under a lag window."""
    scale = 2 * samples * half / float(np.sum(taper("hamming", half)))
    spread = _lagged(corr, half, "hamming")[0].withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(half))))
    angle = F.lit(TWO_PI) * ((F.col("k") * F.col("lag")) % (2 * half)) / (2 * half)
    return spread.groupBy("setup", "channel", "ref", "k").agg((scale * F.sum(F.when(F.col("lag") == 0, 1.0).otherwise(2.0) * F.col("w") * F.col("r") * F.cos(angle))).alias("s"))


def cross_spectra_bt(corr: DataFrame, half: int, samples: int, window: str = "hann") -> DataFrame:
    """setup, channel, ref, k, re, im: correlation-based cross spectra with their phase, scaled to power density by the window's noise bandwidth.

    The correlation at a negative lag is that of the exchanged channels, so pairs both of whose channels are references have a phase;
    ``corr`` without the exchanged pair is extended evenly."""
    lagged, width = _lagged(corr, half, window)
    swapped = lagged.select("setup", F.col("ref").alias("channel"), F.col("channel").alias("ref"), "lag", F.col("r").alias("back"))
    both = lagged.join(swapped, ["setup", "channel", "ref", "lag"], "left").withColumn("back", F.coalesce("back", "r"))
    spread = both.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(half))))
    angle = F.lit(TWO_PI) * ((F.col("k") * F.col("lag")) % (2 * half)) / (2 * half)
    later = F.when(F.col("lag") == 0, 0.0).otherwise(1.0) * F.col("back")
    scale = 2.0 * samples * width
    re, im = (F.col("r") + later) * F.cos(angle), (later - F.when(F.col("lag") == 0, 0.0).otherwise(F.col("r"))) * F.sin(angle)
    return spread.groupBy("setup", "channel", "ref", "k").agg((scale * F.sum(F.col("w") * re)).alias("re"), (scale * F.sum(F.col("w") * im)).alias("im"))


def half_spectra(corr: DataFrame, lags: int, decay: float = 0.001) -> DataFrame:
    """setup, channel, ref, k, re, im: transform of the exponentially windowed positive lags."""
    tau = -lags / np.log(decay)
    spread = corr.where(F.col("lag") < lags).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(lags // 2))))
    angle = F.lit(TWO_PI) * ((F.col("k") * F.col("lag")) % lags) / lags
    y = F.col("r") * F.exp(-F.col("lag") / F.lit(float(tau)))
    return spread.groupBy("setup", "channel", "ref", "k").agg(F.sum(y * F.cos(angle)).alias("re"), (-F.sum(y * F.sin(angle))).alias("im"))


def sv_psd(psd: DataFrame) -> DataFrame:
    """setup, k, sigma: singular values of the spectral matrix of every line; a matrix is channels x references."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = (pdf.assign(z=pdf["re"] + 1j * pdf["im"])).pivot(index="channel", columns="ref", values="z").to_numpy()
        return pd.DataFrame({"setup": [pdf["setup"].iloc[0]], "k": [pdf["k"].iloc[0]], "sigma": [np.linalg.svd(m, compute_uv=False).tolist()]})

    return psd.groupBy("setup", "k").applyInPandas(run, "setup string, k int, sigma array<double>")
