"""Correlation functions and spectra of one set of signals under the names of their methods."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators import channels, spectral

METHODS = ("blackman-tukey", "welch")


class Estimates:
    """What was estimated from ``signals``, by method; a call without a method takes the one used last.

    Before any call correlations come from the Blackman-Tukey method and spectra from Welch's.  Each method keeps its own lags and lines,
    and one call of a method gives both of its tables their length: ``lines`` = 2 (``lags`` - 1).  Welch's method reads whole segments of ``lines`` samples;
    samples after the last whole one take no part, as the method defines it."""

    def __init__(self, signals: DataFrame, refs: Sequence[int], samples: int, rate: float):
        self.signals, self.refs, self.samples, self.rate = signals, list(refs), samples, rate
        self.last: str | None = None
        self._lags: dict[str, int] = {}

    def _method(self, method: str | None, default: str) -> str:
        method = method or self.last or default
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
        return method

    def _take(self, method: str, lags: int | None) -> int:
        lags = lags or self._lags.get(method)
        if lags is None:
            raise ValueError(f"nothing was estimated by {method!r} yet: say how many lags or lines")
        if not 2 <= lags or 2 * (lags - 1) > self.samples:
            raise ValueError(f"{lags} lags need 2 to {self.samples // 2 + 1}")
        self.last, self._lags[method] = method, lags
        return lags

    def correlation(self, lags: int | None = None, method: str | None = None) -> DataFrame:
        """setup, channel, ref, lag, r; without ``lags`` those of the method's last call."""
        method = self._method(method, "blackman-tukey")
        return self._correlation(method, self._take(method, lags))

    def psd(self, lines: int | None = None, method: str | None = None) -> DataFrame:
        """setup, channel, ref, k, re, im of the lines 0 .. ``lines`` / 2; an odd number is raised by one."""
        method = self._method(method, "welch")
        return self._psd(method, self._take(method, lines and (lines + 1) // 2 + 1))

    def welch(self, lines: int) -> tuple[DataFrame, DataFrame]:
        """Former name: (correlation functions, spectra) by Welch's method."""
        warnings.warn("welch(lines) is now psd(lines, 'welch') and correlation(method='welch')", DeprecationWarning, stacklevel=2)
        psd = self.psd(lines, "welch")
        return self.correlation(method="welch"), psd

    def _correlation(self, method: str, lags: int) -> DataFrame:
        lines = 2 * (lags - 1)
        length, segments = (self.samples, 1) if method == "blackman-tukey" else (lines, self.samples // lines)
        return spectral.correlation(self.signals, self.refs, lags, length, method, segments).drop("block")

    def _psd(self, method: str, lags: int) -> DataFrame:
        return spectral.spectra(self.signals, self.refs, 2 * (lags - 1), self.samples, method)

    # views of the method used last -----------------------------------------------------------------

    @property
    def m_lags(self) -> int | None:
        return self._lags.get(self.last)

    @property
    def n_lines(self) -> int | None:
        return None if self.m_lags is None else 2 * (self.m_lags - 1)

    @property
    def corr_matrix(self) -> DataFrame | None:
        return None if self.last is None else self._correlation(self.last, self.m_lags)

    @property
    def psd_matrix(self) -> DataFrame | None:
        return None if self.last is None else self._psd(self.last, self.m_lags)

    def lags(self, method: str | None = None) -> DataFrame | None:
        """lag, tau in seconds of a method, of the last one if none is named."""
        lags = self._lags.get(method or self.last)
        return None if lags is None else channels.lag_axis(self.signals.sparkSession, self.rate, lags)

    def frequencies(self, method: str | None = None) -> DataFrame | None:
        """k, freq of a method, of the last one if none is named."""
        lags = self._lags.get(method or self.last)
        return None if lags is None else channels.frequency_axis(self.signals.sparkSession, self.rate, 2 * (lags - 1))

    def correlations(self) -> DataFrame:
        """method, is_last, setup, channel, ref, lag, tau, r of all methods used so far."""
        if self.last is None:
            raise ValueError("nothing was estimated yet")
        parts = [
            self._correlation(m, lags).select(F.lit(m).alias("method"), F.lit(m == self.last).alias("is_last"), "setup", "channel", "ref", "lag", (F.col("lag") / self.rate).alias("tau"), "r")
            for m, lags in self._lags.items()
        ]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
