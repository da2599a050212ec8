"""Fourier transforms that are longer than a task, and what measured forces do to measured responses.

With n = n1 * columns + n2 and k = k1 + rows * k2 a transform of rows * columns samples is one of all columns (over n1), a turn by n2 k1,
and one of all rows (over n2): two shuffles, and every group is a column or a row.  A length without a divisor near its root has long rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators import identify


def shape_of(length: int) -> tuple[int, int]:
    """(rows, columns) with rows * columns = length, as near to a square as its divisors allow."""
    rows = next(r for r in range(int(np.sqrt(length)), 0, -1) if length % r == 0)
    return rows, length // rows


def transform(samples: DataFrame, keys: Sequence[str], length: int, inverse: bool = False) -> DataFrame:
    """keys, k, re, im: discrete Fourier transform of samples (keys, n, re, im) numbered from 0; missing samples are 0."""
    rows, columns = shape_of(length)
    kinds = dict(samples.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    sign = 1 if inverse else -1

    def one(values: list, size: int) -> np.ndarray:
        x = np.zeros(size, complex)
        for v in values:
            x[v["at"]] = complex(v["re"], v["im"])
        return np.fft.ifft(x) if inverse else np.fft.fft(x)

    def column(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = one(row.values, rows) * np.exp(sign * 2j * np.pi * ((row.line * np.arange(rows)) % length) / length)
                yield pd.DataFrame({k: [getattr(row, k)] * rows for k in keys} | {"at": row.line, "line": np.arange(rows), "re": x.real, "im": x.imag})

    def row_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = one(row.values, columns)
                yield pd.DataFrame({k: [getattr(row, k)] * columns for k in keys} | {"k": row.line + rows * np.arange(columns), "re": x.real, "im": x.imag})

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "line").agg(F.collect_list(F.struct("at", "re", "im")).alias("values"))

    dealt = samples.where((F.col("n") >= 0) & (F.col("n") < length)).select(*keys, (F.col("n") % columns).cast("int").alias("line"), F.floor(F.col("n") / columns).cast("int").alias("at"), "re", "im")
    turned = grouped(dealt).mapInPandas(column, f"{head}, at int, line int, re double, im double")
    return grouped(turned).mapInPandas(row_, f"{head}, k int, re double, im double")


def _windowed(y: Column, length: int) -> Column:
    return y * (0.54 - 0.46 * F.cos(F.lit(2 * np.pi) * F.col("n") / (length - 1)))


def response_lines(signals: DataFrame, force: DataFrame, length: int) -> DataFrame:
    """setup, channel, k, re, im of all ``length`` lines: response over force, both under a symmetric Hamming window; null where the force has nothing.

    ``force``: setup, n, f."""
    used = F.col("n") < length
    y = transform(signals.where(used).select("setup", "channel", "n", _windowed(F.col("y"), length).alias("re"), F.lit(0.0).alias("im")), ["setup", "channel"], length)
    f = transform(force.where(used).select("setup", "n", _windowed(F.col("f"), length).alias("re"), F.lit(0.0).alias("im")), ["setup"], length)
    f = f.select("setup", "k", F.col("re").alias("c"), F.col("im").alias("d"), F.nullif(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.lit(0.0)).alias("power"))
    re, im = F.col("re") * F.col("c") + F.col("im") * F.col("d"), F.col("im") * F.col("c") - F.col("re") * F.col("d")
    return y.join(f, ["setup", "k"]).select("setup", "channel", "k", (re / F.col("power")).alias("re"), (im / F.col("power")).alias("im"))


def impulse_responses(lines: DataFrame, length: int) -> DataFrame:
    """setup, channel, n, y: inverse transform of all lines."""
    back = transform(lines.select("setup", "channel", F.col("k").alias("n"), "re", "im"), ["setup", "channel"], length, inverse=True)
    return back.select("setup", "channel", F.col("k").alias("n"), F.col("re").alias("y"))


def random_phases(lines: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """setup, n, channel, y: ``length`` samples whose transform has the lines 0 .. length / 2 of ``lines`` (setup, channel, k, re, im), turned by random phases.

    All channels of a setup are turned alike, so lines that are frequency responses give the response to one force of equal strength at every line, and the lines of a
    record give another record with the same spectra and cross spectra.  Phases follow from setup, line and seed; line 0 and that of half the rate stay as they are.
    Missing lines are 0, lines outside are left out."""
    whole = (F.col("k") == 0) | (2 * F.col("k") == length)
    turn = F.when(whole, 0.0).otherwise(F.xxhash64("setup", F.col("k").cast("long"), F.lit(seed).cast("long")) / F.lit(float(1 << 63)) * np.pi)
    used = lines.where((F.col("k") >= 0) & (2 * F.col("k") <= length)).select("setup", "channel", "k", "re", "im", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    re, im = F.col("re") * F.col("c") - F.col("im") * F.col("s"), F.col("re") * F.col("s") + F.col("im") * F.col("c")
    half = used.select("setup", "channel", F.col("k").alias("n"), re.alias("re"), F.when(whole, 0.0).otherwise(im).alias("im"))
    mirrored = half.where((F.col("n") > 0) & (2 * F.col("n") < length)).select("setup", "channel", (length - F.col("n")).cast("int").alias("n"), "re", (-F.col("im")).alias("im"))
    back = transform(half.withColumn("n", F.col("n").cast("int")).unionByName(mirrored), ["setup", "channel"], length, inverse=True)
    return back.select("setup", F.col("k").alias("n"), "channel", F.col("re").alias("y"))


def era_poles(signals: DataFrame, force: DataFrame, length: int, rate: float, cols: int, orders: range) -> DataFrame:
    """Eigensystem realisation on the impulse responses of a measured force."""
    found = impulse_responses(response_lines(signals, force, length), length).where(F.col("n") <= 2 * cols + 1)
    return identify.era_poles(found.select("setup", "channel", F.lit(0).alias("ref"), F.col("n").alias("lag"), F.col("y").alias("r")), rate, cols, orders)
