"""Spectra of segments of two days: 25 lines, and an odd last day counts."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tremor.operators import spectral

LINES = {"psd_welch": 25, "psd_welch_fft": 25, "corr_from_psd": 25, "psd_welch_variance": 25, "psd_scaling_factors": 1, "psd_decibels": 7, "power_check": 1}  # rows of a pair


@pytest.fixture(scope="module")
def panels(spark, sf_dir, tmp_path_factory):
    """The given panel of 30 days, one of 31 and one with another last day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    folders = [sf_dir]
    for factor in (3, 50):
        folders.append(str(tmp_path_factory.mktemp("panel")))
        more = events.where("ts < '2024-01-02'").selectExpr("ts + INTERVAL 30 DAYS AS ts", "event_type", f"value * {factor} AS value")
        events.unionByName(more).coalesce(1).write.parquet(f"{folders[-1]}/events.parquet")
    return folders


@pytest.mark.parametrize("name", LINES)
def test_lines_of_two_days(spark, panels, name):
    found = []
    for folder in panels:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet{'' if folder == panels[0] else '/*.parquet'}'")
        rows, want = (df[sorted(df.columns)].sort_values(sorted(df.columns)).reset_index(drop=True) for df in (entry.queries()[name](spark, folder).toPandas(), con.execute(entry.oracle_sql()[name]).df()))
        pd.testing.assert_frame_equal(rows, want, check_dtype=False, rtol=1e-9, atol=1e-9)
        assert set(rows.groupby(["channel", "ref"]).size()) == {LINES[name]}
        found.append(rows)
    assert not found[1].equals(found[2])


@pytest.mark.parametrize("fft", [False, True])
def test_shorter_last_segment(spark, fft, length=16, samples=41):
    """Zeros after the last samples; sums of all segments keep the energy, and a segment counts by its samples."""
    y = np.random.default_rng(3).normal(size=(samples, 2))
    rows = spark.createDataFrame([("a", n, c, float(y[n, c])) for n in range(samples) for c in range(2)], "setup string, n int, channel int, y double")
    own, size = [], []
    for at in range(0, samples, length):
        part = y[at : at + length]
        w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(len(part)) / len(part))
        z = np.fft.rfft((part - part.mean(axis=0)) * w[:, None], length, axis=0)
        p = z[:, :, None].conj() * z[:, None, :1] * samples / len(part) / (2 * (0.54**2 + 0.46**2 / 2))
        p[[0, -1]] /= 2
        own.append(p)
        size.append(len(part))
    mean = np.average(own, axis=0, weights=size)
    var = np.average(np.abs(own - mean) ** 2, axis=0, weights=size)
    one = spectral.psd_welch(rows, [0], length, 3, fft, last=samples % length)
    many = spectral.over_segments(spectral.psd_welch(rows, [0], length, 3, fft, by_segment=True, last=samples % length))
    for got in (one.toPandas().sort_values(["k", "channel"]), many.toPandas().sort_values(["k", "channel"])):
        assert np.allclose((got["re"] + 1j * got["im"]).to_numpy(), mean.reshape(-1))
    assert np.allclose(got["var"], var.reshape(-1))
