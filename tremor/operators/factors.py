"""Triangular factors of block Hankel matrices of signals: leaves, merges, all blocks but one, projections.

A Hankel matrix (past references above all future channels, one column per start sample) is never built as a whole.  Every
chunk of samples gives the triangular factor of its own columns; factors of several chunks are merged by factoring them
once more.  Diagonals are not negative, so a factor does not depend on how its columns were cut, but for rounding.  A factor
table holds keys, cols (columns of the matrix), channels (references first), nr (references), width and r (bytes)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.scratch import written

FACTOR = "cols long, channels array<int>, nr int, width int, r binary"
#: Factors that meet in one task.
FAN = 16


def triangular(columns: np.ndarray) -> np.ndarray:
    """Upper triangular factor of ``columns`` (one row per column of the Hankel matrix) with a diagonal of at least 0."""
    r = np.linalg.qr(columns, mode="r")
    return r * np.where(np.diag(r[:, : len(r)]) < 0, -1.0, 1.0)[:, None]


def hankel_columns(y: np.ndarray, nr: int, rows: int) -> np.ndarray:
    """(start samples, past and future values) of signals (samples, channels with the references first)."""
    n = len(y) - 2 * rows
    return np.hstack([*(y[i : i + n, :nr] for i in range(rows)), *(y[rows + i : rows + i + n] for i in range(rows + 1))])


def block_factors(signals: DataFrame, refs: Sequence[int], rows: int, length: int, chunk: int = 8192) -> DataFrame:
    """setup, block, part and the factor of every chunk of every block of ``length`` start samples; the last block may be shorter.

    Columns belong to the block of their first sample and reach 2 * rows samples further."""
    halo = 2 * rows
    chunk = min(chunk, length)
    parts = -(-length // chunk)
    own = F.floor(F.col("n") / length) * parts + F.floor((F.col("n") % length) / chunk)  # chunks of all blocks in one row
    first = F.greatest(F.col("n") - halo, F.lit(0))
    homes = F.sequence((F.floor(first / length) * parts + F.floor((first % length) / chunk)).cast("int"), own.cast("int"))
    spread = signals.withColumn("home", F.explode(homes))

    def factor(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        setup, home = key
        block, part = divmod(int(home), parts)
        wide = pdf.pivot_table(index="n", columns="channel", values="y").sort_index()
        channels = [*refs, *(int(c) for c in wide.columns if c not in refs)]
        begin = block * length + part * chunk
        stop = min(begin + chunk, (block + 1) * length)
        n = wide.index.to_numpy()
        y = wide[channels].to_numpy()[(n >= begin) & (n < stop + halo)]
        if len(y) <= halo:
            return pd.DataFrame(columns=["setup", "block", "part", "cols", "channels", "nr", "width", "r"])
        r = triangular(hankel_columns(y, len(refs), rows))
        return pd.DataFrame({"setup": [setup], "block": [block], "part": [part], "cols": [len(y) - halo], "channels": [channels], "nr": [len(refs)], "width": [r.shape[1]], "r": [r.tobytes()]})

    return spread.groupBy("setup", "home").applyInPandas(factor, f"setup string, block int, part int, {FACTOR}")


def unpacked(row) -> np.ndarray:
    """The square factor of a row of a factor table."""
    r = np.frombuffer(row.r).reshape(-1, row.width)
    return r if len(r) == row.width else np.vstack([r, np.zeros((row.width - len(r), row.width))])


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return triangular(np.vstack([np.frombuffer(x).reshape(-1, w) for x, w in zip(pdf["r"], pdf["width"])]))


def _together(factors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One factor per ``keys``; the caller bounds how many meet."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, r = pdf.iloc[0], _stacked(pdf)
        named = {n: [v] for n, v in zip(keys, key)}
        return pd.DataFrame(named | {"cols": [int(pdf["cols"].sum())], "channels": [list(row["channels"])], "nr": [int(row["nr"])], "width": [int(row["width"])], "r": [r.tobytes()]})

    kinds = dict(factors.dtypes)
    return factors.groupBy(*keys).applyInPandas(merge, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {FACTOR}")


def merged(factors: DataFrame, keys: Sequence[str], place: str, fan: int = FAN) -> DataFrame:
    """One factor per ``keys``, merged along ``place`` (whole numbers from 0) in rounds of ``fan``."""
    most = factors.agg(F.max(place)).first()[0] or 0
    found = factors
    while most > 0:
        found = _together(found.withColumn(place, F.floor(F.col(place) / fan).cast("int")), [*keys, place])
        most //= fan
    return found.select(*keys, *(c.split()[0] for c in FACTOR.split(", ")))


def leave_one_out(factors: DataFrame, place: str = "block") -> DataFrame:
    """setup, ``place`` and the factor of all other places of the setup; ``factors`` holds one factor for each.

    Factors are merged two by two up to a root.  All places but one are the siblings on the way from it to the root, so a task merges
    as many factors as the tree has levels and none of the places is taken out by subtraction."""
    level = written(factors.select("setup", F.col(place).cast("int").alias("at"), "cols", "channels", "nr", "width", "r"), "factors")
    most = level.agg(F.max("at")).first()[0] or 0
    leaves = level.select("setup", F.col("at").alias("leaf"))
    met, depth = None, 0
    while most > 0:
        wanted = leaves.withColumn("at", F.shiftright("leaf", depth).bitwiseXOR(F.lit(1)))
        part = wanted.join(level, ["setup", "at"])
        met = part if met is None else met.unionByName(part)
        level = written(_together(level.withColumn("at", F.shiftright("at", 1)), ["setup", "at"]), "factors")
        most, depth = most >> 1, depth + 1
    if met is None:
        raise ValueError("one block leaves none to learn from")
    return _together(met.drop("at"), ["setup", "leaf"]).withColumnRenamed("leaf", place)


def split(r: np.ndarray, rows: int, nr: int) -> tuple[np.ndarray, np.ndarray]:
    """(L11, L21) of a factor: past onto itself, future onto the past."""
    low, a = r.T, rows * nr
    return low[:a, :a], low[a:, :a]


def projections(leaves: DataFrame, whole: DataFrame, rows: int) -> DataFrame:
    """setup, block, channels, nr, size, h: what each block adds to the projection of the future onto the past, times the number of blocks.

    With the past's factor L11 of all blocks, a block's rotation is L11^-1 R11, so its part of L21 is R21 R11' L11^-T; the parts sum up to L21."""
    both = leaves.join(whole.select("setup", F.col("r").alias("all"), "blocks"), "setup")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                full = np.frombuffer(row.all).reshape(-1, row.width)
                l11, _ = split(np.vstack([full, np.zeros((row.width - len(full), row.width))]), rows, row.nr)
                r11, r21 = split(unpacked(row), rows, row.nr)
                h = np.linalg.lstsq(l11, r11 @ r21.T, rcond=None)[0].T * row.blocks
                yield pd.DataFrame({"setup": [row.setup], "block": [row.block], "channels": [list(row.channels)], "nr": [row.nr], "size": [list(h.shape)], "h": [np.ascontiguousarray(h).tobytes()]})

    return both.mapInPandas(run, "setup string, block int, channels array<int>, nr int, size array<int>, h binary")
