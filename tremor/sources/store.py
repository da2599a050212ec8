"""Stored results, loaders of measurement files, and analytic signals.

Results of a setup are tables; a state is a folder with one Parquet table each, which names its setup."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources import setup_files

Loader = Callable[[SparkSession, str, str], DataFrame]


def _parquet(spark: SparkSession, path: str, setup: str) -> DataFrame:
    return spark.read.parquet(path).select(F.lit(setup).alias("setup"), "n", "channel", "y")


#: Loaders by file ending: (spark, path, setup) -> setup, n, channel, y.
LOADERS: dict[str, Loader] = {
    "npy": lambda spark, path, setup: setup_files.numpy_matrix(spark, path, setup),
    "txt": lambda spark, path, setup: setup_files.text_matrix(spark, path, setup),
    "asc": lambda spark, path, setup: setup_files.text_matrix(spark, path, setup),
    "parquet": _parquet,
}


def register_loader(ending: str, loader: Loader) -> None:
    LOADERS[ending.lower().lstrip(".")] = loader


def load_measurement(spark: SparkSession, path: str, setup: str = "") -> DataFrame:
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending not in LOADERS:
        raise ValueError(f"no loader for {ending!r}; register_loader adds one")
    return LOADERS[ending](spark, path, setup)


def load_geometry(spark: SparkSession, nodes: str, lines: str | None = None, parent_childs: str | None = None) -> dict[str, DataFrame]:
    """Tables nodes, lines and parent_childs; lines and links are empty where no file is given."""
    empty = {"lines": "start string, stop string", "parent_childs": "parent string, px double, py double, pz double, child string, cx double, cy double, cz double"}
    of = {"lines": (lines, setup_files.lines), "parent_childs": (parent_childs, setup_files.parent_childs)}
    rest = {k: read(spark, path) if path else spark.createDataFrame([], empty[k]) for k, (path, read) in of.items()}
    return {"nodes": setup_files.nodes(spark, nodes), **rest}


def save_state(path: str, setup: str, **tables: DataFrame) -> None:
    """One Parquet table each under ``path``, and the setup's name."""
    spark = next((df.sparkSession for df in tables.values()), None) or SparkSession.active()
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(setup, sorted(tables))], "setup string, tables array<string>").write.mode("overwrite").json(f"{path}/_setup.json")


def load_state(spark: SparkSession, path: str, setup: str | None = None) -> dict[str, DataFrame]:
    """The tables of a state; another setup's state is refused."""
    told = spark.read.schema("setup string, tables array<string>").json(f"{path}/_setup.json").first()
    if setup is not None and told["setup"] != setup:
        raise ValueError(f"this state is of setup {told['setup']!r}, not of {setup!r}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in told["tables"]}


def export_modes(modes: DataFrame, path: str) -> None:
    """Selected or merged modes as one JSON line each, and the same as a text table."""
    modes.write.mode("overwrite").json(f"{path}/json")
    columns = [c for c, kind in modes.dtypes if kind in ("double", "float")]
    keys = [c for c, kind in modes.dtypes if kind in ("int", "bigint", "string")]
    text = F.concat_ws("\t", *[F.col(c).cast("string") for c in keys], *[F.format_string("%.6f", F.col(c)) for c in columns])
    modes.select(text.alias("value")).write.mode("overwrite").text(f"{path}/text")


def methods() -> Mapping[str, Callable]:
    """Identification methods by name."""
    from tremor.operators import identify

    return {
        "ssi-cov": identify.ssi_cov_poles, "ssi-data": identify.ssi_data_poles, "era": identify.era_poles,
        "prce": identify.prce_poles, "plscf": identify.plscf_poles,
    }


def ambient_response(spark: SparkSession, frequencies: list[float], damping: list[float], shapes: list[list[float]], rate: float, samples: int, seed: int = 0, setup: str = "synthetic", block: int = 1 << 16) -> DataFrame:
    """setup, n, channel, y: modal oscillators under white noise.

    Every block starts anew from a warm-up of ten decay times, so blocks are independent tasks; its noise follows from the seed and its number."""
    w = 2 * np.pi * np.array(frequencies) / rate
    lam = np.exp(-np.array(damping) * w + 1j * w * np.sqrt(1 - np.array(damping) ** 2))
    warm = int(np.ceil(10 / min(np.array(damping) * w)))

    def run(batches):
        for pdf in batches:
            for b in pdf["id"].tolist():
                size = min(block, samples - b * block)
                noise = np.random.default_rng([seed, b]).normal(size=(size + warm, len(lam)))
                from tremor.operators.kalman import states

                y = states(np.diag(lam), noise.astype(complex), np.zeros(len(lam), complex))[warm + 1 :].real @ np.array(shapes)
                n, c = np.indices(y.shape)
                yield pd.DataFrame({"n": (n.ravel() + b * block).astype("int32"), "channel": c.ravel().astype("int32"), "y": y.ravel()})

    rows = spark.range(-(-samples // block)).mapInPandas(run, "n int, channel int, y double")
    return rows.select(F.lit(setup).alias("setup"), "n", "channel", "y")


def oscillator_frf(spark: SparkSession, frequency: float, damping: float, rate: float, lines: int) -> DataFrame:
    """k, freq, re, im of the receptance of one oscillator of unit mass; damping as a ratio."""
    w, w0 = 2 * np.pi * F.col("freq"), 2 * np.pi * frequency
    a, b = F.lit(w0**2) - w * w, 2 * damping * w0 * w
    size = a * a + b * b
    axis = spark.range(lines // 2 + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") * rate / lines).alias("freq"))
    return axis.select("k", "freq", (a / size).alias("re"), (-b / size).alias("im"))
