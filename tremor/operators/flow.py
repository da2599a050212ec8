"""From a setup file and a method file to selected modes in one call."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

from tremor.operators import channels, identify, spectral, stabil
from tremor.scratch import written
from tremor.sources import setup_files
from tremor.sources.setup_files import Setup

#: What the lines of each method's file mean, in their order.
OPTIONS = {
    "ssi-cov": ["block_columns", "max_order"], "ssi-data": ["block_columns", "max_order"], "era": ["block_columns", "max_order"],
    "prce": ["corr_samples", "max_order"], "plscf": ["f_begin", "f_end", "lines", "max_order"],
}


def method_file(spark: SparkSession, path: str, method: str) -> dict[str, str]:
    """Options of a method by name, from a file of key and value lines."""
    return setup_files.options(spark, path, OPTIONS[method])


def identified(signals: DataFrame, refs: list[int], rate: float, samples: int, method: str, options: Mapping[str, str], step: int = 2) -> DataFrame:
    """Poles of all orders up to the file's, ``step`` apart, by the named method; correlations are estimated as the method needs them."""
    if method not in OPTIONS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(OPTIONS)}")
    missing = [n for n in OPTIONS[method] if n not in options]
    if missing:
        raise ValueError(f"the method file lacks {', '.join(missing)}")
    number = lambda name: int(float(options[name]))
    orders = range(step, number("max_order") + 1, step)
    if method == "ssi-data":
        return identify.ssi_data_poles(signals, refs, rate, number("block_columns"), orders)
    lags = {"prce": lambda: number("corr_samples"), "plscf": lambda: number("lines")}.get(method, lambda: 2 * number("block_columns") + 2)()
    corr = written(spectral.corr_bt_chunked(signals, refs, lags, samples), "correlations")
    if method == "prce":
        return identify.prce_poles(corr, rate, orders)
    if method == "plscf":
        return identify.plscf_poles(corr, rate, orders, band=(float(options["f_begin"]), float(options["f_end"])))
    return {"ssi-cov": identify.ssi_cov_poles, "era": identify.era_poles}[method](corr, rate, number("block_columns"), orders)


def single_setup(
    signals: DataFrame, info: Setup, samples: int, method: str, options: Mapping[str, str], dofs: DataFrame | None = None, number: int = 0,
    rescale: Callable[[Column, Column], tuple[Column, Column]] | None = None, extra: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channel table, poles, modal values of the selected modes): channels are prepared by the setup file, poles identified by the method file, cleared,
    clustered and selected (``number`` clusters, or those of the larger side of a 2-means split of their sizes).  ``rescale`` and ``extra``: see ``identify.rescaled`` and ``stabil.modal_values``."""
    moved, table = channels.prepared(signals, info, dofs)
    refs = sorted(r[0] for r in table.where("is_ref").select("channel").collect())  # channels of one setup
    found = identified(moved, refs, info.rate, samples, method, options)
    poles = written(identify.rescaled(found, rescale) if rescale else found, "poles")
    chosen = stabil.representatives(stabil.clusters(poles, stabil.clearing(poles)), number)
    return table, poles, stabil.modal_values(poles, chosen.select("setup", "ord", "idx"), extra)
