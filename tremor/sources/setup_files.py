"""Text sources of a measurement campaign: setup information, channel directions and geometry.

Files are small and read by Spark, so any path that Spark reaches will do."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Setup:
    name: str = ""
    rate: float = 1.0
    ref: list[int] = field(default_factory=list)
    delete: list[int] = field(default_factory=list)
    quantity: dict[str, list[int]] = field(default_factory=dict)


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r[0].rstrip("\r") for r in spark.read.text(path, wholetext=True).limit(1).selectExpr("explode(split(value, '\\n'))").collect()]


def setup_info(spark: SparkSession, path: str) -> Setup:
    """Seven label and value line pairs in fixed order; a list line may be empty."""
    lines = _lines(spark, path)
    values = [lines[i].strip() if i < len(lines) else "" for i in range(1, 14, 2)]
    ints = lambda s: [int(float(x)) for x in s.split()]
    return Setup(values[0], float(values[1]), ints(values[2]), ints(values[3]), {"accel": ints(values[4]), "velo": ints(values[5]), "disp": ints(values[6])})


def options(spark: SparkSession, path: str, names: list[str]) -> dict[str, str]:
    """Key line, value line, in fixed order, under the given names."""
    lines = _lines(spark, path)
    return {name: lines[2 * i + 1].strip() for i, name in enumerate(names) if 2 * i + 1 < len(lines)}


def _table(spark: SparkSession, path: str, fields: list[tuple[str, str]]) -> DataFrame:
    """A header line, then columns between blanks; blank lines are skipped and the first '#' line ends the table."""
    rows = []
    for line in _lines(spark, path)[1:]:
        if line.startswith("#"):
            break
        if parts := line.split():
            cast = {"int": lambda s: int(float(s)), "double": float, "string": lambda s: None if s == "None" else s}
            rows.append([cast[kind](parts[i]) if i < len(parts) else None for i, (_, kind) in enumerate(fields)])
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in fields))


def channel_dofs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, [("channel", "int"), ("node", "string"), ("azimuth", "double"), ("elevation", "double"), ("name", "string")])


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, [("node", "string"), ("x", "double"), ("y", "double"), ("z", "double")])


def lines(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, [("start", "string"), ("stop", "string")])


def parent_childs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, [("parent", "string"), ("px", "double"), ("py", "double"), ("pz", "double"), ("child", "string"), ("cx", "double"), ("cy", "double"), ("cz", "double")])


def text_matrix(spark: SparkSession, path: str, setup: str = "") -> DataFrame:
    """A matrix of numbers between blanks, rows in file order, as (setup, n, channel, y)."""
    numbered = spark.read.text(path, wholetext=True).selectExpr("posexplode(filter(split(value, '\\r?\\n'), l -> trim(l) <> '' AND NOT startswith(trim(l), '#'))) AS (n, line)")
    return numbered.select(F.lit(setup).alias("setup"), "n", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("channel", "y")).withColumn("y", F.col("y").cast("double"))


def numpy_matrix(spark: SparkSession, path: str, setup: str = "") -> DataFrame:
    """`.npy` matrices (rows are samples) as (setup, n, channel, y); each file is one task's work."""
    import io

    import numpy as np
    import pandas as pd

    def read(batches):
        for pdf in batches:
            for content in pdf["content"]:
                y = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                for i in range(0, len(y), 4096):
                    part = y[i : i + 4096]
                    n, c = np.indices(part.shape)
                    yield pd.DataFrame({"n": (n.ravel() + i).astype("int32"), "channel": c.ravel().astype("int32"), "y": part.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "n int, channel int, y double").select(F.lit(setup).alias("setup"), "n", "channel", "y")
