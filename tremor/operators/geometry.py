"""Geometry of a structure: nodes, lines, dependent nodes, displacements and animation frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.modal import direction


def without_nodes(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines that touch none of the removed nodes."""
    one, two = gone.select(F.col("node").alias("start")), gone.select(F.col("node").alias("stop"))
    return lines.join(one, "start", "left_anti").join(two, "stop", "left_anti").select("start", "stop")


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[g(c).alias(f"{c}_{n}") for c in "xyz" for g, n in ((F.min, "min"), (F.max, "max"))])


def displacements(dofs: DataFrame, shapes: DataFrame) -> DataFrame:
    """mode, node, axis, re, im; ``dofs``: channel, node, azimuth, elevation; ``shapes``: mode, channel, re, im.

    One sensor moves its node along its direction; several are solved by least squares of least norm."""
    x, y, z = direction(F.col("azimuth"), F.col("elevation"))
    rows = dofs.where(F.col("node").isNotNull()).select("channel", "node", x.alias("x"), y.alias("y"), z.alias("z")).join(shapes, "channel")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        move = np.linalg.lstsq(pdf[["x", "y", "z"]].to_numpy(), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy(), rcond=1e-9)[0]
        return pd.DataFrame({"mode": pdf["mode"].iloc[0], "node": pdf["node"].iloc[0], "axis": ["x", "y", "z"], "re": move.real, "im": move.imag})

    return rows.groupBy("mode", "node").applyInPandas(solve, "mode int, node string, axis string, re double, im double")


def dependent(moves: DataFrame, links: DataFrame) -> DataFrame:
    """mode, node, axis, re, im of dependent nodes: the weighted complex displacement of their parents."""
    weights = F.expr("stack(3, 'x', px, cx, 'y', py, cy, 'z', pz, cz) AS (axis, take, give)")
    takes = links.select(F.col("parent").alias("node"), "child", weights)
    along = takes.join(moves, ["node", "axis"]).groupBy("mode", "child", "node").agg(F.sum(F.col("take") * F.col("re")).alias("re"), F.sum(F.col("take") * F.col("im")).alias("im"))
    gives = links.select(F.col("parent").alias("node"), "child", weights).where("give <> 0")
    return along.join(gives, ["node", "child"]).groupBy("mode", F.col("child").alias("node2"), "axis").agg(F.sum(F.col("give") * F.col("re")).alias("re"), F.sum(F.col("give") * F.col("im")).alias("im")).withColumnRenamed("node2", "node")


def with_dependent(moves: DataFrame, links: DataFrame) -> DataFrame:
    """``moves`` and the displacements of dependent nodes; a dependent node may lead others, level by level.

    A node follows once all its parents are known, so the order of the links does not matter; nodes of a cycle stay without."""
    parents: dict[str, set] = {}
    for parent, child in links.select("parent", "child").distinct().collect():  # the links of one structure
        parents.setdefault(child, set()).add(parent)
    known = moves
    while level := [c for c, of in parents.items() if not of & parents.keys()]:
        known = known.unionByName(dependent(known, links.where(F.col("child").isin(*level))).select(*known.columns))
        parents = {c: of for c, of in parents.items() if c not in level}
    return known


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes with new ones; one that is there already gets the new coordinates."""
    return nodes.join(new.select("node"), "node", "left_anti").unionByName(new.select(*nodes.columns))


def add_lines(lines: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lines with those new ones whose two nodes are there; in either direction each stays once."""
    known = nodes.select(F.col("node").alias("start"))
    sound = new.join(known, "start", "left_semi").join(known.select(F.col("start").alias("stop")), "stop", "left_semi")
    every = lines.select("start", "stop").unionByName(sound.select("start", "stop"))
    best = every.groupBy(F.least("start", "stop").alias("x"), F.greatest("start", "stop").alias("y")).agg(F.min(F.struct("start", "stop")).alias("l"))
    return best.select("l.start", "l.stop")


def without_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Dependencies that touch none of the removed nodes."""
    return links.join(gone.select(F.col("node").alias("parent")), "parent", "left_anti").join(gone.select(F.col("node").alias("child")), "child", "left_anti").select(*links.columns)


def without_dofs(dofs: DataFrame, gone: DataFrame) -> DataFrame:
    """Directions with those of removed nodes set free: the channel stays, its node is null."""
    marked = dofs.join(F.broadcast(gone.select("node", F.lit(True).alias("_gone"))), "node", "left")
    return marked.withColumn("node", F.when(F.col("_gone").isNull(), F.col("node"))).select(*dofs.columns)


def rescaled(nodes: DataFrame, factor: float) -> DataFrame:
    return nodes.withColumns({c: F.col(c) * factor for c in "xyz"})


def shown(moves: DataFrame, real: bool = False) -> DataFrame:
    """mode, node, axis, size, phase: magnitude and phase; for a real display the real part and phase 0 or pi."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    if real:
        return moves.select("mode", "node", "axis", F.abs("re").alias("size"), F.when(F.col("re") < 0, F.lit(math.pi)).otherwise(F.lit(0.0)).alias("phase"))
    return moves.select("mode", "node", "axis", size.alias("size"), F.atan2("im", "re").alias("phase"))


def measured_frames(nodes: DataFrame, dofs: DataFrame, signals: DataFrame, amplitude: float = 1.0) -> DataFrame:
    """n, node, axis, at: positions under the measured signals; ``dofs``: channel, node, azimuth, elevation."""
    x, y, z = direction(F.col("azimuth"), F.col("elevation"))
    parts = dofs.where(F.col("node").isNotNull()).select("channel", "node", x.alias("dx"), y.alias("dy"), z.alias("dz"))
    along = parts.select("channel", "node", F.expr("stack(3, 'x', dx, 'y', dy, 'z', dz) AS (axis, part)"))
    moved = signals.join(F.broadcast(along), "channel").groupBy("n", "node", "axis").agg(F.sum(F.col("y") * F.col("part")).alias("move"))
    rest = nodes.select("node", F.expr("stack(3, 'x', x, 'y', y, 'z', z) AS (axis, rest)"))
    return moved.join(F.broadcast(rest), ["node", "axis"]).select("n", "node", "axis", (F.col("rest") + amplitude * F.col("move")).alias("at"))


def frames(nodes: DataFrame, moves: DataFrame, count: int = 25, amplitude: float = 1.0) -> DataFrame:
    """mode, node, axis, frame, at: positions over one period."""
    rest = nodes.select("node", F.expr("stack(3, 'x', x, 'y', y, 'z', z) AS (axis, rest)"))
    step = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("frame")
    wave = rest.join(moves, ["node", "axis"]).select("mode", "node", "axis", "rest", "re", "im", step)
    size, phase = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), F.atan2("im", "re")
    return wave.select("mode", "node", "axis", "frame", (F.col("rest") + amplitude * size * F.cos(F.lit(2 * math.pi) * F.col("frame") / count + phase)).alias("at"))
