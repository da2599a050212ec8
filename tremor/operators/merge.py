"""Merging of setups: common directions, mode pairing and scaling by reference components."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.modal import dot, mac
from tremor.scratch import written

DIRECTION = ("node", "azimuth", "elevation")


def common_dofs(dofs: DataFrame) -> DataFrame:
    """Directions that every setup measures; ``dofs``: setup, channel, node, azimuth, elevation."""
    setups = dofs.select("setup").distinct().count()
    return dofs.groupBy(*DIRECTION).agg(F.countDistinct("setup").alias("n")).where(F.col("n") == setups).select(*DIRECTION)


def rovings(dofs: DataFrame) -> DataFrame:
    """Channels whose direction is not common to all setups."""
    return dofs.join(common_dofs(dofs), list(DIRECTION), "left_anti")


def pair_candidates(a: DataFrame, b: DataFrame, df_max: float = 0.2, mac_min: float = 0.8) -> DataFrame:
    """mode_a, mode_b, d_f, mac of modes close in frequency and shape; both sides: mode, f, phi_re, phi_im.

    Frequencies are dealt to logarithmic bins as wide as the limit, so only neighbouring bins meet."""
    width = F.log(F.lit(1 / (1 - df_max)))
    place = lambda f: F.floor(F.log(f) / width)
    left = a.select(F.col("mode").alias("mode_a"), F.col("f").alias("fa"), F.col("phi_re").alias("ar"), F.col("phi_im").alias("ai"), F.explode(F.array(place(F.col("f")) - 1, place(F.col("f")), place(F.col("f")) + 1)).alias("bin"))
    right = b.select(F.col("mode").alias("mode_b"), F.col("f").alias("fb"), F.col("phi_re").alias("br"), F.col("phi_im").alias("bi"), place(F.col("f")).alias("bin"))
    near = F.abs(F.col("fa") - F.col("fb")) / F.greatest("fa", "fb")
    same = mac(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi"))
    return left.join(right, "bin").select("mode_a", "mode_b", near.alias("d_f"), same.alias("mac")).where((F.col("d_f") < df_max) & (F.col("mac") > mac_min))


def all_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """mode_a, mode_b, d_f, mac of every two modes, with the difference over the frequency of a; for pairing without limits."""
    left = a.select(F.col("mode").alias("mode_a"), F.col("f").alias("fa"), F.col("phi_re").alias("ar"), F.col("phi_im").alias("ai"))
    right = F.broadcast(b.select(F.col("mode").alias("mode_b"), F.col("f").alias("fb"), F.col("phi_re").alias("br"), F.col("phi_im").alias("bi")))  # selected modes of one setup
    return left.crossJoin(right).select("mode_a", "mode_b", (F.abs(F.col("fb") - F.col("fa")) / F.col("fa")).alias("d_f"), mac(F.col("ar"), F.col("ai"), F.col("br"), F.col("bi")).alias("mac"))


def pairs(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs: the nearest two modes first, then the nearest of the others, ties to the larger MAC.

    ``by``: columns that name the two setups.  Going through the candidates in order of distance takes exactly those that come first
    among all free candidates of both their modes, whatever is taken elsewhere.  So every round takes all such pairs at once, by two
    window ranks, and drops the candidates of their modes, until none is left; no group holds more than the candidates of one mode."""
    nearest = [F.col("d_f"), F.col("mac").desc(), F.col("mode_a"), F.col("mode_b")]
    sides = [[*by, side] for side in ("mode_a", "mode_b")]
    rest, taken = written(candidates, "candidates"), None
    while not rest.isEmpty():
        ranked = rest
        for i, side in enumerate(sides):
            ranked = ranked.withColumn(f"__{i}", F.row_number().over(Window.partitionBy(*side).orderBy(*nearest)))
        best = written(ranked.where("__0 = 1 AND __1 = 1").drop("__0", "__1"), "pairs")
        taken = best if taken is None else taken.unionByName(best)
        for side in sides:
            rest = rest.join(best.select(*side), side, "left_anti")
        rest = written(rest.select(*candidates.columns), "candidates")
    return rest if taken is None else taken


def common_modes(found: DataFrame, setups: int) -> DataFrame:
    """The pairs (setup, mode_a, mode_b) whose base mode mode_a has a partner in all of so many other setups."""
    whole = found.groupBy("mode_a").agg(F.countDistinct("setup").alias("n")).where(F.col("n") == setups).select("mode_a")
    return found.join(whole, "mode_a", "left_semi")


def unpaired(modes: DataFrame, found: DataFrame, side: str) -> DataFrame:
    """Modes of side 'a' or 'b' without a partner."""
    return modes.join(found.select(F.col(f"mode_{side}").alias("mode")), "mode", "left_anti")


def pair_statistics(a: DataFrame, b: DataFrame, found: DataFrame) -> DataFrame:
    """n, mean and population deviation of the differences of f and d, mean and least MAC, and unmatched modes of both sides."""
    left, right = a.select(F.col("mode").alias("mode_a"), F.col("f").alias("fa"), F.col("d").alias("da")), b.select(F.col("mode").alias("mode_b"), F.col("f").alias("fb"), F.col("d").alias("db"))
    told = found.join(left, "mode_a").join(right, "mode_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("fa") - F.col("fb")).alias("mean_df"), F.stddev_pop(F.col("fa") - F.col("fb")).alias("std_df"),
        F.avg(F.col("da") - F.col("db")).alias("mean_dd"), F.stddev_pop(F.col("da") - F.col("db")).alias("std_dd"), F.avg("mac").alias("mean_mac"), F.min("mac").alias("min_mac"),
    )
    left_over = [unpaired(x, found, s).agg(F.count(F.lit(1)).alias(f"unmatched_{s}")) for x, s in ((a, "a"), (b, "b"))]
    return told.crossJoin(F.broadcast(left_over[0])).crossJoin(F.broadcast(left_over[1]))  # one row each


def setup_problems(dofs: DataFrame, modes: DataFrame) -> DataFrame:
    """setup, problem: what keeps a setup from being merged; ``modes``: setup, mode.  Setups need directions and selected modes."""
    have_dofs, have_modes = dofs.where(F.col("node").isNotNull()).select("setup").distinct(), modes.select("setup").distinct()
    none = have_modes.join(have_dofs, "setup", "left_anti").withColumn("problem", F.lit("no directions"))
    return none.unionByName(have_dofs.join(have_modes, "setup", "left_anti").withColumn("problem", F.lit("no selected modes")))


def shape_scale(ref_re: str, ref_im: str, base_re: str, base_im: str) -> tuple:
    """(re, im) of the factor that fits reference components to the base setup's by least squares."""
    a, b, c, d = (F.col(k) for k in (ref_re, ref_im, base_re, base_im))
    power = dot(a, a) + dot(b, b)
    return (dot(a, c) + dot(b, d)) / power, (dot(a, d) - dot(b, c)) / power


def merged_shapes(shapes: DataFrame, base: str) -> DataFrame:
    """mode, node, azimuth, elevation, re, im: shapes of all setups on the scale of ``base``.

    ``shapes``: setup, mode, node, azimuth, elevation, re, im.  Each setup's shape is scaled so that its components
    in the directions common to all setups fit those of the base; then the base's components and the other
    setups' roving ones stand side by side, divided by the largest."""
    common = common_dofs(shapes)
    ref = shapes.join(common, list(DIRECTION))
    of_base = ref.where(F.col("setup") == base).select("mode", *DIRECTION, F.col("re").alias("c"), F.col("im").alias("d"))
    power = F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    scale = ref.join(of_base, ["mode", *DIRECTION]).groupBy("setup", "mode").agg(
        (F.sum(F.col("re") * F.col("c") + F.col("im") * F.col("d")) / power).alias("x"), (F.sum(F.col("re") * F.col("d") - F.col("im") * F.col("c")) / power).alias("y")
    )
    rows = shapes.where(F.col("setup") == base).unionByName(shapes.where(F.col("setup") != base).join(common, list(DIRECTION), "left_anti").select(*shapes.columns))
    moved = rows.join(scale, ["setup", "mode"]).select("mode", *DIRECTION, (F.col("re") * F.col("x") - F.col("im") * F.col("y")).alias("re"), (F.col("re") * F.col("y") + F.col("im") * F.col("x")).alias("im"))
    most = moved.groupBy("mode").agg(F.max_by(F.struct("re", "im"), F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("top"))
    a, b, c, d = F.col("re"), F.col("im"), F.col("top.re"), F.col("top.im")
    size = c * c + d * d
    return moved.join(most, "mode").select("mode", *DIRECTION, ((a * c + b * d) / size).alias("re"), ((b * c - a * d) / size).alias("im"))


def merged_statistics(modes: DataFrame) -> DataFrame:
    """mode, mean and population deviation of f and d over the setups; ``modes``: setup, mode, f, d."""
    return modes.groupBy("mode").agg(F.avg("f").alias("mean_f"), F.stddev_pop("f").alias("std_f"), F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("std_d"))


def report(modes: pd.DataFrame) -> str:
    """Text report of selected modes with columns f, d."""
    head = f"{'mode':>6}{'frequency [Hz]':>18}{'damping [%]':>14}"
    return "\n".join([head, *(f"{i:>6}{r.f:>18.4f}{r.d:>14.4f}" for i, r in enumerate(modes.itertuples(), 1))])
