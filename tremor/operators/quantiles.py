"""Exact quantiles of many groups at once, without a list of values in any task.

Every wanted rank has an interval of values that holds it.  A round counts the interval's values in equal bins, for all groups and ranks in one
aggregation, and goes on with the values between the least and the largest of the bin that holds the rank.  It ends when these are equal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.scratch import written

BINS = 4096


def _bin(v: Column, low: Column, high: Column) -> Column:
    """Halves keep the width of the widest interval finite."""
    return F.least(F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * BINS), F.lit(BINS - 1))


def quantiles(rows: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """keys, q0, q1, ..: the value at each share of a group's values, interpolated between its two neighbours; nulls do not count."""
    values = rows.where(F.col(column).isNotNull()).select(*keys, (F.col(column).cast("double") + 0.0).alias("__v"))
    bounds = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    places = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.explode(F.array_distinct(F.array(*(g(p) for p in places for g in (F.floor, F.ceil))))).alias("rank")
    open_ = written(bounds.select(*keys, ranks, F.lit(0).cast("long").alias("below"), "low", "high"), "ranks")
    groups, found = written(bounds.select(*keys, "n"), "groups"), None
    known = [*keys, "rank"]
    while True:
        done = open_.where("low = high").select(*known, F.col("low").alias("value"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        inside = values.join(open_, list(keys)).where("__v BETWEEN low AND high")
        counts = inside.groupBy(*known, "below", _bin(F.col("__v"), F.col("low"), F.col("high")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*known).orderBy("bin"))  # at most BINS rows a rank
        hit = counts.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        open_ = written(hit.select(*known, (F.col("upto") - F.col("c")).alias("below"), "low", "high"), "ranks")
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # two ranks a share

    def between(p: Column) -> Column:
        low, high = F.element_at("at", F.floor(p)), F.element_at("at", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return groups.join(by_rank, list(keys)).select(*keys, *(between(p).alias(f"q{i}") for i, p in enumerate(places)))
