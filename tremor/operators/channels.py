"""Channel metadata of a setup: names, measured quantities, references, directions, time and frequency axes.

A channel table has one row per channel: setup, channel, name, quantity, n_tags, is_ref, rate, start.
It is small beside the signals; signals (setup, n, channel, y) are joined to it by setup and channel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import signals as sig
from tremor.sources.setup_files import Setup

QUANTITIES = ("accel", "velo", "disp")
AXES = "setup string, channel int, name string, quantity string, n_tags int, is_ref boolean, rate double, start timestamp"


def described(channels: DataFrame, rate: float, refs: Sequence[int] | None = None, quantity: Mapping[str, Sequence[int]] | None = None, start: str | None = None) -> DataFrame:
    """The channel table of ``channels`` (setup, channel, name).

    Without ``refs`` every channel is a reference; a channel without a tag is an acceleration, one with several has
    the first of QUANTITIES and n_tags tells."""
    tags = [(q, sorted(set((quantity or {}).get(q, ())))) for q in QUANTITIES]
    tagged = {q: F.col("channel").isin(*of) if of else F.lit(False) for q, of in tags}
    kind = F.coalesce(*[F.when(is_, F.lit(q)) for q, is_ in tagged.items()], F.lit("accel"))
    return channels.select(
        "setup", "channel", "name", kind.alias("quantity"), sum((is_.cast("int") for is_ in tagged.values()), F.lit(0)).alias("n_tags"),
        (F.lit(True) if refs is None else F.col("channel").isin(*refs)).alias("is_ref"), F.lit(float(rate)).alias("rate"), F.lit(start).cast("timestamp").alias("start"),
    )


def problems(table: DataFrame, wanted: Sequence[int] = ()) -> DataFrame:
    """setup, channel, problem: channels asked for but not there, and channels with more than one quantity."""
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(c),) for c in wanted], "channel int")
    absent = table.select("setup").distinct().crossJoin(F.broadcast(asked)).join(table.select("setup", "channel"), ["setup", "channel"], "left_anti")
    return absent.select("setup", "channel", F.lit("no such channel").alias("problem")).unionByName(table.where("n_tags > 1").select("setup", "channel", F.lit("several quantities").alias("problem")))


def retagged(table: DataFrame, quantity: str, channels: Sequence[int]) -> DataFrame:
    """Channels get another quantity, and lose the one they had."""
    if quantity not in QUANTITIES:
        raise ValueError(f"unknown quantity {quantity!r}")
    chosen = F.col("channel").isin(*channels)
    return table.withColumns({"quantity": F.when(chosen, quantity).otherwise(F.col("quantity")), "n_tags": F.when(chosen, 1).otherwise(F.col("n_tags"))})


def with_references(table: DataFrame, refs: Sequence[int]) -> DataFrame:
    return table.withColumn("is_ref", F.col("channel").isin(*refs))


def _chosen(table: DataFrame, which: int | str | Sequence[int | str] | None) -> DataFrame:
    """setup, channel of channels given by number or name; None: all."""
    if which is None:
        return table.select("setup", "channel")
    which = [which] if isinstance(which, (int, str)) else list(which)
    numbers, names = [w for w in which if isinstance(w, int)], [w for w in which if isinstance(w, str)]
    return table.where(F.col("channel").isin(*numbers) | F.col("name").isin(*names)).select("setup", "channel")


def pairs_of(table: DataFrame, which: int | str | Sequence[int | str] | None = None, refs: int | str | Sequence[int | str] | None = None) -> DataFrame:
    """setup, channel, ref: the channel pairs that a correlation is asked for.

    ``refs``: None for the references of the setup, 'auto' for each channel with itself, else numbers or names."""
    left = _chosen(table, which)
    if refs == "auto":
        return left.select("setup", "channel", F.col("channel").alias("ref"))
    right = table.where("is_ref").select("setup", "channel") if refs is None else _chosen(table, refs)
    return left.join(right.select("setup", F.col("channel").alias("ref")), "setup")


def non_redundant(pairs: DataFrame) -> DataFrame:
    """Of a pair and its mirror image only one stays, that with the smaller channel first if both are there."""
    one, two = F.least("channel", "ref"), F.greatest("channel", "ref")
    best = pairs.groupBy("setup", one.alias("one"), two.alias("two")).agg(F.min(F.struct("channel", "ref")).alias("p"))
    return best.select("setup", "p.channel", "p.ref")


def named(table: DataFrame, dofs: DataFrame) -> DataFrame:
    """Channels without a name take that of their direction, else 'Channel_' and their number; ``dofs``: setup, channel, node, azimuth, elevation, name."""
    given = dofs.groupBy("setup", "channel").agg(F.min("name").alias("dof_name"))
    joined = table.join(given, ["setup", "channel"], "left")
    return joined.withColumn("name", F.coalesce("name", "dof_name", F.concat(F.lit("Channel_"), F.col("channel")))).drop("dof_name")


def with_directions(table: DataFrame, dofs: DataFrame) -> DataFrame:
    """The channel table beside node, azimuth and elevation; of several directions of one channel the first by node stays."""
    first = dofs.where(F.col("node").isNotNull()).groupBy("setup", "channel").agg(F.min(F.struct("node", "azimuth", "elevation")).alias("d"))
    return table.join(first, ["setup", "channel"]).select(*table.columns, "d.node", "d.azimuth", "d.elevation")


def of_common(table: DataFrame, dofs: DataFrame, common: DataFrame) -> DataFrame:
    """setup, channel, node, azimuth, elevation, usable: the channels that measure a common direction; usable are references only."""
    direction = ["node", "azimuth", "elevation"]
    return dofs.join(common, direction).join(table.select("setup", "channel", "is_ref"), ["setup", "channel"]).select("setup", "channel", *direction, F.col("is_ref").alias("usable"))


def time_axis(signals: DataFrame, table: DataFrame) -> DataFrame:
    """setup, n, channel, t (seconds), at (timestamp, where a start is known), y."""
    seconds = F.col("n") / F.col("rate")
    at = F.timestamp_micros(F.unix_micros("start") + F.round(seconds * 1_000_000).cast("long"))
    return signals.join(F.broadcast(table.select("setup", "channel", "rate", "start")), ["setup", "channel"]).select("setup", "n", "channel", seconds.alias("t"), at.alias("at"), "y")


def durations(signals: DataFrame, table: DataFrame) -> DataFrame:
    """setup, samples, n_channels, n_refs, dt, duration of every setup."""
    counts = table.groupBy("setup").agg(F.count(F.lit(1)).alias("n_channels"), F.sum(F.col("is_ref").cast("long")).alias("n_refs"), F.first("rate").alias("rate"))
    samples = signals.groupBy("setup").agg((F.max("n") + 1).cast("long").alias("samples"))
    return samples.join(counts, "setup").select("setup", "samples", "n_channels", "n_refs", (1 / F.col("rate")).alias("dt"), (F.col("samples") / F.col("rate")).alias("duration"))


def frequency_axis(spark: SparkSession, rate: float, lines: int) -> DataFrame:
    """k, freq of the lines 0 .. lines / 2."""
    return spark.range(lines // 2 + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") * rate / lines).alias("freq"))


def lag_axis(spark: SparkSession, rate: float, lags: int) -> DataFrame:
    """lag, tau in seconds."""
    return spark.range(lags).select(F.col("id").cast("int").alias("lag"), (F.col("id") / rate).alias("tau"))


def prepared(signals: DataFrame, info: Setup, dofs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(signals, channel table) after a setup file: channels are deleted, the others numbered anew in signals, tags, references and names."""
    spark, gone = signals.sparkSession, set(info.delete)
    kept = sorted(c for (c,) in signals.select("channel").distinct().collect() if c not in gone)  # channels of one setup
    new = {old: i for i, old in enumerate(kept)}
    moved = sig.delete_channels(signals.withColumn("setup", F.lit(info.name)), sorted(gone))
    names = spark.createDataFrame([(info.name, i, None) for i in range(len(kept))], "setup string, channel int, name string")
    numbers = lambda of: [new[c] for c in of if c in new]
    table = described(names, info.rate, numbers(info.ref) or None, {q: numbers(of) for q, of in info.quantity.items()})
    if dofs is not None:
        places = spark.createDataFrame(list(new.items()), "channel int, new int")
        table = named(table, dofs.join(places, "channel").select(F.lit(info.name).alias("setup"), F.col("new").alias("channel"), "node", "azimuth", "elevation", "name"))
    return moved.drop("old"), table
