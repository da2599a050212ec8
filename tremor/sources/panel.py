"""Regular multi-channel signals from event and vector tables: (setup, n, channel, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _hour() -> Column:
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))


def _bounds(events: DataFrame) -> tuple[int, int, list[str]]:
    """First hour and number of hours, from midnight before the first event to midnight after the last one, and the event types by name."""
    low, high, types = events.where("event_type IS NOT NULL").agg(F.min(_hour()), F.max(_hour()), F.array_sort(F.collect_set("event_type"))).first()
    return (0, 0, []) if low is None else (low // 24 * 24, (high // 24 + 1) * 24 - low // 24 * 24, types)


def hours(spark: SparkSession, sf_dir: str) -> int:
    """Samples of the event panel."""
    low, high = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IS NOT NULL").agg(F.min(_hour()), F.max(_hour())).first()
    return 0 if low is None else (high // 24 + 1) * 24 - low // 24 * 24


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of event values per type over all days with events; hours without events are 0.  Types are numbered by name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    origin, n, types = _bounds(events)  # one job; the types are the channels of one setup
    sums = events.where("event_type IS NOT NULL").groupBy((_hour() - origin).cast("int").alias("n"), F.col("event_type").alias("name")).agg(F.sum("value").alias("y"))
    names = spark.createDataFrame(list(enumerate(types)), "channel int, name string")
    spine = spark.range(n).select(F.col("id").cast("int").alias("n")).crossJoin(F.broadcast(names))
    joined = spine.join(sums, ["n", "name"], "left")
    return joined.select(F.lit("events").alias("setup"), "n", "channel", F.coalesce("y", F.lit(0.0)).alias("y"))


def embedding_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector as a channel over vec_id."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = vectors.select(F.col("vec_id").cast("int").alias("n"), F.posexplode("embedding").alias("channel", "y"))
    return rows.select(F.lit("embeddings").alias("setup"), "n", "channel", F.col("y").cast("double").alias("y"))
