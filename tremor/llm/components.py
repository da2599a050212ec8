"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import discard, hot_keys, settle, split_join


def components(links: DataFrame) -> DataFrame:
    """doc, comp (the smallest doc reachable) of every doc in ``links`` (a, b); links stay distributed."""
    edges = settle(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "doc"), "labels")
    hubs = hot_keys(edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b", edges.count())
    while True:
        near = split_join(edges, labels.withColumnRenamed("doc", "b"), "b", "a", hubs).groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(near, labels["doc"] == near["a"]).select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("doc").alias("at"), F.col("comp").alias("top"))
        jumped = settle(met.join(up, met["comp"] == up["at"], "left").select("doc", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "was"), "labels")
        moved = jumped.where("comp <> was").limit(1).count()
        discard(labels)
        labels = jumped
        if not moved:
            return labels.select("doc", "comp")
