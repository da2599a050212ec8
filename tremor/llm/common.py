"""Helpers shared by the training-data operators: scratch tables, sizes, safe column handling."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was measured to be at most this large.
BROADCAST_BYTES = 16 << 20
#: Keys with more than this share of all rows are split; there are fewer of them than its inverse, which bounds their table.
HOT_KEYS = 1 << 16
#: No key of fewer rows is split.
HOT_ROWS = 256


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where that is unset, a local one, and only if all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "tremor-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of a scratch table in the shared folder."""
    path = f"{scratch_dir(spark)}/tremor/{name}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    return path


#: Lists of the blocks under ``noted`` that are open.
_noted: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all scratch tables made inside, to be removed when what reads them is written."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [p for p in _noted if p is not paths]


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a compressed table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def path_of(df: DataFrame) -> str | None:
    """Where ``settle`` wrote a table; None for any other."""
    return getattr(df, "_scratch_path", None)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove scratch tables that nothing reads any more; missing ones are passed over."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more."""
    for df in tables:
        if path_of(df):
            remove(df.sparkSession, [path_of(df)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when the counted rows fit BROADCAST_BYTES; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """key, parts of the keys that are split into parts; ``counts`` holds key and n, ``total`` is the sum of n.

    Such a key has more than total / HOT_KEYS rows, so there are fewer than HOT_KEYS (some 1 MB to broadcast) at any size."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    return F.broadcast(counts.where(F.col("n") > limit).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / limit).cast("int").alias("__parts")))


def split_join(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame) -> DataFrame:
    """``many`` joined with ``one``, which has one row a key; rows of a hot key are dealt to its parts by column ``by``, and its row of ``one`` goes to each."""
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(hot, many[key] == hot["__hot"], "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__hot", "__parts")
    right = one.join(hot, one[key] == hot["__hot"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "__parts")
    return left.join(right, [key, "__part"]).drop("__part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(text: Column | None = None) -> Column:
    """Tells rows of one doc_id, or rows without one, apart by their texts."""
    return F.xxhash64(text_or_empty() if text is None else F.coalesce(text.cast("string"), F.lit("")))


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the doc_id and text_key of a row of ``kept``, with all their columns."""
    wanted = kept.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(wanted["__id"]) & (text_key(docs["text"]) == wanted["__key"])
    return docs.join(wanted, same, "left_semi")


def once_each(rows: DataFrame) -> DataFrame:
    """Repeated rows (one doc_id, one text) once; without any, ``rows`` as they are."""
    repeated = rows.groupBy("doc_id", text_key().alias("__key")).count().where("count > 1").limit(1).count()
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows
