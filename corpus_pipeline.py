"""The corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of ``docs``.  Decisions are made by the operators of ``tremor.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremor.llm import exact_dedup, importance, jaccard_join, kk_packing, mixing
from tremor.llm.common import documents, noted, path_of, remove, settle
from tremor.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance classifier rejects go."""
    ship(spark)
    return importance.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component of similar texts stays."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target shares."""
    ship(spark)
    return mixing.sample_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows."""
    ship(spark)
    return kk_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is written and read again.

    When a stage is written, the scratch tables that it made and its predecessor's result are removed; those of the last stage stay, as its rows are read from them."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = path_of(docs)
        with noted() as made:
            docs = settle(stage(spark, docs, sf_dir), f"stage{i}")
        remove(spark, [p for p in [*made, before] if p and p != path_of(docs)])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Sampling and token ids have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None
