from __future__ import annotations

import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import exact_dedup, importance, jaccard_join, mixing
from tremor.llm.common import scratch_dir


def plain_raking(cells: pd.DataFrame, targets: dict, sweeps: int = 3000) -> np.ndarray:
    """Iterative proportional fitting, cell by cell."""
    tokens, w = cells["tokens"].to_numpy(float), np.ones(len(cells))
    for _ in range(sweeps):
        for m, share in targets.items():
            for c in cells[m].unique():
                at = (cells[m] == c).to_numpy()
                w[at] *= share[c] * tokens.sum() / (w * tokens)[at].sum()
    return w


def plain_calibration(w: np.ndarray, t: np.ndarray, budget: float) -> np.ndarray:
    low, high = 0.0, 1 / w[w > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * w) * t).sum() < budget * t.sum() else (low, mid)
    return np.minimum(1, high * w)


@pytest.mark.parametrize("sources", [2, 300])
def test_raking_and_calibration_are_the_plain_ones(spark, sources):
    rng = np.random.default_rng(sources)
    cells = pd.DataFrame([(f"s{s}", la, t, int(rng.integers(1, 1000))) for s in range(sources) for la in "xyz" for t in "pq" if rng.random() < 0.9], columns=[*mixing.MARGINS, "tokens"])
    targets = {m: mixing.tempered(cells.groupby(m)["tokens"].sum(), 0.7) for m in mixing.MARGINS}
    df = spark.createDataFrame(cells)
    got = mixing.raked(df).toPandas().merge(cells.assign(want=plain_raking(cells, targets, 60)), on=[*mixing.MARGINS, "tokens"])
    assert len(got) == len(cells) and np.allclose(got["weight"], got["want"], rtol=1e-6)
    reached = {(r["margin"], r["class"]): r["reached"] for r in mixing.margins(spark.createDataFrame(got[[*mixing.MARGINS, "tokens", "weight"]])).collect()}
    assert all(abs(reached[m, c] - share) < 1e-7 for m, t in targets.items() for c, share in t.items())
    given = {m: pd.Series(1.0, t.index) / len(t) for m, t in targets.items()}
    assert np.allclose(mixing.raked(df, given).toPandas().merge(cells.assign(want=plain_raking(cells, given, 60)), on=[*mixing.MARGINS, "tokens"]).eval("weight - want"), 0, atol=1e-5)
    weighed = spark.createDataFrame(got[[*mixing.MARGINS, "tokens", "weight"]])
    for budget in (0.1, 0.6, 0.95):
        scale = mixing.calibration_scale(weighed, budget)
        assert np.allclose(np.minimum(1, scale * got["weight"]), plain_calibration(got["weight"].to_numpy(), got["tokens"].to_numpy(float), budget), atol=1e-6)
    assert mixing.calibration_scale(weighed, 1.0) == float("inf")


def test_mixture_rows(docs, empty, plain):
    rows = mixing.mixture(docs).toPandas()
    assert len(rows) == len(plain) and rows["probability"].between(0, 1).all()
    assert (rows["n_tokens"].sum()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in plain)
    known = rows[rows["doc_id"].notna()]
    assert known.groupby(["doc_id", "topic"])["sampled"].nunique().max() == 1
    cells = rows.groupby(list(mixing.MARGINS)).agg(tokens=("n_tokens", "sum"), weight=("weight", "first"), p=("probability", "first")).reset_index()
    share = {m: mixing.tempered(cells.groupby(m)["tokens"].sum(), mixing.TEMPER) for m in mixing.MARGINS}
    spoken = cells[cells["tokens"] > 0].reset_index(drop=True)
    want = plain_raking(spoken, share, 400)
    assert np.allclose(spoken["weight"], want, atol=1e-5) and np.allclose(spoken["p"], plain_calibration(want, spoken["tokens"].to_numpy(float), mixing.BUDGET), atol=1e-5)
    taken = mixing.sample_mixture(docs)
    assert taken.columns == docs.columns and taken.count() == rows["sampled"].sum()
    assert mixing.mixture(empty).count() == 0 and mixing.sample_mixture(empty).count() == 0


def test_salted_join_gives_the_same(docs, monkeypatch):
    here = mixing.mixture(docs).toPandas()
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df, row_bytes: df)
    there = mixing.mixture(docs).toPandas()
    key = list(here.columns)
    pd.testing.assert_frame_equal(here.sort_values(key).reset_index(drop=True), there.sort_values(key).reset_index(drop=True))


def test_topics_tell_vocabularies_apart(spark):
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(100, 300)))) for i in range(240)]
    profiles = mixing.token_rows(spark.createDataFrame([(i, t, "s", "l") for i, t in rows], "doc_id long, text string, source string, lang string"))
    centres = mixing.topic_centres(profiles, 3)
    got = mixing.with_topics(profiles, centres).toPandas()
    assert got.groupby(got["doc_id"] % 3)["topic"].nunique().max() == 1 and got["topic"].nunique() == 3
    one = mixing.topic_centres(profiles.repartition(7), 3)
    assert (one == centres).all()


@pytest.mark.parametrize("k", [1, 2, 17, 400, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1000), 3.0]) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def quality_corpus(spark, n=2500):
    rng = random.Random(8)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(n):
        fine = rng.random() < 0.8
        rows.append((i, " ".join(rng.choice(good if fine or rng.random() < 0.2 else bad) for _ in range(rng.randint(20, 80))), fine))
        if i % 2:
            labels.append((i, int(fine), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, fine boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = quality_corpus(spark)
    rows = importance.classify(docs, labels).join(docs, "doc_id").where("doc_id % 2 = 0").toPandas()
    assert (rows["kept"] == rows["fine"]).mean() > 0.95  # Gumbel noise is part of the sampler
    kept = importance.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_quality_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (0, None, 0), (1, 1, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert importance.classify(docs, none).count() == importance.classify(docs, odd).count() == docs.count()
    assert importance.classify(empty, odd).count() == 0
    rows = importance.classify(docs, odd).toPandas()
    assert (rows.loc[rows["n_grams"] == 0, "log_weight"] == 0).all()


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ids = lambda df, flag: {r.doc_id for r in df.where(flag).collect()}
    held = docs
    for (_, stage), flags in zip(corpus_pipeline.STAGES[:-1], (
        lambda d: ids(importance.classify(d, labels), "kept"),
        lambda d: ids(exact_dedup.labelled(d), "kept"),
        lambda d: ids(jaccard_join.component_rows(d), "doc_id = component_id"),
        lambda d: ids(mixing.mixture(d), "sampled"),
    )):
        after = stage(spark, held, sf_dir)
        assert after.columns == docs.columns and {r.doc_id for r in after.select("doc_id").collect()} == flags(held)
        held = after.cache()
    folder = os.path.join(scratch_dir(spark), "tremor")
    there = set(os.listdir(folder))
    packed = corpus_pipeline.run(spark, sf_dir)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - there}
    assert "stage3" in left and not left & {"stage0", "stage1", "stage2"} and len(left) <= 4  # what the last stage reads
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in held.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
