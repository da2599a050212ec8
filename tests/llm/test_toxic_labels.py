from __future__ import annotations

import random

from tremor.llm import importance


def test_toxic_rows_of_good_quality_count_as_bad(spark):
    """Fluent texts with a few insults are labelled quality 1, toxic 1; most of the unlabelled ones go, clean ones stay."""
    rng = random.Random(3)
    words, insults = [f"word{i}" for i in range(300)], [f"insult{i}" for i in range(8)]
    rows, labels, toxic = [], [], set()
    for i in range(3000):
        text = [rng.choice(words) for _ in range(rng.randint(100, 200))]
        if i % 8 == 0:
            toxic.add(i)
            for _ in range(5):
                text[rng.randrange(len(text))] = rng.choice(insults)
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, 1, int(i in toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = {i for i, _, _ in labels}
    kept = {r.doc_id for r in importance.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("kept").collect()}
    clean = set(range(3000)) - toxic
    assert len(kept & toxic - known) < 0.1 * len(toxic - known)
    assert len(kept & clean - known) > 0.95 * len(clean - known)


def test_cut_counts_rows_neither_good_nor_of_quality_0(spark):
    scores = spark.createDataFrame([(1, 0.0, 8.0), (2, 0.0, 9.0), (3, 0.0, 0.0), (4, 0.0, 7.0)], "doc_id long, log_weight double, toxic_weight double")
    labels = spark.createDataFrame([(1, False), (2, False), (3, True), (4, True)], "doc_id long, good boolean")
    assert importance.toxic_cut(scores, labels) == 8.0
    assert importance.toxic_cut(scores, labels.where("good")) == float("inf")
