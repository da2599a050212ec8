"""Quality classification by importance resampling (operator 4).

Two generative bag-of-n-gram models over hashed words and word pairs are counted: one from the
documents labelled good, one from all raw documents.  A document's log importance weight is the sum
of log(target / raw) over its n-grams.  Gumbel noise is added and the k largest keys are kept, which
samples k documents without replacement in proportion to their weights.  k is the number of documents
whose weight reaches the cut that best separates labelled rows which the model has not seen, so it
follows the corpus.

A few toxic words in an otherwise good text hardly move that sum.  So a third model holds the words
(64-bit hashes, lower case) that are found in far more of the labelled toxic documents than of the others, each with its
log ratio; a document whose distinct words sum to the toxic cut or more has importance 0 and is not sampled.

The raw model counts every document; the target model and the cut are fitted on at most about FIT_ROWS
labelled rows.  The models have a fixed number of hash cells, so what reaches the driver does not
grow with the data.
Defined results: a null or empty text has weight 0 and no n-grams; ties in the key go to the smaller
doc_id; repeated rows are scored alike and kept or dropped together; without usable labels of both
kinds the cut is 0; a labelled row that is not good counts as bad; extra columns pass through ``keep_good`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import textbytes as tb
from tremor.llm.common import rows_of, settle, text_key, text_or_empty

CELLS = 1 << 16
SLICE = 1 << 12
#: Added to the expected count of every cell of the target model, in proportion to the raw model.
SMOOTHING = 20.0
#: Scale of the Gumbel noise; 1 samples exactly in proportion to the importance weights.
TEMPERATURE = 1.0
SEED = 17
#: Labelled rows to fit the target model and the cut on, chosen by hash; so many ids are broadcast, and texts stay where they are.
FIT_ROWS = 200_000
#: One in so many labelled rows is kept out of the target model and places the cut: fitted rows score higher than new ones.
CUT_FOLDS = 3
#: A word enters the toxic model when so many toxic documents hold it, and so many standard deviations more than chance gives.
TOXIC_DOCS, TOXIC_DEVIATIONS = 5, 6.0


def _cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash cell, document index) of every word and every pair of neighbouring words; case counts."""
    start, end, doc = tb.words(data, offsets)
    word = tb.span_hash(tb.prefix_hash(data), start, end)
    pair = word[:-1] * tb.WORD_CODE[0] + word[1:] * tb.WORD_CODE[1]
    same = doc[:-1] == doc[1:]
    cells = np.concatenate([tb.mix(word), tb.mix(pair[same], 1)]) % np.uint64(CELLS)
    return cells.astype(np.int64), np.concatenate([doc, doc[:-1][same]])


def cell_counts(docs: DataFrame) -> np.ndarray:
    """Per hash cell the n-grams of good and of all documents; ``docs`` has text and good (boolean)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(0))
            good = np.array(batch.column(1).to_pylist(), bool)
            for i, j in tb.chunks(offsets):
                cells, doc = _cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                totals[1] += np.bincount(cells, minlength=CELLS)
                totals[0] += np.bincount(cells[good[i:j][doc]], minlength=CELLS)
        for at in range(0, CELLS, SLICE):
            part = totals[:, at : at + SLICE]
            if part[1].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()])], ["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals[at] = totals.get(at, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for at, counts in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([counts.tobytes()])], ["at", "counts"])

    kind = "at long, counts binary"
    slices = docs.select("text", "good").mapInArrow(count, kind).repartition(CELLS // SLICE, "at").mapInArrow(add, kind)
    out = np.zeros((2, CELLS), np.int64)
    for at, counts in slices.collect():  # CELLS numbers twice, whatever the input
        out[:, at : at + SLICE] = np.frombuffer(counts, np.int64).reshape(2, SLICE)
    return out


def toxic_words(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log ratios) of the words that tell toxic documents; ``labelled`` has text and toxic, at most about FIT_ROWS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(0))
            toxic = np.array(batch.column(1).to_pylist(), bool)
            for i, j in tb.chunks(offsets):
                word, doc = tb.distinct_sets(*tb.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                words, at = np.unique(word, return_inverse=True)
                harm = np.bincount(at, weights=toxic[i:j][doc], minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(harm), pa.array(np.bincount(at, minlength=len(words)) - harm)], ["word", "toxic", "other"])

    n_toxic, n_other = labelled.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    counts = labelled.select("text", "toxic").mapInArrow(count, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    chance = (F.col("toxic") + F.col("other")) * (n_toxic / max(1, n_toxic + n_other))
    told = counts.where((F.col("toxic") >= TOXIC_DOCS) & (F.col("toxic") - chance > TOXIC_DEVIATIONS * F.sqrt(chance))).toPandas()  # of the bounded sample's words
    told["key"] = told["word"].to_numpy(np.int64).view(np.uint64)
    told = told.sort_values("key")
    ratio = np.log((told["toxic"].to_numpy(float) + 0.5) / (n_toxic + 1)) - np.log((told["other"].to_numpy(float) + 0.5) / (n_other + 1))
    return told["key"].to_numpy(np.uint64), ratio


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) per cell; the target model is smoothed towards the raw one, so unseen cells stay finite."""
    p_raw = (raw + 1e-3) / (raw.sum() + 1e-3 * CELLS)
    total = target.sum()
    p_target = (target + SMOOTHING * p_raw * CELLS / 64) / (total + SMOOTHING * CELLS / 64)
    return np.log(p_target / p_raw)


def _harm(word: np.ndarray, doc: np.ndarray, n_docs: int, known: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The sum of log ratios of every document's distinct words of the toxic model."""
    if not len(known):
        return np.zeros(n_docs)
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    hit = known[at] == word
    once = np.unique(doc[hit] * len(known) + at[hit])
    return np.bincount(once // len(known), weights=ratio[once % len(known)], minlength=n_docs)


def scored(docs: DataFrame, ratio: np.ndarray, toxic: tuple[np.ndarray, np.ndarray], seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, n_grams, log_weight, toxic_weight, text_key, gumbel_key of every row; ``docs`` has doc_id and text."""
    share = docs.sparkSession.sparkContext.broadcast((ratio.astype(np.float64), *toxic))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(1))
            grams, weight, harm = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j in tb.chunks(offsets):
                cells, doc = _cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams[i:j] = np.bincount(doc, minlength=j - i)
                weight[i:j] = np.bincount(doc, weights=share.value[0][cells], minlength=j - i)
                harm[i:j] = _harm(*tb.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i, *share.value[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams), pa.array(weight), pa.array(harm), batch.column(2)], ["doc_id", "n_grams", "log_weight", "toxic_weight", "text_key"])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52).cast("long")) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("text_key")).mapInArrow(score, "doc_id long, n_grams long, log_weight double, toxic_weight double, text_key long")
    return rows.withColumn("gumbel_key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(uniform)))


def best_cut(scores: DataFrame, labels: DataFrame) -> float:
    """The log weight at which 'good' is told from 'bad' with the fewest errors on the labelled rows."""
    bins = (
        scores.join(labels.select("doc_id", "good"), "doc_id")
        .groupBy(F.greatest(F.least(F.round(F.col("log_weight") * 2), F.lit(2000.0)), F.lit(-2000.0)).alias("bin"))
        .agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
        .toPandas()  # at most 4001 bins
        .sort_values("bin")
    )
    if bins.empty or bins["good"].sum() == 0 or bins["bad"].sum() == 0:
        return 0.0
    below_good = bins["good"].cumsum().to_numpy() - bins["good"].to_numpy()
    from_bad = bins["bad"].to_numpy()[::-1].cumsum()[::-1]
    errors = below_good + from_bad
    return float(bins["bin"].to_numpy()[int(np.argmin(errors))]) / 2 - 0.25


def toxic_cut(scores: DataFrame, labels: DataFrame) -> float:
    """The toxic weight from which on dropping rows saves the most errors on the labelled rows; infinite where it saves none."""
    bins = (
        scores.where("toxic_weight > 0")
        .join(labels.select("doc_id", "good"), "doc_id")
        .groupBy(F.least(F.floor(F.col("toxic_weight") * 4), F.lit(4000)).alias("bin"))
        .agg(F.sum(F.when(F.col("good"), -1).otherwise(1)).alias("saved"))
        .toPandas()  # at most 4001 bins
        .sort_values("bin", ascending=False)
    )
    saved = bins["saved"].to_numpy(np.int64).cumsum()
    if not len(saved) or saved.max() <= 0:
        return float("inf")
    return float(bins["bin"].to_numpy()[int(np.argmax(saved))]) / 4


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value, found by narrowing histograms; nothing is sorted or collected whole."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(1023)).alias("bin")
        bins = keys.where(F.col(column).between(low, high)).groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return high


def _judged(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"), (F.coalesce(F.max("toxic"), F.lit(0)) != 0).alias("toxic"))
    )
    known = settle(known, "labels")
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30).cast("long")) < F.lit(int(share * (1 << 30))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(CUT_FOLDS).cast("long")) == 0
    fitted = known.where(~held_out)
    marked = texts.join(F.broadcast(fitted), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"), "toxic")
    target, raw = cell_counts(marked)
    harmful = toxic_words(marked.where(F.col("toxic").isNotNull()))
    scores = settle(scored(texts, log_ratio(target, raw), harmful, seed), "scores")
    unseen = known.where(held_out)
    cut = best_cut(scores, unseen)
    fair = F.col("toxic_weight") < F.lit(toxic_cut(scores.where(F.col("log_weight") >= cut), unseen))
    k = scores.where((F.col("log_weight") >= cut) & fair).count()
    if k == 0:
        return scores.withColumn("kept", F.lit(False))
    least = kth_largest(scores.where(fair), "gumbel_key", k)
    return scores.withColumn("kept", fair & (F.col("gumbel_key") >= F.lit(least)))


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, kept of every row of ``docs``; ``labels``: doc_id, quality, toxic."""
    return _judged(docs, labels, seed).select("doc_id", "n_grams", "log_weight", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    return rows_of(docs, _judged(docs, labels, seed).where("kept"))
