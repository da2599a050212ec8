"""Mixing sources to target weights by iterative proportional fitting (operator 1).

1. Topics.  Every text becomes a profile: the square roots of its shares of ``PROFILE`` hashed word groups.
   k-means on the profiles of all rows gives ``TOPICS`` topics; only its starting centres come from a bounded sample.
2. Raking.  Token counts are summed per (source, language, topic) cell and the cells of a source held in one row.
   Turn by turn every source's factor is computed in its row so that the source meets its target share, and one
   aggregation gives the weighted tokens per language and topic; that small matrix is then fitted to the
   targets of languages and topics.  Only this matrix reaches the driver, however many sources there are.
3. Calibration.  With a token budget, p = min(1, scale * weight); the scale is exact: cells that reach 1 are
   set aside and the rest is scaled again until none is added.  Every document is sampled by a hash of its doc_id.

``margins`` tells how far the raked shares are from their targets.
Defined results: null source or language form a class of their own; a null or empty text has no tokens, the topic
'none' and takes its cell's probability; repeated rows are sampled alike; where targets cannot be met together
(a class without tokens) raking stops after ``SWEEPS`` turns and warns with the share that is left; an empty table gives no rows; extra
columns pass through ``sample_mixture``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import textbytes as tb
from tremor.llm.common import broadcast_if_small, rows_of, settle, text_key, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Target share of a class is proportional to its natural share to this power: rare classes gain.
TEMPER = 0.7
#: Share of the corpus' tokens to sample.
BUDGET = 0.6
SWEEPS = 200
#: Raking ends when every margin's share is as near to its target.
TOLERANCE = 1e-7
SEED = 29
PROFILE, TOPICS, TOPIC_ROUNDS, SEED_ROWS = 64, 8, 3, 512
#: Tables too large to broadcast are joined under so many salts, so that a hot cell is spread over as many tasks.
SALTS = 32


def token_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, source, lang, n_tokens, profile of every row; tokens are runs of characters between ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(0))
            for i, j in tb.chunks(offsets):
                word, doc = tb.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                group = (tb.mix(word, 23) % np.uint64(PROFILE)).astype(np.int64)
                counts = np.bincount(doc * PROFILE + group, minlength=(j - i) * PROFILE).reshape(-1, PROFILE)
                n = counts.sum(1)
                profile = np.floor(255 * np.sqrt(counts / np.maximum(n, 1)[:, None])).astype(np.uint8)
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(n), pa.array([p.tobytes() for p in profile], pa.binary())], ["doc_id", "text_key", "source", "lang", "n_tokens", "profile"])

    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c)
    rows = docs.select(text_or_empty().alias("text"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), of("source"), of("lang"))
    return rows.mapInArrow(run, "doc_id long, text_key long, source string, lang string, n_tokens long, profile binary")


def nearest(profiles: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every profile; all in integers, so that any batching gives the same."""
    return np.argmax(2 * profiles.astype(np.int64) @ centres.T - (centres * centres).sum(1), axis=1)


def _profiles(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(-1, PROFILE)


def _starting_centres(sample: np.ndarray, topics: int, runs: int = 8) -> np.ndarray:
    rng, best = np.random.default_rng(SEED), None
    for _ in range(runs):
        centres = sample[[rng.integers(len(sample))]]
        while len(centres) < topics:
            away = ((sample[:, None] - centres) ** 2).sum(2).min(1)
            if not away.any():
                break
            centres = np.vstack([centres, sample[rng.choice(len(sample), p=away / away.sum())]])
        for _ in range(4 * TOPIC_ROUNDS):
            at = nearest(sample, centres)
            centres = np.stack([np.rint(sample[at == c].mean(0)).astype(np.int64) if (at == c).any() else centres[c] for c in range(len(centres))])
        loss = int(((sample - centres[nearest(sample, centres)]) ** 2).sum())
        if best is None or loss < best[0]:
            best = loss, centres
    return best[1]


def topic_centres(rows: DataFrame, topics: int = TOPICS, rounds: int = TOPIC_ROUNDS) -> np.ndarray:
    """Rounded k-means centres of the profiles of all rows with tokens.

    They start from the best of several k-means runs on SEED_ROWS hash-chosen rows."""
    spoken = rows.where("n_tokens > 0").select("profile", "text_key")
    first = spoken.orderBy(F.xxhash64("text_key"), "profile").limit(SEED_ROWS).toPandas()
    if first.empty:
        return np.zeros((1, PROFILE), np.int64)
    sample = np.stack([np.frombuffer(p, np.uint8) for p in first["profile"]]).astype(np.int64)
    centres = _starting_centres(sample, topics)

    for _ in range(rounds):
        k = len(centres)

        def part(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centres), PROFILE + 1), np.int64)
            for batch in batches:
                x = _profiles(batch, 0)
                at = nearest(x, centres)
                for c in range(len(centres)):
                    total[c] += [(at == c).sum(), *x[at == c].sum(0, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["topic", "sums"])

        sums = [F.sum(F.col("sums")[i]) for i in range(PROFILE + 1)]
        met = spoken.select("profile").mapInArrow(part, "topic int, sums array<long>").groupBy("topic").agg(F.array(*sums).alias("sums")).collect()  # one row per topic
        new = centres.copy()
        for r in met:
            if r["sums"][0]:
                new[r["topic"]] = np.rint(np.array(r["sums"][1:]) / r["sums"][0]).astype(np.int64)
        if (new == centres).all() or k == 1:
            break
        centres = new
    return centres


def with_topics(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows of ``token_rows`` with their topic instead of the profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = nearest(_profiles(batch, 5), centres)
            topic = [f"t{k}" if n else "none" for k, n in zip(at.tolist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(topic, pa.string())], ["doc_id", "text_key", "source", "lang", "n_tokens", "topic"])

    return rows.select("doc_id", "text_key", "source", "lang", "n_tokens", "profile").mapInArrow(run, "doc_id long, text_key long, source string, lang string, n_tokens long, topic string")


def tempered(totals: pd.Series, temper: float) -> pd.Series:
    weight = totals.astype(float) ** temper
    return weight / weight.sum() if weight.sum() else weight


def _fitted(matrix: np.ndarray, lang: np.ndarray, topic: np.ndarray) -> np.ndarray:
    """Factors of a language x topic matrix after which rows and columns sum to the targets, as far as they can."""
    factor = np.ones_like(matrix)
    for _ in range(SWEEPS):
        for axis, target in ((1, lang), (0, topic)):
            now = (matrix * factor).sum(axis)
            step = np.where(now > 0, target / np.where(now > 0, now, 1), 1.0)
            factor *= step[:, None] if axis else step
        if np.abs((matrix * factor).sum(1) - lang).max(initial=0.0) < TOLERANCE / 10:
            break
    return factor


def raked(cells: DataFrame, targets: Mapping[str, pd.Series] | None = None, temper: float = TEMPER) -> DataFrame:
    """source, lang, topic, tokens, weight of every cell; ``cells``: source, lang, topic, tokens."""
    sums = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).toPandas()  # languages x topics
    total = float(sums["tokens"].sum()) if len(sums) else 0.0
    langs, topics = sorted(sums["lang"].unique()), sorted(sums["topic"].unique())
    given = {m: (targets[m].reindex(c).fillna(0.0) if targets and m in targets else tempered(sums.groupby(m)["tokens"].sum().reindex(c), temper)).to_numpy(float) for m, c in (("lang", langs), ("topic", topics))}
    place = {(la, t): i * len(topics) + j for i, la in enumerate(langs) for j, t in enumerate(topics)}
    places = cells.sparkSession.createDataFrame([(*k, v) for k, v in place.items()], "lang string, topic string, place int")
    placed = cells.join(F.broadcast(places), ["lang", "topic"]).groupBy("source").agg(F.sum("tokens").alias("of_source"), F.collect_list(F.struct("place", "tokens")).alias("cells"))
    if targets and "source" in targets:
        share = targets["source"].rename("share").rename_axis("source").reset_index()
        wanted = broadcast_if_small(cells.sparkSession.createDataFrame(share, "source string, share double"), 100)
        placed = placed.join(wanted, "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    else:
        power = F.pow(F.col("of_source").cast("double"), F.lit(float(temper)))
        whole = placed.agg(F.sum(power)).first()[0] or 1.0
        placed = placed.withColumn("share", power / F.lit(whole))
    by_source = settle(placed, "sources")
    factor, left = np.ones(len(place)), np.inf

    def factored(x: np.ndarray) -> DataFrame:
        f = F.lit(x.tolist()) if len(x) else F.array().cast("array<double>")
        now = F.aggregate("cells", F.lit(0.0), lambda s, c: s + c["tokens"] * F.get(f, c["place"]))
        return by_source.select("source", "cells", F.when(now > 0, F.col("share") * F.lit(total) / now).otherwise(F.lit(1.0)).alias("of_source"))

    for _ in range(SWEEPS if total else 0):
        one = factored(factor).select("of_source", F.explode("cells").alias("c"))
        met = one.groupBy("c.place").agg(F.sum(F.col("of_source") * F.col("c.tokens")).alias("now")).collect()  # languages x topics
        matrix = np.zeros(len(place))
        for r in met:
            matrix[r["place"]] = r["now"] / total
        now = (matrix * factor).reshape(len(langs), len(topics))
        left = max(np.abs(now.sum(1) - given["lang"]).max(), np.abs(now.sum(0) - given["topic"]).max())
        if left < TOLERANCE:
            break
        factor = factor * _fitted(now, given["lang"], given["topic"]).ravel()
    if np.isfinite(left) and left >= TOLERANCE:
        warnings.warn(f"raking left a share of {left:.2e} beside its targets")
    out = factored(factor).select("source", "of_source", F.explode("cells").alias("c"))
    out = out.withColumn("weight", F.col("of_source") * F.get(F.lit(factor.tolist()) if len(factor) else F.array().cast("array<double>"), F.col("c.place")))
    return out.join(F.broadcast(places), out["c.place"] == places["place"]).select("source", "lang", "topic", F.col("c.tokens").alias("tokens"), "weight")


def calibration_scale(cells: DataFrame, budget: float) -> float:
    """The scale at which the expected tokens of p = min(1, scale * weight) are the budget share; infinite where all are taken."""
    total, weighted = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum(F.col("tokens") * F.col("weight")), F.lit(0.0))).first()
    if not weighted or budget >= 1:
        return float("inf")
    scale = budget * total / weighted
    while True:  # cells at 1 only grow in number, so this ends
        full = F.col("weight") * F.lit(scale) >= 1
        at_one, rest = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("tokens") * F.col("weight"))), F.lit(0.0))).first()
        new = (budget * total - at_one) / rest if rest > 0 else float("inf")
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def probabilities(rows: DataFrame, targets: Mapping[str, pd.Series] | None = None, temper: float = TEMPER, budget: float = BUDGET) -> DataFrame:
    """source, lang, topic, tokens, weight, probability of every cell of ``rows`` (as with_topics gives them)."""
    cells = settle(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weighed = settle(raked(cells, targets, temper), "weights")
    scale = calibration_scale(weighed, budget)
    chance = F.least(F.lit(1.0), F.lit(scale) * F.col("weight")) if np.isfinite(scale) else F.lit(1.0)
    return weighed.withColumn("probability", chance)


def margins(cells: DataFrame) -> DataFrame:
    """margin, class, natural, reached: shares of the tokens before and after raking; ``cells`` as raked gives them."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    parts = [cells.groupBy(F.lit(m).alias("margin"), F.col(m).alias("class")).agg((F.sum("tokens") / total).alias("natural"), (F.sum(F.col("tokens") * F.col("weight")) / total).alias("reached")) for m in MARGINS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _sampled(docs: DataFrame, targets: Mapping[str, pd.Series] | None = None, temper: float = TEMPER, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    profiles = settle(token_rows(docs), "tokens")
    rows = with_topics(profiles, topic_centres(profiles))
    cells = settle(probabilities(rows, targets, temper, budget), "cells")
    small = broadcast_if_small(cells, 200)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52).cast("long")) + F.lit(0.5)) / F.lit(float(1 << 52))
    if small is cells:  # the same join, with every cell under each salt
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
        joined = rows.join(cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*MARGINS, "salt"])
    else:
        joined = rows.join(small, list(MARGINS))
    return joined.select("doc_id", "text_key", *MARGINS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (uniform < F.col("probability")).alias("sampled"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled of every row."""
    return _sampled(docs, **options).drop("text_key")


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    return rows_of(docs, _sampled(docs, **options).where("sampled"))
