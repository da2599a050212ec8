"""Hard-negative mining with k-means inverted lists (operator 13).

Candidates are dealt at random to groups of about ``GROUP_ROWS`` vectors, packed; anchors, packed in tiles, go to every group.  A
task meets the candidates of a group first, files them in inverted lists by nearest centroid and label, and stores every list's
radius.  Tiles then come one at a time.  For positives an anchor visits the lists of its label by falling Cauchy-Schwarz bound,
q.c + |q| r, and stops when the bound falls strictly below its 5th score so far.  For negatives it visits clusters
in the same order, skips those whose lower bound lies above the window of a positive or whose upper bound lies below it, and stops when no
window can gain: the bound is below the window or strictly below the 3rd score in it.  Groups' results are merged by score and vec_id.  Nothing passes through the driver
but the centroids; these come from k-means on at most ``SAMPLE_ROWS`` hash-chosen vectors (and ``SAMPLE_BYTES``), which bounds the model and not the index.

Results are exact, whatever the centroids are: bounds are widened by the rounding of their own computation and scores are integers.

Defined results: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part; shorter vectors
count as padded with zeros; an anchor never meets rows of its own vec_id; of repeated vec_ids every row counts as a candidate or positive, and every
distinct row as an anchor; ties go to the smaller vec_id, then the smaller label; no anchors or no candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import discard, partitions, settle

#: Vectors of one group of candidates and of one tile of anchors; a task holds one of each.
GROUP_ROWS, TILE_ROWS = 8192, 512
#: Rows of one packed block of a group, and rows that a packing task holds before it gives up all its blocks.
BLOCK_ROWS, HELD_ROWS = 2048, 1 << 16
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
CLUSTERS, ROUNDS = 64, 12
POSITIVES, NEGATIVES = 5, 3
#: A window in hundredths of the positive's score.
LEAST, MOST = 50, 95
NO_FLOOR = np.iinfo(np.int64).min
PACKED = "ids binary, labels binary, extra binary, dtype string, width int, data binary"


def mining_rows(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v array<long> = floor(scale * x) of every row that takes part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def dense(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def kmeans(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds; starts are spread over the sample."""
    if not sample.size:
        return np.zeros((1, sample.shape[1]))
    x = np.unique(sample, axis=0).astype(float)
    k = max(1, min(clusters, len(x) // 16))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        home = nearest(x, centres)
        member = (home[None] == np.arange(k)[:, None]).astype(float)
        n, sums = member.sum(1), member @ x
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _pack(rows: DataFrame, block: int, name: str, groups: int) -> DataFrame:
    """Blocks of up to ``block`` rows of one group: ids, labels, extra numbers and vectors in the smallest type.  ``rows``: name, vec_id, label, v[, extra array<long>]."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def packed(g: int) -> pd.DataFrame:
            pdf = pd.concat(held.pop(g))
            vectors = pdf["v"].tolist()
            x = dense(vectors, max(map(len, vectors), default=0))
            kind = next(t for t in ("int16", "int32", "int64") if not x.size or max(-int(x.min()), int(x.max())) <= np.iinfo(t).max)
            extra = b"".join(np.asarray(e, np.int64).tobytes() for e in pdf["extra"]) if "extra" in pdf else b""
            ids, labels = pdf["vec_id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
            return pd.DataFrame({name: [g], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "extra": [extra], "dtype": [kind], "width": [x.shape[1]], "data": [x.astype(kind).tobytes()]})

        for pdf in batches:
            for g, part in pdf.groupby(name):
                held.setdefault(int(g), []).append(part)
                if sum(map(len, held[int(g)])) >= block:
                    yield packed(int(g))
            if sum(len(p) for parts in held.values() for p in parts) >= HELD_ROWS:
                for g in list(held):
                    yield packed(g)
        for g in list(held):
            yield packed(g)

    return rows.mapInPandas(pack, f"{name} int, {PACKED}")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, extra = (np.frombuffer(b, np.int64) for b in (row.ids, row.labels, row.extra))
    return ids, labels, extra.reshape(len(ids), -1), np.frombuffer(row.data, row.dtype).reshape(len(ids), row.width).astype(np.int64)


def _fit_width(x: np.ndarray, width: int) -> np.ndarray:
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Lists:
    """Inverted lists of one group: rows by cluster and vec_id, with a radius for every cluster and for every label's part of it."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, centres: np.ndarray):
        self.centres = _fit_width(centres, x.shape[1])
        home = nearest(x.astype(float), self.centres)
        order = np.lexsort((labels, ids, home))
        self.ids, self.labels, self.x, home = ids[order], labels[order], x[order], home[order]
        self.floats = self.x.astype(float)
        self.most = int(abs(self.x).max(initial=0))
        away = np.sqrt(((self.floats - self.centres[home]) ** 2).sum(1))
        edges = np.arange(len(self.centres) + 1)
        self.start = np.searchsorted(home, edges)
        self.radius = self._largest(away, self.start)
        #: of each label: its rows, where its part of every cluster begins among them, and that part's radius
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for label in np.unique(self.labels):
            own = np.flatnonzero(self.labels == label)
            start = np.searchsorted(home[own], edges)
            self.lists[int(label)] = own, start, self._largest(away[own], start)

    @staticmethod
    def _largest(away: np.ndarray, start: np.ndarray) -> np.ndarray:
        """-1 for an empty list."""
        return np.array([away[i:j].max(initial=-1.0) for i, j in zip(start[:-1], start[1:])])

    def bounds(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that a vector within ``radius`` of each centroid can have, widened by more than rounding can take away."""
        size = np.sqrt((q.astype(float) ** 2).sum(1))[:, None]
        middle, reach = q @ self.centres.T, size * radius
        slack = 1e-9 * (abs(middle) + reach + size * np.sqrt((self.centres**2).sum(1))) + 1e-6
        return middle - reach - slack, middle + reach + slack

    def scores(self, q: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        """Inner products as integers; in float64 while every sum stays below 2 ** 53."""
        if int(abs(q).sum(1).max(initial=0)) * max(self.most, 1) < 1 << 53:
            return (q.astype(float) @ self.floats[rows].T).astype(np.int64)
        return q @ self.x[rows].T


def first_best(score: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest scores in use of every row; of equal ones the first."""
    if score.shape[1] > k:
        masked = np.where(use, score, NO_FLOOR)
        last = np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k][:, None]
        tied = masked == last
        use = use & ((masked > last) | (tied & (np.cumsum(tied, axis=1) <= k)))
    return np.nonzero(use)


def _best(key: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every key, best first."""
    order = np.lexsort((labels, ids, -score, key))
    sorted_ = key[order]
    at = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    return order[at < k]


class Held:
    """The k best candidates of many questions at once."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.key, self.score, self.ids, self.labels = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(n, NO_FLOOR)

    def add(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Candidates as (key, score, ids, labels)."""
        key, score, ids, labels = (np.concatenate(x) for x in zip((self.key, self.score, self.ids, self.labels), *found))
        best = _best(key, score, ids, labels, self.k)
        self.key, self.score, self.ids, self.labels = key[best], score[best], ids[best], labels[best]
        n = np.bincount(self.key, minlength=self.n)
        full = np.flatnonzero(n >= self.k)
        self.floor[full] = self.score[np.cumsum(n)[full] - 1]


def positives(lists: Lists, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> tuple[Held, int]:
    """(best rows of the anchors' own labels, number of inner products)."""
    held, done = Held(len(ids), POSITIVES), 0
    for label in np.unique(labels):
        if int(label) not in lists.lists:
            continue
        own, start, radius = lists.lists[int(label)]
        mine = np.flatnonzero(labels == label)
        most = np.where(radius >= 0, lists.bounds(q[mine], radius)[1], -np.inf)
        order = np.argsort(-most, axis=1, kind="stable")
        for step in range(int((radius >= 0).sum())):
            c = order[:, step]
            open_ = most[np.arange(len(mine)), c] >= held.floor[mine]
            if not open_.any():
                break
            found = []
            for cluster in np.unique(c[open_]):
                who, rows = mine[open_ & (c == cluster)], own[start[cluster] : start[cluster + 1]]
                score = lists.scores(q[who], rows)
                done += score.size
                i, j = first_best(score, (score >= held.floor[who][:, None]) & (lists.ids[rows][None] != ids[who][:, None]), POSITIVES)
                found.append((who[i], score[i, j], lists.ids[rows[j]], lists.labels[rows[j]]))
            held.add(found)
    return held, done


def negatives(lists: Lists, ids: np.ndarray, labels: np.ndarray, windows: np.ndarray, q: np.ndarray) -> tuple[Held, int]:
    """(best rows of other labels in each window of each anchor, keyed by anchor * windows + window; number of inner products).

    ``windows``: (anchors, windows, 2) least and most scores; least above most for none."""
    n, w = windows.shape[:2]
    low, high = windows[:, :, 0], windows[:, :, 1]
    held, done = Held(n * w, NEGATIVES), 0
    there = lists.radius >= 0
    least, most = lists.bounds(q, np.maximum(lists.radius, 0))
    order = np.argsort(np.where(there, -most, np.inf), axis=1, kind="stable")
    for step in range(int(there.sum())):
        c = order[:, step]
        top, bottom = most[np.arange(n), c][:, None], least[np.arange(n), c][:, None]
        going = (low <= high) & (top >= np.maximum(low, held.floor.reshape(n, w)))  # later clusters have smaller bounds
        if not going.any():
            break
        meets = (going & (bottom <= high)).any(1)
        found = []
        for cluster in np.unique(c[meets]):
            who, rows = np.flatnonzero(meets & (c == cluster)), slice(lists.start[cluster], lists.start[cluster + 1])
            score = lists.scores(q[who], rows)
            done += score.size
            other = (lists.labels[rows][None] != labels[who][:, None]) & (lists.ids[rows][None] != ids[who][:, None])
            for k in range(w):
                floor = np.maximum(low[who, k], held.floor[who * w + k])
                i, j = first_best(score, other & (score >= floor[:, None]) & (score <= high[who, k][:, None]), NEGATIVES)
                found.append((who[i] * w + k, score[i, j], lists.ids[rows][j], lists.labels[rows][j]))
        if found:
            held.add(found)
    return held, done


def windows_of(scores: np.ndarray) -> np.ndarray:
    """Integer windows of positives' scores: LEAST p <= 100 s <= MOST p."""
    return np.stack([-((-LEAST * scores) // 100), (MOST * scores) // 100], -1)


def _searched(blocks: DataFrame, tiles: DataFrame, centres: np.ndarray, groups: int, solve, schema: str) -> DataFrame:
    """``solve(lists, tile)`` of every tile on every group; a task's rows are sorted so that a group's candidates come before the tiles."""
    everywhere = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("tiled", F.lit(1)).drop("tile")
    both = blocks.withColumn("tiled", F.lit(0)).unionByName(everywhere)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, parts, lists = None, [], None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.group != group:
                    group, parts, lists = row.group, [], None
                if not row.tiled:
                    parts.append(_unpacked(row))
                    continue
                if lists is None and parts:
                    width = max(p[3].shape[1] for p in parts)
                    lists = Lists(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([_fit_width(p[3], width) for p in parts]), centres)
                    parts = []
                if lists is not None:
                    ids, labels, extra, q = _unpacked(row)
                    yield solve(lists, ids, labels, extra, _fit_width(q, lists.x.shape[1]))

    n = max(partitions(blocks.sparkSession), groups)
    return both.repartition(n, "group").sortWithinPartitions("group", "tiled").mapInPandas(search, schema)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both sides: vec_id, label, v."""
    spark = rows.sparkSession
    rows = settle(rows, "vectors")
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    wanted = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(width or 0, 1))))
    chosen = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 20)) * max(count, 1) < F.lit(wanted // 2 * (1 << 20))
    sample = rows.where(chosen).select("v").limit(wanted).toPandas()["v"].tolist()  # half of the bound is expected
    centres = kmeans(dense(sample, width or 0))

    groups = max(1, -(-count // GROUP_ROWS))
    dealt = F.pmod(F.xxhash64("vec_id", "v", "label"), F.lit(groups)).cast("int")
    blocks = settle(_pack(rows.withColumn("group", dealt), BLOCK_ROWS, "group", groups), "blocks")
    asked = anchors.distinct()
    n = asked.count()
    tiles = max(1, -(-n // TILE_ROWS))
    tile = F.pmod(F.xxhash64("vec_id", "label", "v", F.lit(3)), F.lit(tiles)).cast("int").alias("tile")

    def tiled(df: DataFrame) -> DataFrame:
        return _pack(df.repartition(max(1, min(tiles, partitions(spark))), "tile"), TILE_ROWS, "tile", tiles)

    asked = settle(asked.withColumn("akey", F.xxhash64("label", "v")).withColumn("tile", tile), "anchors")

    def near(lists: Lists, ids, labels, extra, q) -> pd.DataFrame:
        found, _ = positives(lists, ids, labels, q)
        return pd.DataFrame({"anchor_id": ids[found.key], "akey": extra[found.key, 0], "positive_id": found.ids, "positive_score": found.score})

    first = _searched(blocks, tiled(asked.withColumn("extra", F.array("akey"))), centres, groups, near, "anchor_id long, akey long, positive_id long, positive_score long")
    by = Window.partitionBy("anchor_id", "akey").orderBy(F.col("positive_score").desc(), "positive_id")
    first = settle(first.withColumn("place", F.row_number().over(by)).where(F.col("place") <= POSITIVES), "positives")
    listed = first.groupBy(F.col("anchor_id").alias("vec_id"), "akey").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most POSITIVES
    scores = [F.coalesce(F.get("p", i)["positive_score"], F.lit(-1)) for i in range(POSITIVES)]
    second = asked.join(listed, ["vec_id", "akey"]).select("vec_id", "label", "v", "tile", F.array("akey", *scores).alias("extra"))

    def far(lists: Lists, ids, labels, extra, q) -> pd.DataFrame:
        windows = windows_of(extra[:, 1:])
        windows[extra[:, 1:] < 0] = 1, 0  # no window holds a score for a negative one
        found, _ = negatives(lists, ids, labels, windows, q)
        who, place = found.key // POSITIVES, found.key % POSITIVES + 1
        return pd.DataFrame({"anchor_id": ids[who], "akey": extra[who, 0], "place": place, "negative_id": found.ids, "negative_label": found.labels, "negative_score": found.score})

    found = _searched(blocks, tiled(second), centres, groups, far, "anchor_id long, akey long, place int, negative_id long, negative_label long, negative_score long")
    by = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.col("negative_score").desc(), "negative_id", "negative_label")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= NEGATIVES)
    out = settle(best.join(first, ["anchor_id", "akey", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(rows, blocks, asked, first)
    return out
