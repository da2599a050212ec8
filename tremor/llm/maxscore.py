"""Exact top-k inner-product search with MaxScore over sharded postings (operator 5).

A vector's components are its terms.  Candidates are packed into shards of ``SHARD_ROWS`` vectors; a shard is halved along its
main direction until its blocks hold at most ``BLOCK_ROWS`` alike vectors.  A block keeps postings and the smallest and largest value per term,
so for a query every term has a least and a greatest contribution in a block, also where these are negative.
A block whose greatest contributions together stay below the query's floor, the k-th score it has reached so far, is skipped.
In the others a query's terms are sorted by the spread of their contributions.  The longest run of smallest spreads that cannot lift a
candidate to the floor, were all other terms at their least, is non-essential.  Only the postings of essential terms are
traversed; the others are probed ``PROBES`` terms at a time, largest spread first, and only for candidates that can still compete.

The first shard, a bounded sample of the candidates, is searched first: its results stay and give every query its first floor, which rises from block
to block.  The other shards stay where they are: blocks of queries with their floors are sent to all of them, at most ``SENT_BYTES`` at a
time; what a step finds is written before the next one is sent, so neither plan nor driver grows with the queries.
Shard results are merged by score and vec_id.

Defined results: vectors that are null, or hold null or non-finite components, take no part; shorter
vectors count as padded with zeros; of repeated vec_ids every row counts; ties go to the smaller
vec_id; a query never meets rows of its own vec_id; fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import discard, partitions, scratch_path, settle

SHARD_ROWS = 4096
BLOCK_ROWS = 2048
QUERY_ROWS = 2048
#: Non-essential terms that are probed between two looks at who can still compete.
PROBES = 8
#: Bytes of packed queries that are collected and broadcast together.
SENT_BYTES = 16 << 20
NO_FLOOR = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<long> = floor(scale * x) of every vector that takes part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def _pack(rows: DataFrame, block, block_name: str) -> DataFrame:
    """Rows packed into one binary row per block: ids and values as little-endian arrays."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for b, part in pdf.groupby("block"):
                held.setdefault(int(b), []).append((part["vec_id"].to_numpy(np.int64), list(part["v"])))
        for b, parts in held.items():
            ids = np.concatenate([p[0] for p in parts])
            vectors = [v for p in parts for v in p[1]]
            width = max((len(v) for v in vectors), default=0)
            dense = np.zeros((len(ids), width), np.int64)
            for i, v in enumerate(vectors):
                dense[i, : len(v)] = v
            order = np.argsort(ids, kind="stable")
            yield pd.DataFrame({block_name: [b], "ids": [ids[order].tobytes()], "values": [dense[order].tobytes()], "width": [width]})

    n = partitions(rows.sparkSession)
    return rows.withColumn("block", block).repartition(n, "block").mapInPandas(pack, f"{block_name} long, ids binary, values binary, width int")


class Block:
    """Postings of some candidates, as one dense row per term; sums of products below 2 ** 53 are exact in float64."""

    def __init__(self, ids: np.ndarray, dense: np.ndarray):
        self.ids = ids
        self.low, self.high = (dense.min(0), dense.max(0)) if len(ids) else (dense.sum(0), dense.sum(0))
        self.columns = np.ascontiguousarray(dense.T)
        self.floats = self.columns.astype(np.float64)
        self.largest = int(np.maximum(np.abs(self.low), np.abs(self.high)).max(initial=0))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the most that a term adds to the score of any candidate here, for every query and term."""
        a, b = queries * self.low, queries * self.high
        return np.minimum(a, b), np.maximum(a, b)

    def postings(self, query: np.ndarray) -> np.ndarray:
        """Postings in a type that is exact for this query."""
        return self.floats if int(np.abs(query).sum()) * self.largest < 1 << 53 else self.columns


def split_terms(least: np.ndarray, most: np.ndarray, floor: int) -> tuple[np.ndarray, int]:
    """(terms by spread, smallest first; how many of them are non-essential): the longest run that stays below the floor where all other terms are at their least."""
    spread = most - least
    order = np.argsort(spread, kind="stable")
    return order, int(np.searchsorted(least.sum() + np.cumsum(spread[order]), floor, "left"))


def search_block(block: Block, query: np.ndarray, least: np.ndarray, most: np.ndarray, floor: int, work: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the candidates of a block whose score reaches the floor; ``work[0]`` counts multiplications."""
    order, split = split_terms(least, most, floor)
    postings, rows = block.postings(query), len(block.ids)
    weights = query.astype(postings.dtype)
    essential, rest = order[split:], order[:split][::-1]
    score = (weights[essential] @ postings[essential]).astype(np.int64)
    work[0] += len(essential) * rows
    touched, left = np.arange(rows), int(most[rest].sum())
    for at in range(0, len(rest), PROBES):
        keep = score + left >= floor
        touched, score = touched[keep], score[keep]
        if not len(touched):
            break
        terms = rest[at : at + PROBES]
        # where most candidates still compete, whole postings are cheaper to read than parts of them
        probed = (weights[terms] @ postings[terms])[touched] if 2 * len(touched) > rows else weights[terms] @ postings[np.ix_(terms, touched)]
        work[0] += len(terms) * (rows if 2 * len(touched) > rows else len(touched))
        score = score + probed.astype(np.int64)
        left -= int(most[terms].sum())
    keep = score >= floor
    return touched[keep], score[keep]


def _halves(dense: np.ndarray, at: np.ndarray, rows: int) -> list[np.ndarray]:
    """Positions in parts of at most ``rows`` alike vectors: halved along the main direction, ties by position."""
    done, todo = [], [at]
    while todo:
        part = todo.pop()
        if len(part) <= rows:
            done.append(part)
            continue
        x = dense[part].astype(np.float64)
        x -= x.mean(0)
        x /= max(np.abs(x).max(initial=0.0), 1.0)
        way = x[np.argmax((x * x).sum(1))] if x.shape[1] else np.zeros(0)
        for _ in range(8):
            way = x.T @ (x @ way)
            way /= np.linalg.norm(way) or 1.0
        by = part[np.argsort(x @ way, kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2 :]]
    return done


def blocks_of(ids: np.ndarray, dense: np.ndarray, rows: int = BLOCK_ROWS) -> list[Block]:
    """Candidates in blocks of alike vectors, the block of the longest ones first."""
    parts = [p for p in _halves(dense, np.arange(len(ids)), rows) if len(p)]
    length = (dense.astype(np.float64) ** 2).sum(1)
    return [Block(ids[p], dense[p]) for p in sorted(parts, key=lambda p: -length[p].max())]


def _widened(queries: np.ndarray, width: int) -> np.ndarray:
    """The terms that candidates of ``width`` components can have."""
    return queries[:, :width] if queries.shape[1] >= width else np.pad(queries, ((0, 0), (0, width - queries.shape[1])))


def best_of(blocks: list[Block], q_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray, work: list[int] | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """(query_id, vec_id, score of up to k best candidates of each query that reach its floor, raised floors)."""
    raised, work = floors.copy(), [0] if work is None else work
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    for block in blocks:
        q = _widened(queries, len(block.low))
        least, most = block.bounds(q)
        for i in np.flatnonzero(most.sum(1) >= raised):
            at, score = search_block(block, q[i], least[i], most[i], int(raised[i]), work)
            other = block.ids[at] != q_ids[i]
            if not other.any():
                continue
            ids, score = np.concatenate([held[i][0], block.ids[at[other]]]), np.concatenate([held[i][1], score[other]])
            if len(score) > k:
                best = score >= np.partition(score, len(score) - k)[len(score) - k]
                ids, score = ids[best], score[best]
            by = np.lexsort((ids, -score))[:k]
            held[i] = ids[by], score[by]
            if len(by) == k:
                raised[i] = max(raised[i], held[i][1][-1])
    rows = {"query_id": np.repeat(q_ids, [len(x) for x, _ in held]), "vec_id": np.concatenate([x for x, _ in held] or [[]]), "score": np.concatenate([x for _, x in held] or [[]])}
    return pd.DataFrame(rows).astype(np.int64), raised


def _unpacked(ids: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids_ = np.frombuffer(ids, np.int64)
    return ids_, np.frombuffer(values, np.int64).reshape(len(ids_), width)


def _first_shard(asked: DataFrame, sample: list, k: int) -> DataFrame:
    """The packed queries with what they find in one shard and the floors that this gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = blocks_of(*_unpacked(*sample[0])) if sample else []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                q_ids, queries = _unpacked(row.ids, row.values, row.width)
                found, floors = best_of(blocks, q_ids, queries, k, np.full(len(q_ids), NO_FLOOR))
                rows = [found[["query_id", "vec_id", "score"]].to_dict("records")]
                yield pd.DataFrame({"query_block": [row.query_block], "ids": [row.ids], "values": [row.values], "width": [row.width], "floors": [floors.tobytes()], "found": rows})

    return asked.mapInPandas(run, "query_block long, ids binary, values binary, width int, floors binary, found array<struct<query_id: long, vec_id: long, score: long>>")


def _search_step(shards: DataFrame, sent: list, k: int, path: str) -> None:
    """Add query_id, vec_id, score of the candidates of every shard that reach the floors of the queries sent to the table at ``path``."""
    queries = shards.sparkSession.sparkContext.broadcast([(r["ids"], r["values"], r["width"], r["floors"]) for r in sent])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [(*_unpacked(*q[:3]), np.frombuffer(q[3], np.int64)) for q in queries.value]
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                blocks = blocks_of(*_unpacked(row.ids, row.values, row.width))
                for i, (q_ids, values, floors) in enumerate(asked):
                    found, raised = best_of(blocks, q_ids, values, k, floors)
                    asked[i] = q_ids, values, raised
                    yield found

    shards.mapInPandas(search, FOUND).write.mode("append").option("compression", "zstd").parquet(path)
    queries.unpersist()


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query; both sides: vec_id, v array<long>."""
    spark = candidates.sparkSession
    n, nq = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-nq // query_rows))
    packed = settle(_pack(candidates, F.pmod(F.xxhash64("vec_id"), F.lit(shards)), "shard"), "shards")
    asked = _pack(queries, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)), "query_block")
    sample = [tuple(r) for r in packed.where("shard = 0").select("ids", "values", "width").collect()]  # about shard_rows vectors
    asked = settle(_first_shard(asked, sample, k), "queries")
    found = asked.select(F.explode("found").alias("f")).select("f.*")
    if shards > 1:
        size = asked.agg(F.max(F.length("values") + F.length("ids"))).first()[0] or 1
        step, path = max(1, SENT_BYTES // size), scratch_path(spark, "found")
        for at in range(0, blocks, step):
            sent = asked.where(F.col("query_block").between(at, at + step - 1)).drop("found").collect()  # at most SENT_BYTES, or one block
            _search_step(packed.where("shard <> 0"), sent, k, path)
        found = found.unionByName(spark.read.schema(FOUND).parquet(path))
    discard(packed)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
