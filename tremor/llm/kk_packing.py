"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing (operator 6).

Every document becomes its token ids and one end id.  Documents longer than a window are cut into
full windows, which stand alone, and a rest; a rest above ``PIECE`` ids is cut there, so that the
differencing has small pieces to balance with.  Rests are dealt at random to shards of bounded size;
in a shard every rest starts as a partial partition of k windows with one filled.  The two partial
partitions with the largest imbalance are merged again and again, largest window onto smallest, so
that imbalances cancel.  When a window of the result exceeds the capacity, k rises by one.

Defined results: a null or empty text is one piece holding the end id; a null doc_id is carried;
repeated rows are packed once each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import settle, text_or_empty
from tremor.llm.tokens import WordIds, default_tokenizer

WINDOW = 4096
END_ID = 2
PIECE = 1024
#: Expected size of a shard: tokens, and pieces where documents are very short.
SHARD_TOKENS = 512 * WINDOW
SHARD_PIECES = 8192


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full windows, then pieces of the rest."""
    whole = n // window * window
    return [(s, window) for s in range(0, whole, window)] + [(s, min(piece, n - s)) for s in range(whole, n, piece)]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, piece: int = PIECE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist()):
                ids = words.ids(text) + end
                n = len(ids) // 4
                for start, length in cuts(n, window, piece):
                    rows.append((doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of every piece after Karmarkar-Karp differencing into k windows."""
    if k == 1 or len(sizes) == 0:
        return np.zeros(len(sizes), np.int64)
    n = len(sizes)
    sums: list[np.ndarray | None] = []
    for s in sizes:
        one = np.zeros(k, np.int64)
        one[0] = s
        sums.append(one)
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]  # each is sorted, largest first: opposing imbalances meet
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both - both[-1])
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0] - both[-1]), n + len(merges) - 1))
    window: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k)}
    out = np.zeros(n, np.int64)
    for node in range(n + len(merges) - 1, -1, -1):
        at = window.pop(node)
        if node < n:
            out[node] = at[0]
            continue
        a, b, order = merges[node - n]
        left = np.empty(k, np.int64)
        left[order] = at
        window[a], window[b] = left, left[::-1]
    return out


def pack_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of all pieces, none above the capacity; the number of windows rises until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max() <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = settle(token_pieces(docs, tokenizer or default_tokenizer(), window, end_id).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    total = pieces.where(F.col("length") < window).agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-total[0] // SHARD_TOKENS), -(-total[1] // SHARD_PIECES))
    whole = pieces.where(F.col("length") >= window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(1 << 62) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", kind="stable").reset_index(drop=True)
        at = pack_shard(pdf["length"].to_numpy(np.int64), window)
        pdf["sequence_id"] = pdf["shard"].to_numpy(np.int64) * (1 << 24) + at
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    rests = pieces.where(F.col("length") < window).withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards).cast("long")))
    packed = rests.groupBy("shard").applyInPandas(shard, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return whole.unionByName(packed)
