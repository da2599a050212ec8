"""Token-id output: best-fit-decreasing packing into id matrices (operator 8).

Documents become token ids and one end id; a longer document is cut losslessly into full rows and a
rest.  Pieces are sorted by size, largest first, and each goes to the open row with the least room
that still holds it; a segment tree over rooms finds that row in logarithmic time.  Rows are
emitted with their ids, cumulative segment lengths, position ids that restart with every segment,
and the (doc_id, start) of every segment, from which the token stream of any document can be rebuilt.

Each task packs what it reads in groups of about ``GROUP_TOKENS``; no shuffle is needed.
Defined results: a null or empty text is one segment holding the end id; a null doc_id is carried;
repeated rows are written once each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import text_or_empty
from tremor.llm.tokens import WordIds, default_tokenizer

ROW = 4096
END_ID = 49407
PAD_ID = 0
GROUP_TOKENS = 2 << 20


class RoomTree:
    """Open rows by the room they have left; a segment tree finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= size, removed from the tree."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers, in the order in which they stand in the row."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.push(room - sizes[i], row)
    return rows


SCHEMA = "sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, segment_doc_ids array<long>, segment_starts array<long>"


def packed_rows(docs: DataFrame, tokenizer: str | None = None, row: int = ROW, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """One row per packed sequence; ids and position_ids are little-endian uint16 of ``row`` entries."""
    if row > 1 << 16:
        raise ValueError("positions of a row are 16-bit numbers")
    path = tokenizer or default_tokenizer()

    def emit(pieces: list[tuple], first: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for at, members in enumerate(best_fit_decreasing([len(p[2]) // 2 for p in pieces], row)):
            parts = [pieces[i] for i in members]
            lengths = np.array([len(p[2]) // 2 for p in parts])
            n = int(lengths.sum())
            position = np.zeros(row, "<u2")
            ends = np.cumsum(lengths)
            position[:n] = np.arange(n) - np.repeat(ends - lengths, lengths)
            ids = b"".join(p[2] for p in parts) + np.full(row - n, pad_id, "<u2").tobytes()
            for column, value in zip(out, (first + at, ids, n, [0, *ends.tolist()], position.tobytes(), [p[0] for p in parts], [p[1] for p in parts])):
                column.append(value)
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_ids", "segment_doc_ids", "segment_starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds.of(path, "<u2"), np.array([end_id], "<u2").tobytes()
        base, held, waiting = TaskContext.get().partitionId() << 40, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist()):
                ids = words.ids(text) + end
                for start in range(0, len(ids) // 2, row):
                    waiting.append((doc_id, start, ids[2 * start : 2 * (start + row)]))
                held += len(ids) // 2
                if held >= GROUP_TOKENS:
                    done = emit(waiting, base)
                    base, held, waiting = base + done.num_rows, 0, []
                    yield done
        if waiting:
            yield emit(waiting, base)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the packed id matrices with their segment tables as Parquet."""
    packed_rows(docs, **options).write.parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """A digest row per packed sequence: counts and checksums of the binary columns."""
    return packed.select(
        "sequence_id",
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.size("segment_doc_ids").cast("long").alias("n_segments"),
        "segment_doc_ids",
        "segment_starts",
        "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
    )
