"""Exact dedup with a sharded cuckoo-filter index (operator 3).

Texts are compared after deleting every ASCII white-space character.  Each input task combines its
own rows; the normalised SHA-256 digest deals these partial groups to shards, whose index merges them.  Each shard keeps a cuckoo filter of 16-bit fingerprints over buckets that
also hold the full digests, so every filter hit is verified before it counts.  A bucket overflow
doubles the table and re-inserts from the stored keys.  Digests can be deleted again.

Defined results: a null text counts as empty; empty texts are equal to one another; ties in length go
to the smallest doc_id, a null doc_id after all others; a repeated row counts as one more member of
its group, and one of them stays; extra columns pass through ``exact_dedup`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import once_each, partitions, rows_of, settle, text_key, text_or_empty

#: Deleted before comparing: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: An input task sends its partial groups on when it holds so many.
HELD_GROUPS = 100_000


class CuckooIndex:
    """Cuckoo filter whose slots keep the full key, so that it can verify, delete and grow."""

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, capacity: int = 64):
        self.bits = max(4, (max(1, capacity) * 4 // (3 * self.SLOTS)).bit_length())
        self._empty()

    def _empty(self) -> None:
        n = 1 << self.bits
        self.fingerprints = [0] * (n * self.SLOTS)
        self.keys: list[bytes | None] = [None] * (n * self.SLOTS)
        self.values: list = [None] * (n * self.SLOTS)
        self.count = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(key[8:10], "big") or 1
        one = int.from_bytes(key[:8], "big") & ((1 << self.bits) - 1)
        return fingerprint, one, self._other(one, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ ((fingerprint * 0x5BD1E995) & ((1 << self.bits) - 1))

    def _slot(self, key: bytes) -> int:
        """The slot of a live key, or -1: fingerprints first, then the stored digest verifies the hit."""
        fingerprint, one, two = self._places(key)
        for bucket in (one, two) if one != two else (one,):
            at = bucket * self.SLOTS
            for slot in range(at, at + self.SLOTS):
                if self.fingerprints[slot] == fingerprint and self.keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._slot(key)
        return None if slot < 0 else self.values[slot]

    def put(self, key: bytes, value) -> None:
        """Insert a key or replace the value of a live one."""
        slot = self._slot(key)
        if slot >= 0:
            self.values[slot] = value
            return
        item = (key, value)
        while (item := self._place(*item)) is not None:
            self._grow()

    def _place(self, key: bytes, value) -> tuple | None:
        fingerprint, one, two = self._places(key)
        bucket = one
        for kick in range(self.MAX_KICKS):
            for b in (one, two) if kick == 0 else (bucket,):
                at = b * self.SLOTS
                for slot in range(at, at + self.SLOTS):
                    if self.keys[slot] is None:
                        self.fingerprints[slot], self.keys[slot], self.values[slot] = fingerprint, key, value
                        self.count += 1
                        return None
            if kick == 0:
                bucket = two
            victim = bucket * self.SLOTS + kick % self.SLOTS
            fingerprint, self.fingerprints[victim] = self.fingerprints[victim], fingerprint
            key, self.keys[victim] = self.keys[victim], key
            value, self.values[victim] = self.values[victim], value
            bucket = self._other(bucket, fingerprint)
        return key, value

    def _grow(self) -> None:
        """Overflow: double the table and insert every stored key again."""
        kept = list(self.items())
        while True:
            self.bits += 1
            self._empty()
            if all(self._place(k, v) is None for k, v in kept):
                return

    def delete(self, key: bytes) -> bool:
        slot = self._slot(key)
        if slot < 0:
            return False
        self.fingerprints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.count -= 1
        return True

    def items(self) -> Iterator[tuple]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)

    def __len__(self) -> int:
        return self.count


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest binary, n_points (code points of the original text), text_key of every row."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        text_key().alias("text_key"),
        F.unhex(F.sha2(F.translate(text, WHITE_SPACE, "").cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_points"),
    )


GROUP = "digest binary, n_points long, doc_id long, missing boolean, size long"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(digest, n_points, doc_id, missing) rows of one input task come out once per digest and flush, with their number."""
    held: dict[bytes, tuple] = {}

    def out() -> pd.DataFrame:
        rows = [(k, -best[0], best[2], best[1], size) for k, (best, size) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["digest", "n_points", "doc_id", "missing", "size"])

    for pdf in batches:
        for key, points, doc_id, missing in zip(pdf["digest"], pdf["n_points"].tolist(), pdf["doc_id"].tolist(), pdf["missing"].tolist()):
            best, size = held.get(key, ((-points, missing, doc_id), 0))
            held[key] = min(best, (-points, missing, doc_id)), size + 1
        if len(held) >= HELD_GROUPS:
            yield out()
    if held:
        yield out()


def _index_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One shard: partial groups meet in the cuckoo index and come out one per live digest."""
    index = CuckooIndex()
    for pdf in batches:
        for digest, points, doc_id, missing, size in zip(pdf["digest"], pdf["n_points"], pdf["doc_id"], pdf["missing"], pdf["size"]):
            key, new = bytes(digest), (-int(points), bool(missing), 0 if missing else int(doc_id))
            held = index.get(key)
            index.put(key, (new, int(size)) if held is None else (min(held[0], new), held[1] + int(size)))
    rows = [(k, None if best[1] else best[2], -best[0], size) for k, (best, size) in index.items()]
    for i in range(0, len(rows), 10_000):
        out = pd.DataFrame(rows[i : i + 10_000], columns=["digest", "keep_id", "keep_points", "group_size"])
        out["keep_id"] = out["keep_id"].astype("Int64")
        yield out


def partials(digest_rows: DataFrame) -> DataFrame:
    """The groups of each input task by themselves, so that a hot text sends a row or a few per task to its shard."""
    flat = digest_rows.select("digest", "n_points", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"))
    return flat.mapInPandas(_combine, GROUP)


def groups(digest_rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_points, group_size of every distinct digest: partial groups are dealt by digest and merged by each shard's index."""
    dealt = partials(digest_rows).repartition(partitions(digest_rows.sparkSession), "digest")
    return dealt.mapInPandas(_index_shard, "digest binary, keep_id long, keep_points long, group_size long")


def _judged(docs: DataFrame) -> DataFrame:
    """The rows of ``digests`` beside their group."""
    rows = settle(digests(docs), "digests")
    return rows.join(groups(rows), "digest")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too.

    Of several texts of one doc_id in a group only the longest is kept; rows of one doc_id whose texts are equally long are kept together."""
    return _judged(docs).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, one per group, with all their columns; rows without a doc_id and several texts of one doc_id count by their texts."""
    best = _judged(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
    kept = best.groupBy("digest").agg(F.first("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"))
    return once_each(rows_of(docs, kept))


def apply_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Keep a stored index of live digests current: ``changes`` has op ('insert' or 'delete'), digest and, to order them, seq.

    Both tables are dealt by digest; each shard fills its filter from the stored keys and replays the changes by seq
    (inserts before deletes where seq is equal, null or no column).  Deleting an unknown digest is a no-op,
    inserting a live one too; null digests are left out.  Returns the live digests."""
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0)) if "seq" in changes.columns else F.lit(0).cast("long")
    stored = index.select("digest", F.lit(None).cast("long").alias("seq"), F.lit(False).alias("gone"))
    both = stored.unionByName(changes.select("digest", seq.alias("seq"), (F.col("op") == "delete").alias("gone"))).where(F.col("digest").isNotNull())

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live = CuckooIndex()
        for pdf in batches:
            for digest, gone in zip(pdf["digest"], pdf["gone"]):
                live.delete(bytes(digest)) if gone else live.put(bytes(digest), True)
        yield pd.DataFrame({"digest": [k for k, _ in live.items()]}, columns=["digest"])

    dealt = both.repartition(partitions(index.sparkSession), "digest").sortWithinPartitions(F.col("seq").asc_nulls_first(), "gone")
    return dealt.mapInPandas(replay, "digest binary")
