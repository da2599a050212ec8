"""Removal of byte spans that repeat across documents, by a distributed suffix array (operator 7).

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller doc_id is
removed.  All windows of ``LENGTH`` bytes are judged on the input texts.

1. Anchors.  The least hash among the ``GRAM``-byte grams of a window is its anchor, so equal windows
   have equal anchors.  Neighbouring windows with one anchor form a unit.  Units are dealt by anchor as
   packed arrays; of equal units in one deal of about 4 MB of text only those of its least document
   travel, the others are removed there.  Of an anchor that lies in several documents, equal units are told by their hashes:
   every occurrence outside the smallest document is removed whole.  Where different units meet under
   one anchor, windows may be shared in part.  A shared window reaches half of its other bytes to
   the left or to the right of the anchor, so both units agree on the hash of one of these sides; only
   such stretches, once each, go on.
2. Suffix arrays.  Equal windows have one anchor, so the open stretches are dealt by anchor again, now
   with their bytes, and every bucket is a suffix-sorting problem of its own.  It is solved by the
   difference-cover algorithm: sampled positions (1 and 2 modulo 3) are sorted by their triples and
   named, the names are sorted by recursion, the remaining suffixes follow from the next rank, and the
   two orders are merged.
3. Neighbours in suffix order are compared on their first ``LENGTH`` bytes; a run of equal prefixes has a
   smallest document, and its windows elsewhere are removed.

Defined results: a null or empty text has nothing to remove; texts shorter than ``LENGTH`` bytes keep
all; rows with a null doc_id keep all and remove nothing elsewhere; repeated rows of one doc_id are
one document's and do not remove from each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import textbytes as tb
from tremor.llm.common import settle, text_or_empty
from tremor.llm.dealing import DEAL_BYTES, batch_of, buckets, by_bucket, pack_by
from tremor.llm.suffix_array import least_owner

LENGTH = 50
GRAM = 20
_POSITION_BITS = 24
_SEGMENT = 1 << 21
#: Suffix-sorting problems per bucket of anchors.
FINER = 8
#: How a unit travels; sorted by document and place, so differences are small.
UNIT = {"anchor": "<u4", "unit": "<u8", "first": "<u4", "windows": "u1", "left": "<u2", "right": "<u2", "doc": "<i8"}
STEPS = ("first", "doc")
#: Windows that a task has already found in a smaller document of its own; they travel beside the units.
GONE = {"gone_doc": "<i8", "gone_first": "<u4", "gone_windows": "u1"}


def _units(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, unit hash, left hash, right hash) of the units of a chunk.

    ``ends``: where the document of each byte ends.  A side's hash is 0 where no window of the unit reaches so far."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.uint16, np.uint16))
    if n < length:
        return none
    prefix = tb.prefix_hash(data)
    at = np.arange(n - gram + 1)
    hashed = tb.mix(tb.span_hash(prefix, at, at + gram))
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = (hashed & ~low) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < width:
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    start = np.arange(n - length + 1)
    inside = start + length <= ends[: len(start)]
    start, anchor = start[inside], (key[inside] & low).astype(np.int64)
    if not len(start):
        return none
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
    windows = np.diff(np.append(begin, len(start)))
    first = start[begin]
    unit = tb.mix(tb.span_hash(prefix, first, first + windows + length - 1), 3) + windows.astype(np.uint64)
    anchor, last = anchor[begin], first + windows - 1
    side = (length - gram + 1) // 2
    sides = []
    for reaches, a, b in ((anchor - first >= side, anchor - side, anchor + gram), (last + length - anchor - gram >= side, anchor, anchor + gram + side)):
        a, b = np.where(reaches, a, 0), np.where(reaches, b, 0)
        sides.append(np.where(reaches, (tb.mix(tb.span_hash(prefix, a, b), 9) >> np.uint64(48)) | np.uint64(1), np.uint64(0)).astype(np.uint16))
    # the least of many hashes is small: mixed again, anchors spread evenly over the buckets
    return first, windows, tb.mix(hashed[anchor], 17), unit, *sides


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, end document, first byte, end byte); long documents in overlapping segments."""
    for i, j in tb.chunks(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= _SEGMENT:
            yield i, j, a, b
        else:
            for s in range(a, b, _SEGMENT):
                yield i, j, s, min(b, s + _SEGMENT + LENGTH - 1)


def _dealt_units(docs: DataFrame, n_buckets: int, length: int, gram: int) -> DataFrame:
    def send(held: list[dict]) -> Iterator[pa.RecordBatch]:
        """Of equal units, those of the least document here go on; the others are told now, so a hot passage sends one row per deal."""
        a = {k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])}
        order = np.lexsort((a["doc"], a["unit"]))
        new = _first_of_runs(a["unit"][order])
        gone = np.zeros(len(order), bool)
        gone[order] = a["doc"][order] > a["doc"][order][new][np.cumsum(new) - 1]
        for take, kinds, names in ((~gone, UNIT, {k: k for k in UNIT}), (gone, GONE, {"gone_doc": "doc", "gone_first": "first", "gone_windows": "windows"})):
            of = {k: a[v][take] for k, v in names.items()}
            bucket = a["bucket"][take] if kinds is UNIT else (tb.mix(of["gone_doc"].view(np.uint64), 5) % np.uint64(n_buckets)).astype(np.int32)
            batch = pack_by(bucket, n_buckets, of, STEPS)
            empty = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), *(batch.column(k) if k in names else empty for k in (UNIT | GONE))], ["bucket", *UNIT, *GONE])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = tb.string_buffers(batch.column(1))
            for i, j, a, b in _pieces(offsets):
                bounds = np.clip(offsets[i : j + 1], a, b) - a
                sizes = np.diff(bounds)
                first, windows, anchor, unit, left, right = _units(data[a:b], np.repeat(bounds[1:], sizes), length, gram)
                doc = np.repeat(np.arange(i, j), sizes)[first]
                values = (anchor, unit, first + a - offsets[doc], windows, left, right, ids[doc])
                bucket = (anchor >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)
                held.append({"bucket": bucket.astype(np.int32)} | {k: v.astype(kind) for (k, kind), v in zip(UNIT.items(), values)})
                size += b - a
                if size >= DEAL_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    kinds = "bucket long, " + ", ".join(f"{k} binary" for k in (UNIT | GONE))
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(deal, kinds)


def _first_of_runs(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _judge(a: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(doc, first, windows, open, anchor) of the units to remove (open False) or to compare further (open True)."""
    doc = a["doc"]
    order = np.argsort(a["anchor"], kind="stable")
    anchor = a["anchor"][order]
    begin = np.flatnonzero(_first_of_runs(anchor))
    d = doc[order]
    several = np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin)
    order = order[np.repeat(several, np.diff(np.append(begin, len(anchor))))]
    anchor, unit, d = a["anchor"][order], a["unit"][order], doc[order]
    again = np.lexsort((d, unit, anchor))
    order, anchor, unit, d = order[again], anchor[again], unit[again], d[again]
    if not len(order):
        return d, d, d, d.astype(bool), anchor
    new_unit = _first_of_runs(anchor, unit)
    unit_at = np.cumsum(new_unit) - 1
    least = d[new_unit][unit_at]  # sorted by document within a unit
    # of the distinct units of an anchor, those that agree with another one on a side
    alike = np.zeros(int(unit_at[-1]) + 1, bool)
    for name in ("left", "right"):
        side = a[name][order][new_unit].astype(np.uint64)
        key = anchor[new_unit].astype(np.uint64) << np.uint64(16) | side
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        alike |= (count[at] > 1) & (side > 0)
    remove, compare = d > least, (d == least) & alike[unit_at]
    take = remove | compare
    rows = order[take]
    return d[take], a["first"][rows].astype(np.int64), a["windows"][rows].astype(np.int64), compare[take], anchor[take]


def _merge(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) ranges of the union, flat."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return np.column_stack([start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]]).ravel()


_RANGES = {"doc": "<i8", "first": "<u4", "windows": "u1", "open": "u1", "anchored": "<u4"}


def _to_documents(n_buckets: int):
    """Packs (doc, first, windows, open, anchored) by bucket of the document."""

    def pack(doc: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        to = (tb.mix(doc.view(np.uint64), 5) % np.uint64(n_buckets)).astype(np.int64)
        return pack_by(to, n_buckets, {k: v.astype(kind) for (k, kind), v in zip(_RANGES.items(), (doc, *rest))})

    return pack


def _by_document(ranges: DataFrame) -> DataFrame:
    """doc_id, removed (merged ranges of window starts), compared (first, windows, bucket of open units)."""

    def gather(_: int, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(a["doc"], kind="stable")
        doc, first, windows = a["doc"][order], a["first"][order].astype(np.int64), a["windows"][order].astype(np.int64)
        open_, anchored = a["open"][order].astype(bool), a["anchored"][order].astype(np.int64)
        begin = np.append(np.flatnonzero(_first_of_runs(doc)), len(doc))
        rows = []
        for i, j in zip(begin[:-1], begin[1:]):
            o, f, w = open_[i:j], first[i:j], windows[i:j]
            rows.append((int(doc[i]), _merge(f[~o], f[~o] + w[~o]).tobytes(), np.column_stack([f[o], w[o], anchored[i:j][o]]).astype(np.int32).tobytes()))
        ids, removed, compared = zip(*rows) if rows else ((), (), ())
        yield batch_of({"doc_id": (list(ids), pa.int64()), "removed": (list(removed), pa.binary()), "compared": (list(compared), pa.binary())})

    return by_bucket(ranges, "bucket", _RANGES, gather, "doc_id long, removed binary, compared binary")


_RANGE_KINDS = "bucket long, " + ", ".join(f"{k} binary" for k in _RANGES)


def window_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, removed, compared of the documents that share an anchor with another one."""
    n_buckets = buckets(docs.sparkSession)

    def judge(bucket: int, a: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        gone = [a.pop(k).astype(np.int64) for k in GONE]
        none = np.zeros(len(gone[0]), np.int64)
        *found, anchor = _judge(a)
        found.append(bucket * FINER + (anchor.astype(np.int64) * FINER >> 32))
        return tuple(np.concatenate(x) for x in zip(found, (*gone, none.astype(bool), none)))

    units = _dealt_units(docs, n_buckets, length, gram)
    return _by_document(by_bucket(units, "bucket", UNIT | GONE, judge, _RANGE_KINDS, STEPS, _to_documents(n_buckets)))


def compared_ranges(docs: DataFrame, ranges: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, removed of the windows that the suffix arrays of the open stretches tell to remove."""
    n_buckets = buckets(docs.sparkSession)
    fields = {"doc": "<i8", "first": "<u4", "windows": "u1", "texts": "u1"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            held: dict[int, list] = {}
            for i, packed in enumerate(batch.column(2)):
                for first, windows, bucket in np.frombuffer(packed.as_buffer(), np.int32).reshape(-1, 3).tolist():
                    at = int(offsets[i]) + first
                    if at + windows + length - 1 <= offsets[i + 1]:
                        held.setdefault(bucket, []).append((ids[i], first, windows, data[at : at + windows + length - 1].tobytes()))
            out: dict[str, list] = {k: [] for k in ("bucket", *fields)}
            for bucket, rows in held.items():
                doc, first, windows, texts = zip(*rows)
                for k, v in zip(out, (bucket, np.array(doc, "<i8").tobytes(), np.array(first, "<u4").tobytes(), np.array(windows, "u1").tobytes(), b"".join(texts))):
                    out[k].append(v)
            yield batch_of({k: (v, pa.int64() if k == "bucket" else pa.binary()) for k, v in out.items()})

    def sort(_: int, a: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        offsets = np.concatenate([[0], np.cumsum(a["windows"].astype(np.int64) + length - 1)])
        text, start, least = least_owner(a["texts"], offsets, a["doc"], length)
        gone = a["doc"][text] > least
        text, start = text[gone], start[gone]
        one = np.ones(len(text), np.int64)
        return a["doc"][text], a["first"][text].astype(np.int64) + start, one, 0 * one, 0 * one

    wanted = ranges.where(F.length("compared") > 0).select(F.col("doc_id").alias("at"), "compared")
    dealt = docs.join(wanted, docs["doc_id"] == wanted["at"]).select("doc_id", "text", "compared").mapInArrow(cut, "bucket long, " + ", ".join(f"{k} binary" for k in fields))
    return _by_document(by_bucket(dealt, "bucket", fields, sort, _RANGE_KINDS, finish=_to_documents(n_buckets))).select("doc_id", "removed")


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, removed: starts of the windows to remove, as packed int64 [start, end) pairs in one or two binaries."""
    ranges = settle(window_ranges(docs, length, gram), "ranges")
    return settle(ranges.select("doc_id", "removed").unionByName(compared_ranges(docs, ranges, length)).where(F.length("removed") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list("removed")).alias("removed")), "removed")


def strip_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (remaining bytes), spans (maximal removed byte runs as flat [start, end) pairs) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    gone = removed_ranges(texts, length, gram)
    gone = gone.select(F.col("doc_id").alias("at"), "removed")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.string_buffers(batch.column(1))
            kept, spans = [], []
            for i, packed in enumerate(batch.column(2)):
                text = data[offsets[i] : offsets[i + 1]]
                ranges = np.concatenate([np.frombuffer(p.as_buffer(), np.int64) for p in packed.values]).reshape(-1, 2) if packed.is_valid and len(packed) else np.zeros((0, 2), np.int64)
                runs = _merge(ranges[:, 0], ranges[:, 1] + length - 1)
                stay = np.ones(len(text), bool)
                for s, e in runs.reshape(-1, 2):
                    stay[s:e] = False
                kept.append(text[stay].tobytes())
                spans.append(runs.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "kept", "spans"])

    joined = texts.join(gone, texts["doc_id"] == gone["at"], "left").select("doc_id", "text", "removed")
    return joined.mapInArrow(strip, "doc_id long, kept binary, spans array<long>")


def digests(stripped: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``strip_repeats``."""
    lengths = F.expr("aggregate(spans, 0L, (s, x) -> x - s)")  # alternating sum of starts and ends
    removed = F.when(F.size("spans") > 0, lengths).otherwise(F.lit(0).cast("long"))
    return stripped.select(
        "doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
