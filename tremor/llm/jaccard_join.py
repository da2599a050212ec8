"""N-gram Jaccard join (operator 10): documents link when their shingle sets have Jaccard >= 0.8.

1. Every text becomes its set of 64-bit shingle hashes.  Equal sets form a class with one
   representative, so exact copies cost nothing further.
2. A set can only meet another when at least 80 % of its shingles also occur in another class.  All
   shingles are dealt to buckets once, as packed arrays, to count that; most classes end here.
3. Tiles: the surviving sets are listed under their rarest shingles (as many as a match must reach) and their size band.
   Bands are geometric, a little wider than the sizes that can match (ratio 0.8 to 1.25), and a set stands in its own and the next one, so
   sizes that can match share a tile.  There a 1024-bit parity bitmap per
   set bounds the overlap from above: |A & B| <= (|A| + |B| - bits(A ^ B)) / 2.
   What passes is verified by an exact intersection of the sorted arrays.
4. The result is the component of every document, so tiles need not emit all pairs of a large group:
   first every set meets only hubs of its tiles, and links found become components; then only pairs
   that still lie in different components are taken from the tiles, all of them.

Defined results: null or empty texts have an empty set and link with nothing; a shorter text is one
shingle; repeated rows are copies, and one of them stays; of several texts of one doc_id, the first in byte
order is compared in its name; a row with a null doc_id belongs to the component of its copies, else to none of its own; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm import textbytes as tb
from tremor.llm.common import broadcast_if_small, discard, hot_keys, once_each, rows_of, settle, split_join, text_key, text_or_empty
from tremor.llm.components import components
from tremor.llm.dealing import DEAL_BYTES, buckets, by_bucket, pack_by

SHINGLE = 5
#: Similarity as a fraction: PER_CENT * |A & B| >= 80 * |A | B|.
SIMILAR = 80
BITMAP_WORDS = 16
#: Ratio of neighbouring size bands; above 1.25, so that rounding cannot part sizes that may match.
BAND = 1.26
HUB_ROUNDS = 2
#: Sets of one tile that are compared in one place; larger tiles are split into blocks that meet two by two.
TILE_ROWS = 512


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes by document and value, document of each, set sizes, two digests of each set)."""
    n_docs = len(offsets) - 1
    h, doc = tb.distinct_sets(*tb.shingles(*tb.word_hashes(data, offsets), n_docs, size))
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    some = n > 0
    one, two = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    if len(h):
        one[some] = np.add.reduceat(tb.mix(h, 11), first[some])
        two[some] = np.add.reduceat(tb.mix(h, 13), first[some])
    return h, doc, n, one, two


def _chunks(batch: pa.RecordBatch, column: int, limit: int):
    data, offsets = tb.string_buffers(batch.column(column))
    for i, j in tb.chunks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def set_digests(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, one, two, text_key of every row; equal sets have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _chunks(batch, 1, tb.CHUNK_BYTES):
                _, _, n, one, two = _sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column(2).slice(i, j - i)], ["doc_id", "n_shingles", "one", "two", "text_key"])

    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(run, "doc_id long, n_shingles long, one long, two long, text_key long")


#: The class of shingles that a whole deal sends, and a count that is not told.
NO_CLASS, UNKNOWN = 0xFFFFFFFFFFFFFFFF, 0xFFFFFFFF


def shared_classes(docs: DataFrame, size_of_shingle: int = SHINGLE) -> DataFrame:
    """``one`` of every class of which at least 80 % of the shingles occur in another class too.

    A shingle that two classes of one deal hold is known to be shared there; it travels once for the whole deal, under the name of no
    class, and each class counts it at home.  So a shingle in a third of all texts sends one entry a deal to its bucket.  A class in several deals takes the
    least of its counts at home: what it does not count in that deal it has sent from there.  Counts are never too small; what
    is kept in excess is told apart later.  Only the low 32 bits of a hash travel within its bucket; a chance agreement can only keep a class."""
    n_buckets = buckets(docs.sparkSession)

    def send(held: list[tuple]) -> pa.RecordBatch:
        """Token and class of each (set, bucket), as runs: the sets of a bucket stand one after another."""
        h, n, one = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3))
        doc = np.concatenate([x[1] + at for x, at in zip(held, np.cumsum([0, *(len(x[2]) for x in held)]))])
        _, keep = np.unique(one, return_index=True)  # copies go once
        mine = np.isin(doc, keep) if len(keep) < len(n) else np.ones(len(doc), bool)
        h, doc = h[mine], doc[mine]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twin = np.zeros(len(h), bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        home = np.bincount(doc[twin], minlength=len(one))
        bare = np.setdiff1d(doc, doc[~twin])  # all their shingles are known to be shared
        known = np.unique(h[twin])
        h, doc = np.concatenate([h[~twin], known]), np.concatenate([doc[~twin], np.full(len(known), len(one))])
        one, n, home = np.append(one, np.uint64(NO_CLASS)), np.append(n, UNKNOWN), np.append(home, UNKNOWN)
        bucket = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        # hashes rise within a set, so a set's share of a bucket is one run
        entry = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(entry, len(h)))
        of, place = doc[entry], bucket[entry]
        told = np.where(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)], home[of], UNKNOWN)  # once a class and deal
        if len(bare):
            of, count, told = np.concatenate([of, bare]), np.append(count, np.zeros(len(bare), np.int64)), np.concatenate([told, home[bare]])
            place = np.concatenate([place, place[np.arange(len(bare)) % len(place)]])
        tokens = pack_by(bucket, n_buckets, {"token": h.astype(np.uint32)})
        runs = pack_by(place, n_buckets, {"count": count.astype(np.uint32), "one": one[of], "n": n[of].astype(np.uint32), "home": told.astype(np.uint32)})
        return pa.RecordBatch.from_arrays([*tokens.columns, *runs.columns[1:]], ["bucket", "token", "count", "one", "n", "home"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in _chunks(batch, 0, tb.CHUNK_BYTES):
                held.append(_sets(data, offsets, size_of_shingle)[:4])
                size += len(data)
                if size >= DEAL_BYTES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def share(_: int, a: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        classes, index, inverse = np.unique(a["one"], return_index=True, return_inverse=True)
        both = a["token"].astype(np.uint64) << np.uint64(32) | np.repeat(inverse, a["count"]).astype(np.uint64)
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        token = (both >> np.uint64(32)).astype(np.uint32)
        same = token[1:] == token[:-1]
        shared = np.zeros(len(both), bool)
        shared[1:] |= same
        shared[:-1] |= same
        count = np.bincount((both[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(classes))
        home = least(a["home"], inverse, len(classes))
        some = np.flatnonzero((count > 0) | (home != UNKNOWN))
        return classes[some], a["n"][index[some]], count[some].astype(np.uint32), home[some]

    def least(home: np.ndarray, inverse: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, UNKNOWN, np.uint32)
        np.minimum.at(out, inverse, home)
        return out

    def to_classes(one: np.ndarray, n: np.ndarray, shared: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        return pack_by(((one >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64), n_buckets, {"one": one, "n": n, "shared": shared, "home": home})

    def add(_: int, a: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        classes, index, inverse = np.unique(a["one"], return_index=True, return_inverse=True)
        home = least(a["home"], inverse, len(classes)).astype(np.int64)
        shared = np.bincount(inverse, weights=a["shared"]).astype(np.int64) + np.where(home == UNKNOWN, 0, home)
        keep = 100 * shared >= SIMILAR * a["n"][index].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(classes[keep].view(np.int64))], ["one"])

    dealt = docs.select("text").mapInArrow(deal, "bucket long, token binary, count binary, one binary, n binary, home binary")
    counts = by_bucket(dealt, "bucket", {"token": "<u4", "count": "<u4", "one": "<u8", "n": "<u4", "home": "<u4"}, share, "bucket long, one binary, n binary, shared binary, home binary", finish=to_classes)
    return by_bucket(counts, "bucket", {"one": "<u8", "n": "<u4", "shared": "<u4", "home": "<u4"}, add, "one long")


def set_rows(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc, n, hashes (sorted by value), bits (parity bitmap) of every row of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _chunks(batch, 1, tb.CHUNK_BYTES):
                h, doc, n, _, _ = _sets(data, offsets, size)
                bits = np.zeros((j - i, BITMAP_WORDS * 64), bool)
                place = (tb.mix(h, 7) % np.uint64(BITMAP_WORDS * 64)).astype(np.int64)
                odd = np.bincount(doc * BITMAP_WORDS * 64 + place, minlength=bits.size) & 1
                bits[:] = odd.reshape(bits.shape).astype(bool)
                packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BITMAP_WORDS), pa.array(packed.ravel()))],
                    ["doc", "n", "hashes", "bits"],
                )

    return docs.mapInArrow(run, "doc long, n long, hashes array<long>, bits array<long>")


def _same_band(n: Column, m: Column) -> Column:
    return (n * 100 >= m * SIMILAR) & (m * 100 >= n * SIMILAR)


def _bits_allow(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Whether the bitmaps leave room for enough overlap: 180 * overlap >= 80 * (n + m)."""
    apart = F.lit(0)
    for i in range(BITMAP_WORDS):
        apart = apart + F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1)))
    return (100 + SIMILAR) * (n + m - apart) >= 2 * SIMILAR * (n + m)


def tiles(sets: DataFrame) -> DataFrame:
    """token, doc, n, alone: each set under the rarest of its shingles that a match must reach, and its size bands, as one hash.

    Shingles of one set only come first in that order; they need no tile of their own."""
    tokens = sets.select("doc", "n", F.explode("hashes").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = split_join(tokens, common, "token", "doc", hot_keys(common.withColumnRenamed("df", "n"), "token", total))
    of_doc = Window.partitionBy("doc")
    alone = F.col("n") - F.count(F.lit(1)).over(of_doc)
    reach = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100 - 1e-9).cast("long") + 1
    ranked = shared.select("token", "doc", "n", alone.alias("alone"), F.row_number().over(of_doc.orderBy("df", "token")).alias("place"), reach.alias("reach"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND)))
    near = F.explode(F.array(band, band + 1)).alias("band")
    return ranked.where("alone + place <= reach").select("token", "doc", "n", "alone", near).select(F.xxhash64("token", "band").alias("token"), "doc", "n", "alone")


def common_of(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values that two arrays of hashes hold both; each is sorted as unsigned numbers and has none twice."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar enough; bitmaps first, then exact intersections."""
    left = sets.select(F.col("doc").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ab"))
    right = sets.select(F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bb"))
    total = pairs.count()
    hot = {x: hot_keys(pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")), x, total) for x in "ab"}

    def both(some: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        return split_join(split_join(some, a, "a", "b", hot["a"]), b, "b", "a", hot["b"])

    possible = both(pairs, left, right).where(_same_band(F.col("an"), F.col("bn")) & _bits_allow(F.col("ab"), F.col("bb"), F.col("an"), F.col("bn"))).select("a", "b", "an", "bn")
    full = both(possible, sets.select(F.col("doc").alias("a"), F.col("hashes").alias("ah")), sets.select(F.col("doc").alias("b"), F.col("hashes").alias("bh")))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
            overlap = np.array([common_of(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column("ah"), batch.column("bh"))], np.int64)
            keep = (100 + SIMILAR) * overlap >= SIMILAR * n
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return full.select("a", "b", "an", "bn", "ah", "bh").mapInArrow(intersect, "a long, b long")


def _hub_pairs(listed: DataFrame, hot: DataFrame, turn: int) -> DataFrame:
    """Pairs of each set with hubs of its tiles: the best one, and the best one outside that one's component; ``hot``: the tiles to split."""
    rank = F.struct("alone", F.xxhash64("doc", F.lit(turn)), "doc", "comp")
    best = listed.groupBy("token").agg(F.min(rank).alias("hub"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most")
    near = split_join(listed, best, "token", "doc", hot)
    other = near.where(F.col("comp") != F.col("hub.comp")).groupBy("token").agg(F.min(rank).alias("second"))
    one = near.where(F.col("comp") != F.col("hub.comp")).select(F.col("doc").alias("a"), F.col("hub.doc").alias("b"))
    two = near.where(F.col("comp") == F.col("hub.comp")).select("token", "doc")
    two = split_join(two, other, "token", "doc", hot).select(F.col("doc").alias("a"), F.col("second.doc").alias("b"))
    return (one if turn == 0 else one.union(two)).distinct()


def _cross_pairs(listed: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Every pair of one tile that lies in different components and that sizes and bitmaps allow.

    A tile of more than TILE_ROWS sets is split into blocks; a set goes to every pair of blocks with its own, so that one
    place compares two blocks at most."""
    open_ = listed.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.ceil(F.count(F.lit(1)) / TILE_ROWS).cast("int").alias("blocks")).where("least <> most").select("token", "blocks")
    rows = settle(split_join(listed, open_, "token", "doc", hot).join(sets.select("doc", "bits"), "doc").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int")), "open")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "doc", "n", "comp", "bits")
    a, b = dealt.alias("a"), dealt.alias("b")
    allowed = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.one") == F.col("b.one"))
        & (F.col("a.two") == F.col("b.two"))
        & ((F.col("a.one") == F.col("a.two")) | (F.col("a.block") != F.col("b.block")))
        & (F.col("a.doc") < F.col("b.doc"))
        & (F.col("a.comp") != F.col("b.comp"))
        & _same_band(F.col("a.n"), F.col("b.n"))
        & _bits_allow(F.col("a.bits"), F.col("b.bits"), F.col("a.n"), F.col("b.n"))
    )
    return a.join(b, allowed).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()


def links_and_components(sets: DataFrame) -> DataFrame:
    """doc, comp of every set that links with another one; ``sets``: doc, n, hashes, bits, all distinct."""
    spark = sets.sparkSession
    listed = settle(tiles(sets), "tiles")
    links = spark.createDataFrame([], "a long, b long")
    found = spark.createDataFrame([], "doc long, comp long")
    hot = hot_keys(listed.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token", listed.count())
    for turn in range(HUB_ROUNDS + 1):
        placed = listed.join(found, "doc", "left").select("token", "doc", "n", "alone", F.coalesce("comp", "doc").alias("comp"))
        pairs = settle(_hub_pairs(placed, hot, turn) if turn < HUB_ROUNDS else _cross_pairs(placed, hot, sets), "pairs")
        new = settle(verified(pairs, sets), "links")
        discard(pairs)
        if new.limit(1).count():
            links = links.union(new)
            found = components(links)
    return found


def _placed(docs: DataFrame, size: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = settle(set_digests(texts, size), "set-digests")
    classes = settle(rows.where("n_shingles > 0 and doc_id is not null").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    shared = settle(classes.join(shared_classes(texts, size), "one", "left_semi").select("rep"), "shared")
    wanted = broadcast_if_small(shared, 16)
    sets = settle(set_rows(texts.join(wanted, texts["doc_id"] == wanted["rep"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), size), "sets")
    found = links_and_components(sets)
    of_class = classes.join(found, classes["rep"] == found["doc"], "left").select("one", "two", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    joined = rows.join(of_class, ["one", "two", "n_shingles"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), "text_key")


def component_rows(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _placed(docs, size).drop("text_key")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows whose doc_id is the smallest of their component, with all their columns."""
    return once_each(rows_of(docs, _placed(docs, size).where(F.col("doc_id").eqNullSafe(F.col("component_id")))))
