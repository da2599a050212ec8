"""Prefix trie of conversations (operator 12).

A node is a distinct sequence of first turns.  Its key is its depth with two 64-bit lanes, the exclusive or of the hashes of
(place, role, text) of all its turns, so prefix keys come from running sums and a parent's key is its child's without the
last turn.  Partitions combine the prefixes that they hold into node tables before anything is shuffled, and the tables are
merged by node key: members, smallest member and lengths first, then children, then the ends of conversations, whose
sorted lists arrive in pieces and are digested as a stream.

The rollup needs no walk over levels.  From its first own depth on a conversation is the smallest member of every node on
its path.  Bytes that a conversation shares are those above that depth; a leaf is counted by its smallest member.  So each
conversation sums its path from its end up, and the sums are merged by node key once more: the total of a node's members is that of its subtree.

Turns of a conversation are numbered and summed in chunks of ``CHUNK`` with offsets, so a long conversation is spread over
tasks.  (A conversation whose turns all carry one number stays in one sorted, spilling window.)  Children of a node with very many are dealt to parts when they
meet their parent.

Defined results: rows with a null conv_id take no part; turns sort by turn (null first), then role, then text, so ties and
repeated rows have one order and each row is a turn; null roles and texts are empty; an empty table gives no rows; a
conversation left without turns is a member and an end of the root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import discard, hot_keys, settle, split_join, text_or_empty

CHUNK = 1024
#: Conversations of one group share the beginning of its first.
GROUP = 5
MOST_SHARED = 8
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def shared_turns(conv: Column) -> Column:
    """How many turns of the group's first conversation begin this one."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(MOST_SHARED + 1))


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, length of every conversation; conv, depth from 1, x1, x2, size of its turns) after rebuilding."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"),
        F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-(1 << 62))).alias("bucket"),
    )
    counts = rows.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("conv").agg(F.sum("n").alias("n_turns"))
    first = F.col("conv") - F.col("conv") % GROUP
    shared = shared_turns(F.col("conv"))
    grouped = lengths.groupBy(first.alias("first")).agg(F.sort_array(F.collect_list("conv")).alias("kids"), _or0(F.max(F.when(first == F.col("conv"), F.col("n_turns")))).alias("n_first"))  # at most 9 to a group
    convs = settle(
        grouped.select("first", "kids", "n_first", F.explode("kids").alias("conv")).join(lengths, "conv")
        .withColumn("shared", shared).withColumn("take", F.least("shared", "n_first"))
        .select("conv", "shared", "take", F.when(F.col("conv") == F.col("first"), F.col("kids")).alias("kids"), (F.col("take") + F.greatest(F.col("n_turns") - F.col("shared"), F.lit(0))).alias("length")),
        "conversations",
    )
    offsets = counts.withColumn("before", _or0(F.sum("n").over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(*_BEFORE))))
    offsets = offsets.join(convs.select("conv", "shared", "take", "kids"), "conv").drop("n")
    order = Window.partitionBy("conv", "bucket").orderBy(F.asc_nulls_first("turn"), "role", "text")
    numbered = rows.withColumn("place", F.row_number().over(order)).drop("turn").join(offsets, ["conv", "bucket"]).withColumn("place", F.col("before") + F.col("place") - 1)
    own = F.when(F.col("place") >= F.col("shared"), F.array(F.struct(F.col("conv"), (F.col("take") + F.col("place") - F.col("shared") + 1).alias("depth"))))
    begun = F.transform(F.filter("kids", lambda c: F.col("place") < shared_turns(c)), lambda c: F.struct(c.alias("conv"), (F.col("place") + 1).alias("depth")))
    nothing = F.array().cast("array<struct<conv:bigint,depth:bigint>>")
    spread = numbered.select("role", "text", F.explode(F.concat(F.coalesce(own, nothing), F.coalesce(F.when(F.col("place") < MOST_SHARED, begun), nothing))).alias("to"))
    turns = spread.select("to.conv", "to.depth", "role", "text").select(
        "conv", "depth", F.xxhash64(F.lit("a"), "depth", "role", "text").alias("x1"), F.xxhash64(F.lit("b"), "text", "depth", "role").alias("x2"), F.octet_length("text").cast("long").alias("size")
    )
    return convs, settle(turns, "turns")


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, chunk, node (depth, k1, k2), x1, x2, size, total (bytes down to here) of every prefix of every conversation, the empty ones included."""
    parts = turns.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(*_BEFORE)
    xor = {c: F.expr(f"bit_xor({c})") for c in ("x1", "x2")}
    sums = parts.groupBy("conv", "chunk").agg(*(v.alias(c) for c, v in xor.items()), F.sum("size").alias("size"))
    offsets = sums.select("conv", "chunk", *(_or0(v.over(before)).alias(f"o{c}") for c, v in xor.items()), _or0(F.sum("size").over(before)).alias("osize"))
    here = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(*_UP_TO)
    down = parts.withColumns({f"p{c}": v.over(here) for c, v in xor.items()} | {"psize": F.sum("size").over(here)}).join(offsets, ["conv", "chunk"])
    node = F.struct("depth", F.col("px1").bitwiseXOR(F.col("ox1")).alias("k1"), F.col("px2").bitwiseXOR(F.col("ox2")).alias("k2"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("chunk"), F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2")).alias("node"), zero.alias("x1"), zero.alias("x2"), zero.alias("size"), zero.alias("total"))
    return settle(down.select("conv", "chunk", node.alias("node"), "x1", "x2", "size", (F.col("osize") + F.col("psize")).alias("total")).unionByName(roots), "prefixes")


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of rows (node, conv): sorted by range into lists of one batch, which are digested one after another."""
    flat = ends.select("node.depth", "node.k1", "node.k2", "conv")
    key = ["depth", "k1", "k2"]

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf[key].to_numpy()
            if len(keys):
                at = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
                ids = list(map(str, pdf["conv"].tolist()))
                out = pdf.iloc[at].rename(columns={"conv": "least"})
                yield out.assign(ids=[",".join(ids[i:j]) for i, j in zip(at, [*at[1:], len(ids)])])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sha = None, hashlib.sha256()
        for pdf in batches:
            done = []
            for depth, k1, k2, ids in zip(pdf["depth"], pdf["k1"], pdf["k2"], pdf["ids"]):
                if held == (depth, k1, k2):
                    sha.update(b",")
                else:
                    if held:
                        done.append((*held, sha.hexdigest()))
                    held, sha = (depth, k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if held:
            yield pd.DataFrame([(*held, sha.hexdigest())], columns=[*key, "ends_sha256"])

    listed = flat.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInPandas(lists, "depth long, k1 long, k2 long, least long, ids string")
    found = listed.repartition(*key).sortWithinPartitions(*key, "least").mapInPandas(digest, "depth long, k1 long, k2 long, ends_sha256 string")
    return found.select(F.struct(*key).alias("node"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; see the module for the columns' sense."""
    convs, turns = rebuilt(conversations)
    down = prefixes(convs, turns)
    nodes = down.groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.max(c).alias(c) for c in ("x1", "x2", "size", "total"))
    )  # map-side tables of each partition, merged by node
    parent = F.struct((F.col("node.depth") - 1).alias("depth"), F.col("node.k1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("node.k2").bitwiseXOR(F.col("x2")).alias("k2"))
    nodes = settle(nodes.withColumn("parent", F.when(F.col("node.depth") > 0, parent)), "nodes")
    children = settle(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")), "children")

    # From depth r on a conversation is the smallest member; what it shares ends at the bytes above that depth.
    own = nodes.join(children, "node", "left").groupBy(F.col("conv_id").alias("conv")).agg(
        F.min(F.struct(F.col("node.depth").alias("depth"), (F.col("total") - F.col("size")).alias("until")))["until"].alias("until"), F.max(F.when(F.col("n").isNull(), 1).otherwise(0)).alias("leaf")
    )
    whole = turns.groupBy("conv").agg(F.sum("size").alias("whole"))
    paths = convs.select("conv", "length").join(own, "conv", "left").join(whole, "conv", "left").select(
        "conv", "length", F.coalesce("until", "whole", F.lit(0)).alias("until"), _or0(F.col("leaf")).alias("leaf"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / CHUNK))).alias("chunk")
    )
    walked = down.join(paths, ["conv", "chunk"])
    above = F.col("total") - F.col("size")
    sums = walked.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("until") - above, F.lit(0))).alias("saved_tokens"))
    ends = end_digests(walked.where(F.col("node.depth") == F.col("length")).select("node", "conv"))

    total = children.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(children, "node", total)
    below = nodes.where("parent IS NOT NULL").select(F.col("node").alias("child"), "conv_id", F.col("parent").alias("up"))
    parents = split_join(below, nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up", "conv_id", hot).select(F.col("child").alias("node"), "parent_conv_id")

    out = nodes.select("node", "conv_id", "n_convs").join(sums, "node").join(children, "node", "left").join(parents, "node", "left").join(ends, "node", "left")
    found = settle(
        out.select(
            "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", _or0(F.col("n")).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        ),
        "trie",
    )
    discard(convs, turns, down, nodes, children)
    return found
