"""The prefix trie of conversations by the Euler-tour technique.

Every node of the trie has an arc that enters it and one that leaves it. Each arc knows its successor: from a node to
its first child, from there to the next sibling, at last back to the parent. List ranking gives every arc its position
in this tour: ranges of arcs that lie near each other are contracted to the stretches of the tour inside them, and
pointers jump from stretch to stretch, twice as far each time. What a subtree holds is then a difference of prefix
sums at the positions of its two arcs.

No conversation, node or sibling group is held in one task: turns are numbered, prefixes hashed, siblings numbered
and positions summed by running sums over ranges (`scans`). The hash of a prefix is a sum of hashes of its turns, each
with its place, in two lanes of 62 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, stored
from docketry.llm.scans import MASK, PART_ROWS, ranges, running

#: Turns that a conversation may borrow are fewer than this; it borrows from the first of each run of so many ids.
BORROWED, RUN = 9, 5
#: Characters of joined ids that travel as one row.
CHUNK = 1 << 20


def turns_of(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv, pos, one, two, bytes): turns numbered from 0, with 128 bits of hash of role and text, and the text's length in UTF-8."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("long")
    slim = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), half(1).alias("one"), half(17).alias("two"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("pos"))
    return running(stored(slim), "conv", ["turn", "one", "two"], ["pos"], part_rows).withColumn("pos", F.col("pos") - 1).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed beginnings: (conv, length) of each, and (conv, pos, one, two, bytes, length) of their turns.

    Conversation c takes the first h turns of conversation c - c % 5, then its own after the first h; h is the CRC-32
    of c in decimal, modulo 9.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("lender", F.col("conv") - F.col("conv") % RUN).withColumn("h", F.crc32(F.col("conv").cast("string")) % BORROWED)
    lent = convs.select(F.col("conv").alias("lender"), F.col("n").alias("lent"))
    convs = convs.join(lent, "lender", "left").withColumn("lent", F.least("h", F.coalesce("lent", F.lit(0))))
    convs = stored(convs.select("conv", "lender", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(convs, "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("lent"))
    borrowed = turns.where(F.col("pos") < BORROWED).withColumnRenamed("conv", "lender").join(convs, "lender").where("pos < lent")
    columns = ["conv", "pos", "one", "two", "bytes", "length"]
    return convs.select("conv", "length"), own.select(columns).unionByName(borrowed.select(columns))


def prefixes(convs: DataFrame, turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv, depth, key, bytes, parent_key, ends) of every prefix of every conversation but the empty one."""
    lane = lambda i, *c: F.xxhash64(F.lit(i), *c).bitwiseAND(F.lit(MASK))
    rows = stored(turns.select("conv", "pos", "bytes", "length", lane(1, "pos", "one", "two").alias("a"), lane(2, "two", "pos", "one").alias("b")))
    rows = running(rows.withColumns({"ka": F.col("a"), "kb": F.col("b")}), "conv", ["pos"], ["ka", "kb"], part_rows)
    before = lambda k, h: (F.col(k) + (F.lit(MASK + 1) - F.col(h))).bitwiseAND(F.lit(MASK))
    return rows.select("conv", (F.col("pos") + 1).alias("depth"), F.struct("ka", "kb").alias("key"), "bytes", F.struct(before("ka", "a").alias("ka"), before("kb", "b").alias("kb")).alias("parent_key"), (F.col("pos") + 1 == F.col("length")).alias("ends"))


def nodes_of(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(nid, key, parent, depth, conv, parent_conv, n_convs, bytes) of every node; the root's key is 0."""
    inner = paths.groupBy("key").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.struct(zero.alias("ka"), zero.alias("kb")).alias("key"), "conv", "n_convs", zero.alias("bytes"), zero.alias("depth"), F.lit(None).cast("struct<ka: bigint, kb: bigint>").alias("parent_key"))
    nodes = stored(inner.unionByName(root).withColumn("nid", F.monotonically_increasing_id()))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("nid").alias("parent"), F.col("conv").alias("parent_conv"))
    return stored(nodes.join(parents, "parent_key", "left").drop("parent_key"))


def tour(nodes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(arc, next, conv, depth, leaf, saved): two arcs of each node, 2 * nid to enter and 2 * nid + 1 to leave it. Children stand by `conv`."""
    siblings = running(nodes.where("parent is not null").select("parent", "conv", "nid", F.lit(1).cast("long").alias("place")), "parent", ["conv"], ["place"], part_rows)
    siblings = stored(siblings.select("parent", "nid", "place"))
    child = siblings.where("place = 1").select(F.col("parent").alias("nid"), F.col("nid").alias("child"))
    after = siblings.select("parent", (F.col("place") - 1).alias("place"), F.col("nid").alias("sibling"))
    links = nodes.join(child, "nid", "left").join(siblings.select("nid", "place"), "nid", "left").join(after, ["parent", "place"], "left")
    enter, leave = F.col("nid") * 2, F.col("nid") * 2 + 1
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    zero = F.lit(0).cast("long")
    arcs = F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.col("child").isNull().cast("long").alias("leaf"), saved.alias("saved")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), zero.alias("leaf"), zero.alias("saved")),
    )
    return links.select("conv", "depth", F.explode(arcs).alias("a")).select("a.*", "conv", "depth")


def contracted(arcs: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The arcs with the head of their stretch and their place in it; heads have the stretch's length and its successor.

    A stretch is what the tour does within a range of arcs before it leaves the range. Nodes of one first conversation
    are near each other, so most successors lie in the same range.
    """

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.combine_chunks().sort_by("arc")
        arc, rest = table.column("arc").to_numpy(), table.column("next").fill_null(-1).to_numpy()
        after = np.minimum(np.searchsorted(arc, rest), len(arc) - 1)
        inside = arc[after] == rest
        head, place = np.arange(len(arc)), np.zeros(len(arc), np.int64)
        head[after[inside]] = np.flatnonzero(inside)
        place[after[inside]] = 1
        while True:
            further = head[head]
            if (further == head).all():
                break
            place += place[head]
            head = further
        tails = np.flatnonzero(~inside)
        length, out = np.full(len(arc), -1), np.full(len(arc), -1)
        length[head[tails]], out[head[tails]] = place[tails] + 1, rest[tails]
        none = lambda x: pa.array(x, pa.int64(), mask=x < 0)
        yield from pa.Table.from_arrays([pa.array(arc), pa.array(arc[head]), pa.array(place), none(length), none(out), table.column("leaf"), table.column("saved")], names=["arc", "head", "place", "length", "next", "leaf", "saved"]).to_batches(1 << 16)

    schema = pa.schema([(c, pa.int64()) for c in ["arc", "next", "leaf", "saved"]])
    parts = ranges(arcs, arcs.count(), part_rows)
    near = arcs.repartitionByRange(parts, "conv", "depth").select("arc", "next", "leaf", "saved")
    return stored(near.mapInArrow(shorten, "arc bigint, head bigint, place bigint, length bigint, next bigint, leaf bigint, saved bigint"))


def distances(heads: DataFrame) -> DataFrame:
    """(head, distance): arcs from a stretch's head to the end of the tour, itself included, from (head, next, distance) by pointer jumping."""
    now = stored(heads)
    while not now.where("next is not null").isEmpty():
        onward = now.select(F.col("head").alias("next"), F.col("next").alias("_next"), F.col("distance").alias("_more"))
        after = stored(now.join(onward, "next", "left").select("head", F.col("_next").alias("next"), (F.col("distance") + F.coalesce("_more", F.lit(0))).alias("distance")))
        discard(now)
        now = after
    return now.select("head", "distance")


def subtree_sums(nodes: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(nid, n_leaves, saved_tokens) of every node's subtree, by prefix sums at the positions of its two arcs."""
    arcs = contracted(stored(tour(nodes, part_rows)), part_rows)
    reach = distances(arcs.where("length is not null").select("head", "next", F.col("length").alias("distance")))
    total = nodes.count() * 2
    placed = arcs.join(reach, "head").select(F.lit(0).alias("tour"), (F.lit(total) - F.col("distance") + F.col("place")).alias("position"), F.shiftright("arc", 1).alias("nid"), "leaf", "saved", F.col("leaf").alias("leaves"), F.col("saved").alias("savings"))
    summed = running(stored(placed), "tour", ["position"], ["leaves", "savings"], part_rows)
    # The leaving arc adds nothing itself; what the entering one adds is its own.
    inside = lambda total, own: (F.max(total) - F.min(total) + F.max(own))
    return summed.groupBy("nid").agg(inside("leaves", "leaf").alias("n_leaves"), inside("savings", "saved").alias("saved_tokens"))


def digests_of_ends(ends: DataFrame, part_rows: int = PART_ROWS, chunk: int = CHUNK) -> DataFrame:
    """(key, ends_sha256) from (ka, kb, conv): SHA-256 of each key's ids in decimal, ascending, joined by commas.

    Ids are joined range by range into pieces of bounded size, which then stream through the digest in order.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, first, held, size = ["ka", "kb", "first", "piece"], None, 0, [], 0
        done: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string() if i == 3 else pa.int64()) for i in range(4)], names=names)
        room = 0
        for batch in batches:
            for ka, kb, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((ka, kb) != key or size > chunk):
                    done.append((*key, first, ",".join(held)))
                    room, held, size = room + size, [], 0
                if not held:
                    key, first = (ka, kb), conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if room > chunk or len(done) > 10_000:
                yield flush()
                done, room = [], 0
        if held:
            done.append((*key, first, ",".join(held)))
        if done:
            yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string() if i == 2 else pa.int64()) for i in range(3)], names=["ka", "kb", "ends_sha256"])
        for batch in batches:
            for ka, kb, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ka, kb) != key:
                    if sha:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (ka, kb), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if len(done) > 10_000:
                yield flush()
                done = []
        if sha:
            done.append((*key, sha.hexdigest()))
        if done:
            yield flush()

    parts = ranges(ends, ends.count(), part_rows)
    pieces = ends.repartitionByRange(parts, "ka", "kb", "conv").sortWithinPartitions("ka", "kb", "conv").select("ka", "kb", "conv").mapInArrow(join, "ka bigint, kb bigint, first bigint, piece string")
    return pieces.repartition(parts, "ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(digest, "ka bigint, kb bigint, ends_sha256 string").select(F.struct("ka", "kb").alias("key"), "ends_sha256")


def prefix_trie(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    `conversations` is (conv_id, turn, role, text); turns stand by number, null first, those of one number by a hash
    of role and text. Null roles and texts are empty; rows without conv_id belong to no conversation. Conversations
    are rebuilt with borrowed beginnings (`rebuilt`) and may end up without turns, as members of the root alone.
    conv_id is a node's smallest member, and ends_sha256 digests the ids of those that end there. Rows that repeat are
    turns of their own. Columns beyond the four aren't read. Empty in, empty out.
    """
    turns = turns_of(conversations, part_rows)
    convs, rows = rebuilt(turns)
    paths = stored(prefixes(convs, rows, part_rows))
    nodes = nodes_of(convs, paths)
    ends = paths.where("ends").select("key.ka", "key.kb", "conv").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"), "conv"))
    shas = stored(digests_of_ends(stored(ends), part_rows))
    sums = stored(subtree_sums(nodes, part_rows))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("nid")).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.join(sums, "nid").join(children, "nid", "left").join(shas, "key", "left")
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
