"""Hard negatives by a vertical scan with branch and bound.

Rows are packed into blocks that store every dimension as a column, with its least and largest value. An anchor reads
the columns in the order of its own components' magnitude, largest first. After each few dimensions a row's score is
known up to what the remaining ones can add at least and at most by their least and largest values; rows that these
bounds rule out leave the candidate bitmap, and only the last survivors get whole scores. One scan resolves the
anchors' positives, a second one the score windows that these open.

Anchors are the queries: parts of rows meet parts of anchors, each pair of parts in one task, and what a part finds
for an anchor or a window is a bounded list, of which the best entries win.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import discard, stored

#: Rows of a block, most rows and anchors of a part, bytes of a part's columns, and dimensions between two looks at the bounds.
BLOCK, PART_ROWS, PART_BYTES, STEP = 4096, 65536, 64 << 20, 8
POSITIVES, NEGATIVES = 5, 10
#: A window of negative scores in percent of the positive score.
LOW, HIGH = 30, 90
#: Components beyond this are clamped to it, so that sums of 2^11 products fit in a long.
MOST = 1 << 26


def usable(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(id, label, vec) of rows with a label and a vector of finite components, quantised."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    quantised = F.transform(embedding, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), quantised.alias("vec"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[: offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] :]
    return out


BLOCKS = "part int, n int, ids binary, unnamed binary, labels binary, columns array<binary>, least array<bigint>, largest array<bigint>"


def packed(rows: DataFrame, width: int, parts: int, block: int = BLOCK) -> DataFrame:
    """The blocks: one row each, rows by label within it, every dimension a binary of 32-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0

        def full(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks().sort_by("label")
            ids, labels = table.column("id").combine_chunks(), table.column("label").to_numpy()
            vectors = matrix(table.column("vec").combine_chunks(), width)
            one = lambda x, kind: pa.array([x], kind)
            columns = [np.ascontiguousarray(c, "<i4").tobytes() for c in vectors.T]
            return pa.RecordBatch.from_arrays(
                [
                    one(part, pa.int32()), one(len(labels), pa.int32()), one(ids.fill_null(0).to_numpy().astype("<i8").tobytes(), pa.binary()), one(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes(), pa.binary()),
                    one(labels.astype("<i8").tobytes(), pa.binary()), one(columns, pa.list_(pa.binary())), one(vectors.min(0).tolist(), pa.list_(pa.int64())), one(vectors.max(0).tolist(), pa.list_(pa.int64())),
                ],
                names=["part", "n", "ids", "unnamed", "labels", "columns", "least", "largest"],
            )

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                table = pa.Table.from_batches(held)
                yield full(table.slice(0, block))
                held, n = table.slice(block).to_batches(), n - block
        if n:
            yield full(pa.Table.from_batches(held))

    return rows.repartition(parts).mapInArrow(pack, BLOCKS)


class Block:
    """A block as read by a task."""

    def __init__(self, row: dict) -> None:
        self.ids, self.unnamed = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["unnamed"], "u1").astype(bool)
        self.labels = np.frombuffer(row["labels"], "<i8")
        self.columns = [np.frombuffer(c, "<i4") for c in row["columns"]]
        self.least, self.largest = np.array(row["least"], np.int64), np.array(row["largest"], np.int64)

    def places(self, label: int) -> tuple[int, int]:
        """Where rows of the label begin and end."""
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))


class Best:
    """The best `k` of (score, id), larger scores first, then named rows by smaller ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.unnamed = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        scores, ids, unnamed = np.append(self.scores, scores), np.append(self.ids, ids), np.append(self.unnamed, unnamed)
        order = np.lexsort((ids, unnamed, -scores))[: self.k]
        self.scores, self.ids, self.unnamed = scores[order], ids[order], unnamed[order]

    def floor(self) -> int | None:
        """A score below which nothing gets in any more."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def scan(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple[int | None, int | None, Best]], step: int = STEP) -> None:
    """Adds to each window's best rows those of `alive` whose score lies in it.

    After every `step` dimensions a row stays only if for some window its upper bound reaches the window's low end
    and the k-th best score there, known or by lower bounds of rows that lie in it for sure, and its lower bound
    doesn't exceed the high end.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor[:, None] * np.stack([block.least, block.largest], 1)
    low_rest, high_rest = ends.min(1)[order], ends.max(1)[order]
    low_rest, high_rest = low_rest.sum() - np.cumsum(low_rest), high_rest.sum() - np.cumsum(high_rest)
    partial = np.zeros(len(alive), np.int64)
    whole = len(alive) == len(block.ids)
    for i, d in enumerate(order):
        if anchor[d] == 0:
            break  # all that remain are zero
        column = block.columns[d]
        partial += (column if whole else column[alive]).astype(np.int64) * anchor[d]
        if i % step == step - 1 and i + 1 < len(order):
            lower, upper = partial + low_rest[i], partial + high_rest[i]
            keep = np.zeros(len(alive), bool)
            for low, high, best in windows:
                fits = np.ones(len(alive), bool)
                least = best.floor()
                if low is not None:
                    least = low if least is None else max(least, low)
                if high is not None:
                    fits &= lower <= high
                sure = lower if high is None and low is None else lower[(lower >= low) & (upper <= high)]
                if len(sure) >= best.k:
                    kth = int(np.partition(sure, len(sure) - best.k)[len(sure) - best.k])
                    least = kth if least is None else max(least, kth)
                if least is not None:
                    fits &= upper >= least
                keep |= fits
            if not keep.all():
                alive, partial, whole = alive[keep], partial[keep], False
            if not len(alive):
                return
    for low, high, best in windows:
        hit = np.ones(len(alive), bool) if low is None else (partial >= low) & (partial <= high)
        if best.floor() is not None:
            hit &= partial >= best.floor()
        if hit.any():
            best.add(partial[hit], block.ids[alive[hit]], block.unnamed[alive[hit]])


def met(blocks: DataFrame, anchors: DataFrame, parts: int, anchor_parts: int, width: int, found: str, judge) -> DataFrame:
    """What `judge(block rows, anchor row)` yields for each part of rows and each anchor, with the anchor's key first."""

    def task(rows: pa.Table, asking: pa.Table) -> pa.Table:
        held = [Block(x) for x in rows.to_pylist()]
        vectors = matrix(asking.column("vec").combine_chunks(), width) if asking.num_rows else np.zeros((0, width), np.int64)
        out = []
        for row, vector in zip(asking.drop_columns(["vec", "part", "slice"]).to_pylist(), vectors, strict=True):
            out += judge(held, row, vector)
        schema = pa.schema([(n.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[n.split()[1]]) for n in found.split(", ")])
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    slices = F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1)))
    rows = blocks.withColumn("slice", slices)
    asking = anchors.withColumn("slice", F.pmod("aid", F.lit(anchor_parts)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.groupBy("part", "slice").cogroup(asking.groupBy("part", "slice")).applyInArrow(task, found)


def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first `k` of each key by score and id, numbered in `rank`."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, part_rows: int = PART_ROWS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchor` is a condition on id and label; all rows that meet it are anchors. Scores are inner products of
    floor(256 * x), larger ones first, ties by smaller ids, null ids last. An anchor's positives are its first
    `positives` other rows of its label; each has the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, so a score below 0 has none.

    Rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different
    lengths are compared as if the shorter one ended in zeros; an empty vector scores 0 with all. Rows that repeat an
    id are rows of their own, as positives, negatives and anchors; components beyond 2^26 after scaling count as that.
    Columns beyond the three aren't read. Empty in, empty out.
    """
    rows = stored(usable(rows, vec_id, embedding, label))
    condition = F.col("id") % 100 == 0 if anchor is None else anchor
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    width = max(1, width or 0)
    spread = 2 * rows.sparkSession.sparkContext.defaultParallelism
    fit = max(BLOCK, min(part_rows, PART_BYTES // (4 * width)))
    parts = max(1, -(-n // fit), min(spread, -(-n // 2048)))
    blocks = stored(packed(rows, width, parts, min(BLOCK, fit)))
    anchors = stored(rows.where(condition).select(F.monotonically_increasing_id().alias("aid"), "id", "label", "vec"))
    anchor_parts = max(1, -(-anchors.count() // fit))

    def same(held: list[Block], row: dict, vector: np.ndarray) -> list[tuple]:
        best = Best(positives + 1)
        for block in held:
            begin, end = block.places(row["label"])
            if begin < end:
                scan(block, vector, np.arange(begin, end), [(None, None, best)])
        return [(row["aid"], int(s), None if u else int(i)) for s, i, u in zip(best.scores, best.ids, best.unnamed, strict=True)]

    # The anchor itself is one of the rows of its id and its own score, all of which are as good as each other.
    found = first(met(blocks, anchors, parts, anchor_parts, width, "aid bigint, score bigint, id bigint", same), ["aid"], positives + 1)
    own = anchors.select("aid", F.col("id").alias("own"), F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x).alias("length"))
    itself = F.col("id").eqNullSafe(F.col("own")) & (F.col("score") == F.col("length"))
    itself = (F.row_number().over(Window.partitionBy("aid").orderBy(F.when(itself, 0).otherwise(1), "rank")) == 1) & itself
    others = found.join(own, "aid").withColumn("itself", itself).where("not itself")
    others = others.withColumn("place", F.row_number().over(Window.partitionBy("aid").orderBy("rank"))).where(F.col("place") <= positives)
    pairs = stored(others.select("aid", "place", F.col("own").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    def windows(held: list[Block], row: dict, vector: np.ndarray) -> list[tuple]:
        open_ = {s: Best(negatives) for s in row["scores"]}
        asked = [(-(-low * s // 100), high * s // 100, best) for s, best in open_.items()]
        for block in held:
            begin, end = block.places(row["label"])
            alive = np.arange(len(block.ids)) if begin == end else np.append(np.arange(begin), np.arange(end, len(block.ids)))
            if len(alive):
                scan(block, vector, alive, asked)
        return [(row["aid"], p, int(s), None if u else int(i)) for p, best in open_.items() for s, i, u in zip(best.scores, best.ids, best.unnamed, strict=True)]

    asking = anchors.select("aid", "label", "vec").join(pairs.where("positive_score >= 0").groupBy("aid").agg(F.collect_set("positive_score").alias("scores")), "aid")
    found = met(blocks, asking, parts, anchor_parts, width, "aid bigint, positive_score bigint, score bigint, id bigint", windows)
    found = stored(first(found, ["aid", "positive_score"], negatives))
    discard(blocks, anchors, rows)
    out = pairs.join(found, ["aid", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The table with every seventh id's label moved on by one, so that labels and vectors don't agree everywhere."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))
