"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a seeded random order, twice over. A document's virtual finish time is its
source's cumulative words up to and with it, divided by the source's target; over all sources the documents are
taken in the order of that time until the budget is reached, where the last one is cut.

Cumulative sums are built from sums of hash ranges within a source and of ranges of virtual time, so that no task
sees more than one range, however large a source is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import SOLID, copies, merged, seeded, stored

#: Weights by a source's rank, share of all words to take, and most times that a document is taken.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Rows that a range holds on average at most.
RANGE_ROWS = 200_000


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SOLID)).cast("long")


def fair_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): the budget by weight, capped, the excess reshared.

    With sources by rising cap / weight, the capped ones are a prefix: the first whose cap exceeds its share of what
    the prefix leaves ends it. One row per source, so the window without partitions holds as many rows as sources.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * repeats)
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = F.when(level * F.col("weight") < F.col("cap"), level)  # falls from the first free source on
    ranked = ranked.withColumn("free", free).withColumn("level", F.max("free").over(every))
    return ranked.select("source", "source_size", "rank", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def fair_mix(rows: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(key, size, source) plus (source_size, target, taken): words of each row that the mix takes, repeats counted.

    Null sources are one source, the last. Rows of size 0, and all rows of an empty source, take 0. Rows that share
    key, size and source are counted and told apart by number, so each has a place of its own and those of one key,
    or without one, lie in all ranges. The order depends on the rows and the seed alone, so reruns agree.
    """
    rows = copies(rows.groupBy("key", "size", "source").agg(F.count(F.lit(1)).alias("n")), "n", "copy").drop("n")
    rows = stored(rows.withColumn("h", seeded(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "copy"), seed)))
    n = rows.count()
    bits = max(6, math.ceil(math.log2(max(1, n) / range_rows)) if n else 0)
    rows = rows.withColumn("part", F.shiftright("h", 60 - bits).cast("int"))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = fair_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, repeats)
    parts = parts.withColumn("begin", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    targets = targets.withColumnRenamed("source", "named")
    parts = parts.join(merged(targets), F.col("source").eqNullSafe(F.col("named")))
    parts = stored(parts.select("named", F.col("part").alias("range"), "begin", "source_size", "target", "rank"))
    inside = Window.partitionBy("source", "part").orderBy("h", "key", "size", "copy")
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(merged(parts, parts.count()), F.col("source").eqNullSafe(F.col("named")) & (F.col("part") == F.col("range")))
    finish = [F.when(F.col("target") > 0, (F.col("begin") + F.col("upto") + F.lit(i) * F.col("source_size")) / F.col("target")) for i in range(repeats)]
    ranges = max(256, min(65536, n // range_rows))
    turns = [F.struct(f.alias("finish"), F.least(F.floor(f * F.lit(ranges)), F.lit(2 * ranges)).cast("long").alias("tick"), F.lit(i).alias("turn")) for i, f in enumerate(finish)]
    rows = stored(rows.select("key", "size", "source", "source_size", "target", "rank", "part", "place", F.array(*turns).alias("turns")))

    # Where the budget ends: one of the ranges of virtual time, and what the ranges before it hold.
    ticks = rows.where(F.col("target") > 0).select("size", F.explode("turns.tick").alias("tick")).groupBy("tick").agg(F.sum("size").alias("words"))
    ticks = ticks.withColumn("before", F.sum("words").over(Window.orderBy("tick")) - F.col("words"))
    budget = math.floor((rows.agg(F.sum("size")).first()[0] or 0) * share)
    last = ticks.where(F.col("before") < budget).orderBy(F.col("tick").desc()).first()
    end, before = (last["tick"], last["before"]) if last else (-1, 0)
    full = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.when(t["tick"] < end, F.lit(1)).otherwise(F.lit(0)))
    rows = rows.withColumn("whole", F.coalesce(full, F.lit(0)) * F.col("size"))
    cut = rows.select("part", "place", "rank", "size", F.explode(F.filter("turns", lambda t: t["tick"] == end)).alias("t"))
    # The last range is ordered exactly.
    order = Window.partitionBy("t.tick").orderBy("t.finish", "rank", "t.turn", "part", "place")
    cut = cut.withColumn("left", F.lit(budget - before) - F.sum("size").over(order) + F.col("size"))
    cut = cut.groupBy("rank", "part", "place").agg(F.sum(F.greatest(F.lit(0), F.least("size", "left"))).alias("more"))
    return rows.join(merged(cut), ["rank", "part", "place"], "left").select("key", "size", "source", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken).

    Null text has size 0. A null source is one source, the last. Rows that repeat id, size and source are taken each
    for itself. Columns beyond doc_id, text and source aren't read. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").alias("key"), word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"))
    return fair_mix(stored(rows), seed).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
