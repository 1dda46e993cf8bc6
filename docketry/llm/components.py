"""Connected components by alternating large and small stars, with every round's edges in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, merged, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge. Edges are (a, b) of any ordered type.

    A round points each node's larger neighbours (large star), then each node and its smaller neighbours (small
    star), at the smallest of them; rounds end when no edge changes, after a number that grows with the logarithm of
    the graph. Only sums reach the driver. No node's neighbours are ever held together: a star is an aggregate, which
    is written, and a join of two shuffles, of which adaptive execution splits a hub's; only the stars of few edges, as
    they were counted, are broadcast. Self-loops and repeated edges do no harm; no edges give no rows. A round's tables
    go when the next ones stand.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, now.count()
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(merged(least, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        last = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(merged(last, 2 * n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(last.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct())
        discard(now, least, large, last)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before, n = state, state[0]
