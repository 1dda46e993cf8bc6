"""Exact duplicates with a heavy-hitter split.

A frequent-items sketch of the Misra-Gries family names the digests that may be frequent. Their rows are counted
exactly; the verified winners, a bounded number, are broadcast, so that the rows of huge groups of copies are
settled where they are read. Every other digest has at most a bounded share of the rows and goes through an
ordinary aggregation and join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import stored

#: Digests that the sketch may report, counters that it holds, and the share of rows from which a digest is frequent.
WINNERS, COUNTERS, SHARE = 1024, 8192, 1 / 1000


def frequent_digests(rows: DataFrame, winners: int = WINNERS, counters: int = COUNTERS, share: float = SHARE) -> DataFrame:
    """Digests of at least the share of all rows, with exact counts: (digest, group_size, keep_id), `winners` rows at most.

    The sketch's estimates are never below the true counts, and over by 3.5 * rows / counters at most, which is less
    than the share. At most 1 / share digests reach the share; as `winners` is more, none of them is missed unless
    over-estimated ones crowd it out, and one that is missed only goes by the ordinary shuffle. The exact count drops
    those that fall short. An empty table has no frequent digest.
    """
    top = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(mark, {winners}, {counters})").alias("top")).first()
    least = max(2.0, share * top["n"])
    marks = [x["item"] for x in top["top"] or [] if x["count"] >= least]
    exact = rows.where(F.col("mark").isin(marks) if marks else F.lit(False)).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
    return exact.where(F.col("group_size") >= least)


def exact_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: (doc_id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the largest id stays. Null text counts as empty. Rows that share both id and text
    are one document and are kept together; null ids never win over others, and where all ids of a group are null,
    all its rows stay. Columns beyond these two aren't read, so their names can't clash. Empty in, empty out.
    """
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256))
    rows = docs.select(F.col(row_id).alias("id"), digest.alias("digest"))
    rows = stored(rows.withColumn("mark", F.xxhash64("digest")))
    winners = F.broadcast(frequent_digests(rows))  # WINNERS rows at most
    hot = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
    every = hot.select("id", "digest", "group_size", "keep_id").unionByName(rest.join(groups, "digest").select("id", "digest", "group_size", "keep_id"))
    return every.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
