"""Sharding by a two-pass external shuffle.

Pass one scatters records by seeded hashes: the shard is the highest-scoring one for the id (rendezvous hashing, so
a further shard takes records only into itself), and within the shard another hash picks one of as many buckets as
keep each within a memory-sized number of bytes and rows. Pass two shuffles each bucket with Fisher-Yates (Spark's
`shuffle` of an array, seeded by the bucket) and numbers its records; the buckets' sizes give where each begins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import copies, stored

#: Bytes and rows that a bucket holds on average at most, and partitions of the second pass at most.
BUCKET_BYTES, BUCKET_ROWS, TASKS = 32 << 20, 32768, 8192


PLACED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def rendezvous(key: Column, shards: int, seed: int = 17) -> Column:
    """The shard from 0 to shards - 1 whose seeded hash with the key is largest."""
    scores = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), key, j).alias("h"), j.alias("j")))
    return F.array_max(scores)["j"]


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def record_hash(names: list[str], seed: int) -> Column:
    """64 bits of a whole record; which of its columns are null counts as well."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names], *[F.col(f"`{c}`").isNull() for c in names])


def told_apart(records: DataFrame, seed: int, most: int) -> DataFrame:
    """(record, h): each record as a struct with a hash that tells copies apart where there are more than `most` of them.

    Such copies are counted, dealt out again by number and hashed with it, so that no bucket gets them all.
    """
    names = records.columns
    own = records.withColumn("_h", record_hash(names, seed))
    often = stored(own.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_h"))
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("record")
    few = own.join(often, "_h", "left_anti").select(whole, F.col("_h").alias("h"))
    counted = own.join(often, "_h", "left_semi").groupBy(*[f"`{c}`" for c in names], "_h").agg(F.count(F.lit(1)).alias("_n"))
    return few.unionByName(copies(counted, "_n", "_copy").select(whole, F.xxhash64(F.lit(seed), "_h", "_copy").alias("h")))


def shuffled_shards(records: DataFrame, key: str, size: str, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of `records` plus shard, slot (gapless from 0 in each shard) and grown_shard (with one shard more).

    Only key and shard count decide the shard; null keys are one key. Rows that repeat a key share its shard, in which
    their whole records choose the bucket, and of records that are copies their numbers.
    The order in a shard depends on the records, the seed and the bucket limits alone. Empty in, empty out.
    `records` is read again for its totals; the scattered rows are held in the shared folder between the passes.
    """
    return in_buckets(records, key, size, shards, seed, bucket_bytes, bucket_rows)[0].drop("_bucket")


def in_buckets(records: DataFrame, key: str, size: str, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """The shuffled records with their buckets, in `_bucket`, and the number of buckets. Buckets of a shard follow one another, and so do their slots."""
    names = records.columns
    k = F.col("record")[key]
    totals = records.groupBy(rendezvous(F.col(key), shards, seed).alias("shard")).agg(F.sum(F.col(size)).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # `shards` rows
    buckets = [1] * shards
    for t in totals:
        buckets[t["shard"]] = max(1, math.ceil((t["bytes"] or 0) / bucket_bytes), math.ceil(t["rows"] / bucket_rows))
    of_shard = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("shard"))
    scattered = told_apart(records, seed + 1, bucket_rows).select("record", rendezvous(k, shards, seed).alias("shard"), rendezvous(k, shards + 1, seed).alias("grown_shard"), "h")
    scattered = scattered.withColumn("bucket", (of_shard([sum(buckets[:i]) for i in range(shards)]) + F.pmod(F.col("h"), of_shard(buckets))).cast("int"))
    tasks = min(TASKS, sum(buckets))
    packed = stored(scattered.repartition(tasks, "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct("h", "record", "grown_shard"))).alias("rows")))
    begins = packed.select("shard", "bucket", F.size("rows").alias("n"))
    begins = begins.select("bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("begin"))
    # A partition's number and the order within it are fixed, and with them the seeds of the Fisher-Yates shuffles.
    placed = packed.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    mixed = placed.select("shard", "bucket", F.expr(f"shuffle(rows, {seed})").alias("rows"))
    out = mixed.join(begins, "bucket").select("shard", "bucket", "begin", F.posexplode("rows").alias("pos", "r"))
    return out.select(*[F.col("r.record")[c].alias(c) for c in names], "shard", (F.col("begin") + F.col("pos")).cast("long").alias("slot"), F.col("r.grown_shard").alias("grown_shard"), F.col("bucket").alias("_bucket")), sum(buckets)


def write_shards(records: DataFrame, path: str, key: str, size: str, **options) -> None:
    """Writes the shuffled records, a folder for each shard and there files of one or more buckets, each in slot order.

    No task holds more than a few buckets, however large a shard is. Records that repeat, and those of null keys, are
    written as often as they come; an empty table gives an empty folder without files of data. Columns keep their
    names but for `shard`, which becomes the folder's, `slot` and `grown_shard`.
    """
    placed, buckets = in_buckets(records, key, size, **options)
    placed.repartition(min(TASKS, buckets), "_bucket").sortWithinPartitions("shard", "slot").drop("_bucket").write.partitionBy("shard").parquet(path)


def placed_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """All columns of `docs` plus (size, text_crc32, law, shard, slot, grown_shard) by the law `key`.

    These six replace columns of their names. Null text has no bytes and the checksum of the empty string. Rows that
    repeat a doc_id, or have none, share a shard and each has a slot of its own there. Empty in, empty out.
    """
    names = [c for c in docs.columns if c not in PLACED]
    rows = docs.select(*[f"`{c}`" for c in names], record_bytes(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return shuffled_shards(stored(rows), "doc_id", "size", shards).withColumn("law", F.lit("key")).select(*[f"`{c}`" for c in names], *PLACED)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The same of doc_id alone: (doc_id, size, text_crc32, law, shard, slot, grown_shard). Texts aren't shuffled."""
    slim = docs.select("doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return shuffled_shards(stored(slim), "doc_id", "size", shards).withColumn("law", F.lit("key")).select("doc_id", *PLACED)
