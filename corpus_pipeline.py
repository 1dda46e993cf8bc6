"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which `run`
writes as Parquet and reads again for the next. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import decontaminate, mixing, quality, sharding, simhash
from docketry.llm.common import SOLID, copies, discard, merged, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. The model is fitted on these documents' labels.

    Null and empty texts have a score like any other. Rows that repeat have one score; ids are never looked at but for
    their labels. Without labels all stay, as all scores are 0.5. Other columns drop out; an empty table gives none.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model).where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def digest() -> Column:
    """64 bits of a row; which of its columns are null counts as well."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the least id, and of rows that repeat it there, the one of the least digest.

    Null ids come last, so a component without ids keeps one row too; an id that stands in several components may stay
    in each. Ids and digests decide, so that the texts travel once; only of rows that repeat id and digest are texts
    dealt out again, to keep one of them.
    """
    best = stored(simhash.one_of_each(docs, digest()).select(F.col("doc_id").alias("_own"), F.col("digest").alias("_digest"), F.col("times").alias("_times")))
    rows = docs.select(*COLUMNS, digest().alias("_mark"))
    kept = rows.join(merged(best, best.count()), F.col("doc_id").eqNullSafe(F.col("_own")) & (F.col("_mark") == F.col("_digest")))
    same = kept.where("_times > 1").withColumn("_n", F.row_number().over(Window.partitionBy("_own", "_digest").orderBy("_mark"))).where("_n = 1")
    return kept.where("_times = 1").select(*COLUMNS).unionByName(same.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts have no words and stay; rows that repeat stay or go together. With an empty benchmark all
    stay. Other columns drop out; an empty table gives none.
    """
    return decontaminate.contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken whole, and the one that the budget cuts with its first words.

    Documents stand in the order of their ids and digests. Rows that are equal in all columns are as good as each
    other: they are mixed one by one, and one of them is written as often as all together are taken. Null and empty
    texts have no words and aren't taken; a null source is one source. An empty table gives none.
    """
    rows = docs.select(*COLUMNS, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest().cast("string")).alias("key"))
    slim = rows.select("key", mixing.word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"))
    taken = mixing.fair_mix(stored(slim)).where("taken > 0")
    taken = taken.groupBy("key", "size").agg(F.sum(F.floor(F.col("taken") / F.col("size"))).alias("full"), F.max(F.col("taken") % F.col("size")).alias("rest"))
    taken = stored(taken.withColumn("times", F.col("full") + (F.col("rest") > 0).cast("long")))
    often = stored(slim.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    repeated = often.count()
    one = rows.join(merged(often, repeated), "key", "left_semi").groupBy("key").agg(F.first(F.struct(*COLUMNS)).alias("row")).select("row.*", "key")
    rows = rows.join(merged(often, repeated), "key", "left_anti").select(*COLUMNS, "key").unionByName(one)
    out = copies(rows.join(merged(taken, taken.count()), "key"), "times", "copy")
    left = F.when(F.col("copy") < F.col("full"), F.col("size")).otherwise(F.col("rest"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SOLID), F.lit(0)), 1, left.cast("int")), " ")
    out = out.withColumn("_left", left).withColumn("text", F.when(F.col("_left") < F.col("size"), cut).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("_left") < F.col("size"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its size, checksum, shard and slot there, and its shard with one shard more.

    Rows that repeat an id, or have none, share a shard and have a slot each; null text is an empty one of size 16 and
    stays null. An empty table gives none.
    """
    return sharding.placed_documents(docs.select(*COLUMNS))


STAGES = [("quality", keep_quality), ("near_duplicates", one_of_near_duplicates), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: A fitted model, XXH64 and CRC-32 are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's table goes when the next one's stands."""
    docs = stored(STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir))
    for _, stage in STAGES[1:]:
        after = stored(stage(spark, docs, sf_dir))
        discard(docs)
        docs = after
    return docs
