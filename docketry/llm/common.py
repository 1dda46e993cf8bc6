"""What the operators share: words, hashes, tables in the shared folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and everything beyond ASCII.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Everything but the six ASCII white-space characters.
SOLID = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by a path that Spark alone resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column, pattern: str) -> Column:
    """All matches of a pattern in the text with A-Z lowered; null has none."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(pattern), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local master may do without and gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='docketry-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later steps read it again, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def copies(counted: DataFrame, n: str, copy: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row as often as its column `n` says, numbered from 0 in `copy`; many copies are dealt out in chunks first."""
    few = counted.where(F.col(n) <= chunk).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = counted.where(F.col(n) > chunk).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk))))
    many = many.repartition(F.col("_c"), F.xxhash64(*[F.col(f"`{c}`") for c in counted.columns]))
    many = many.withColumn(copy, F.explode(F.sequence(F.col("_c") * chunk, F.least((F.col("_c") + 1) * chunk, F.col(n)) - 1)))
    return few.unionByName(many.drop("_c"))


def broadcast_up_to(df: DataFrame, size: int, limit: int) -> DataFrame:
    """A broadcast only where the measured size is within the limit; beyond it a join of two shuffles serves, whatever Spark takes the size to be."""
    return F.broadcast(df) if size <= limit else df.hint("merge")


#: Rows that a join's side may have at most to be broadcast; with their hash table they are some ten MB.
BROADCAST_ROWS = 1 << 16


def merged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """One side of a join of two sorted shuffles, however small Spark takes it to be; of few rows, counted, a broadcast.

    Spark sizes what an array is exploded to as one row, and a file as it lies compressed. Adaptive execution splits
    large keys of such a join.
    """
    return df.hint("merge") if rows is None or rows > BROADCAST_ROWS else F.broadcast(df)


def seeded(column: Column, seed: str) -> Column:
    """60 bits of MD5 over a seed and a value, as a long that is never negative."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
