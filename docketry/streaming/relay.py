"""Delivery of logged events to consumers, at most once for each event and consumer.

The log is a folder of Parquet files read as a stream. A batch first claims its events in the consumption log, then
runs the handler; a handler that fails is recorded and not run again. Events that are already claimed are left out,
so a batch that Spark repeats after a crash delivers nothing twice. Claims lie in folders by consumer and by ranges of
ids, so a batch reads those of its own range; ranges that are done with are written anew as one file each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLAIM = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("batch", T.StringType()), T.StructField("consumer", T.StringType()), T.StructField("range", T.LongType())])
#: Ids of a range of claims.
RANGE = 100_000


FAILURE = T.StructType([T.StructField("consumer", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("error", T.StringType())])


def failure_log(log: str) -> str:
    return f"{log.rstrip('/')}-failures"


def failures(spark: SparkSession, log: str) -> DataFrame:
    """(consumer, batch, error, at) of handlers that failed; with the claims of a batch, the events that it was for."""
    try:
        return spark.read.schema(T.StructType([*FAILURE.fields, T.StructField("at", T.TimestampType())])).parquet(failure_log(log))
    except AnalysisException:
        return spark.createDataFrame([], FAILURE).withColumn("at", F.lit(None).cast("timestamp"))


def claims(spark: SparkSession, log: str) -> DataFrame:
    """The consumption log, empty before the first batch."""
    try:
        return spark.read.schema(CLAIM).parquet(log)
    except AnalysisException:
        return spark.createDataFrame([], CLAIM)


def range_of(event_id: Column) -> Column:
    return F.floor(event_id / RANGE).cast("long")


def claimed(spark: SparkSession, log: str, consumer: str, first: int, last: int) -> DataFrame:
    """A consumer's claims of the ranges that hold ids `first` to `last`; folders of others aren't read."""
    return claims(spark, log).where((F.col("consumer") == consumer) & F.col("range").between(first // RANGE, last // RANGE))


def deliver(batch: DataFrame, consumer: str, log: str, handler: Callable[[DataFrame], None], types: Sequence[str] | None = None, kind: str = "event_type", most: int | None = None) -> str | None:
    """Claims the batch's unclaimed events of the types (all without any), runs the handler on them and returns the
    error of a handler that failed, which is recorded beside the claims and not tried again.

    With `most` the handler gets that many events at a time, in the order of their ids, each claimed before its own
    call; a failure ends neither the log nor the rest of the batch, and the last error is returned. Events without an
    id can't be claimed and aren't delivered.
    """
    mine = (batch if not types or "*" in types else batch.where(F.col(kind).isin(list(types)))).where("event_id IS NOT NULL")
    error, after = None, None
    while True:
        ahead = mine if after is None else mine.where(F.col("event_id") > after)
        part = ahead.orderBy("event_id").limit(most) if most else ahead
        first, last, n = part.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
        if not n:
            return error
        # Ids that repeat at the end of a part belong to it as a whole.
        error = _deliver(ahead.where(F.col("event_id") <= last), consumer, log, handler, first, last) or error
        if not most or n < most:
            return error
        after = last


def _deliver(mine: DataFrame, consumer: str, log: str, handler: Callable[[DataFrame], None], first: int, last: int) -> str | None:
    spark, name = mine.sparkSession, uuid.uuid4().hex
    fresh = mine.join(claimed(spark, log, consumer, first, last).select("event_id"), "event_id", "left_anti")
    marks = fresh.select("event_id", F.lit(name).alias("batch"), F.lit(consumer).alias("consumer"), range_of(F.col("event_id")).alias("range"))
    marks.write.mode("append").partitionBy("consumer", "range").parquet(log)
    own = claimed(spark, log, consumer, first, last).where(F.col("batch") == name).select("event_id")
    try:
        handler(mine.join(own, "event_id", "left_semi"))
    except Exception as error:  # a consumer's failure is its own: it is recorded, and the log goes on
        spark.createDataFrame([(consumer, name, f"{type(error).__name__}: {error}")], FAILURE).withColumn("at", F.current_timestamp()).write.mode("append").parquet(failure_log(log))
        return str(error)
    return None


def compact(spark: SparkSession, log: str, below: int, scratch: str) -> None:
    """Writes the claims of all ranges whose ids are below `below` anew, one file for a range and consumer.

    They are held in the folder `scratch` meanwhile. To be run while no batch delivers ids below that bound.
    """
    done = claims(spark, log).where((F.col("range") + 1) * RANGE <= below).distinct()
    done.write.mode("overwrite").parquet(scratch)
    held = spark.read.schema(CLAIM).parquet(scratch)
    held.repartition("consumer", "range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("consumer", "range").parquet(log)


def relay(spark: SparkSession, folder: str, schema: T.StructType, consumer: str, log: str, checkpoint: str, handler: Callable[[DataFrame], None], types: Sequence[str] | None = None, pattern: str = "*.parquet", files: int = 100, once: bool = True, most: int | None = None):
    """Starts the stream of one consumer: all that is there now, or every half second from now on; `most` events at a time in order of ids, or a batch as a whole."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: deliver(batch, consumer, log, handler, types, most=most))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="500 milliseconds")).start()


def emit(events: DataFrame, folder: str) -> None:
    """Appends events to the log."""
    events.write.mode("append").parquet(folder)
