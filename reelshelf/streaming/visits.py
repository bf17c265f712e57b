"""Continuous visit counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelshelf.operators.visitors import add_visits
from reelshelf.operators.visits import daily, summed, visits_of
from reelshelf.schemas import schema
from reelshelf.sources.store import Store


def visit_windows(visits: DataFrame, lateness: str | None = None) -> DataFrame:
    """Daily visit rows of a stream.

    Without ``lateness`` every visit counts whenever it comes, and the sink takes
    updated days again (``complete`` or ``update`` mode). With one, a day is final
    and leaves the state once it is that old (``append`` mode).
    """
    timed = visits.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark("ts", lateness)
    return (
        timed.groupBy(F.window("ts", "1 day").alias("_day"), "visitor_token_hash", "route")
        .agg(
            F.count("*").alias("visit_count"),
            F.min("ts").alias("first_visited_at"),
            F.max("ts").alias("last_visited_at"),
        )
        .withColumn("visit_date", F.to_date("_day.start"))
        .drop("_day")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Stream of access-log files as they land in ``path``."""
    return spark.readStream.schema(schema("access_log")).parquet(path)


def visit_stream(visits: DataFrame, store: Store, checkpoint: str, stream: str = "visits") -> StreamingQuery:
    """Add a stream of visits to the stored increments of ``site_visit``.

    Late visits are never dropped. Each micro-batch is aggregated and written
    under its days and its own id, so no stored file is read or rewritten, and a
    batch that is replayed after a failure replaces itself. ``stream`` names the
    checkpoint: each one needs a name of its own. :func:`stored_visits` sums up.
    """
    visits = visits.withColumn("ts", F.col("ts").cast("timestamp"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.write_batch("site_visit", daily(batch), f"{stream}-{batch_id}", "visit_date")

    return (
        visits.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def visitor_stream(visits: DataFrame, store: Store, checkpoint: str, stream: str = "visitors") -> StreamingQuery:
    """Add a stream of visits to the stored bitmaps of visitors, whenever a visit comes.

    Each micro-batch is one commit; one that is replayed is not counted again.
    """
    visits = visits.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        visits.writeStream.foreachBatch(lambda batch, batch_id: add_visits(store, daily(batch), stream, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_visits(store: Store) -> DataFrame:
    """Daily visit rows over all increments; a filter on ``visit_date`` prunes folders."""
    return summed(store.read_batches("site_visit"))


def log_visit_stream(spark: SparkSession, path: str, store: Store, checkpoint: str):
    """Access-log files to stored daily visits."""
    return visit_stream(visits_of(read_log(spark, path)), store, checkpoint)
