"""Exact distinct visitors from stored bitmaps.

Every visitor has a number, and a day and route has one bit for each of its visitors.
Bitmaps of days are joined by OR into weeks, months and all time, so a report reads
them alone: an eighth of a byte for each number and day at most, whatever the number
of visits. Bits lie in blocks of 32,768 numbers, and blocks are what is shuffled, so
neither a busy day nor a busy route gathers in one task.

Rows without a token count as visits of nobody. A visitor that comes again, in the
same batch or in a later one, keeps its number.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.operators import visits
from reelshelf.session import materialise
from reelshelf.sources.store import Store, bucket_of


def new_numbers(known: DataFrame, tokens: DataFrame, buckets: int) -> DataFrame:
    """Numbers of those ``tokens`` that ``known`` lacks: (visitor_token_hash, number).

    ``known`` has all stored numbers of the tokens' buckets. Each bucket deals out every
    ``buckets``-th number, so only the buckets of a batch are looked at, and numbers stay
    dense as long as the buckets are of like size.
    """
    bucket = bucket_of(F.col("visitor_token_hash"), buckets)
    fresh = tokens.filter("visitor_token_hash IS NOT NULL").join(known, "visitor_token_hash", "left_anti").distinct()
    used = known.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_used"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("visitor_token_hash"))
    placed = fresh.withColumn("_bucket", bucket).withColumn("_place", place).join(F.broadcast(used), "_bucket", "left")
    before = F.coalesce("_used", F.lit(0)) + F.col("_place") - 1
    # Bitmap functions count from one.
    return placed.select("visitor_token_hash", (before * buckets + F.col("_bucket") + 1).cast("long").alias("number"))


def day_bitmaps(daily: DataFrame, numbers: DataFrame) -> DataFrame:
    """Daily rows as bitmaps: (visit_date, route, block, visitors, visit_count)."""
    rows = daily.join(numbers, "visitor_token_hash", "left")
    block = F.coalesce(F.bitmap_bucket_number("number"), F.lit(0))
    return rows.groupBy("visit_date", "route", block.cast("long").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("visitors"),
        F.sum("visit_count").alias("visit_count"),
    )


def add_visits(store: Store, daily: DataFrame, stream: str, batch_id: int) -> None:
    """Add one batch of daily rows: numbers of new visitors and bitmaps, in one commit.

    A batch that was added before, or that stopped half-way, is not counted twice.
    """
    store.recover()
    if batch_id <= store.batch(stream):
        return
    rows = materialise(daily.select("visitor_token_hash", "visit_date", "route", "visit_count"), "visits")
    tokens = rows.select("visitor_token_hash")
    known = store.read("visitor_number", store.buckets_of(tokens))
    fresh = materialise(new_numbers(known, tokens, store.buckets), "visitors")
    changed = store.buckets_of(fresh)
    tables, touched = {}, {}
    if changed:
        tables["visitor_number"] = store.read("visitor_number", changed).unionByName(fresh)
        touched["visitor_number"] = changed
    increments = day_bitmaps(rows, known.unionByName(fresh))
    logs = [store.batch_rows("visit_bitmap", increments, f"{stream}-{batch_id}", "visit_date")]
    store.write(tables, touched, logs, store.marked(stream, batch_id))


def stored_bitmaps(store: Store) -> DataFrame:
    """Bitmaps of all batches; a filter on ``visit_date`` prunes folders."""
    return store.read_batches("visit_bitmap")


def counted(bitmaps: DataFrame, *keys: str | Column) -> DataFrame:
    """Visits and distinct visitors of each group of ``keys``, or of all rows."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = [(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names, strict=True)]
    blocks = bitmaps.groupBy(*keyed, "block").agg(
        F.bitmap_or_agg("visitors").alias("visitors"), F.sum("visit_count").alias("visits")
    )
    return blocks.groupBy(*names).agg(
        F.coalesce(F.sum("visits"), F.lit(0)).alias("visits"),
        F.coalesce(F.sum(F.bitmap_count("visitors")), F.lit(0)).alias("unique_visitors"),
    )


def visitor_totals(bitmaps: DataFrame) -> DataFrame:
    """All visits and distinct visitors."""
    return counted(bitmaps)


def visitor_categories(bitmaps: DataFrame) -> DataFrame:
    """The same per route."""
    return counted(bitmaps, "route").withColumnRenamed("_k0", "category")


def visitors_by(bitmaps: DataFrame, period: str, today: date) -> DataFrame:
    """Day, ISO week or month buckets, as :func:`visits.visits_by`."""
    recent = bitmaps.filter(F.col("visit_date") >= F.lit(visits.first_day(period, today)))
    return counted(recent, visits.period_label(period)).withColumnRenamed("_k0", "period")


def report(bitmaps: DataFrame, today: date) -> DataFrame:
    """Every section of the visit report, as :func:`visits.report`, from bitmaps alone."""
    # Days that several batches hold are joined first, before they are copied to the sections.
    days = bitmaps.groupBy("visit_date", "route", "block").agg(
        F.bitmap_or_agg("visitors").alias("visitors"), F.sum("visit_count").alias("visit_count")
    )
    rows = days.withColumn("_s", F.explode(visits.sections(today))).filter("_s.label IS NOT NULL")
    found = counted(rows, F.col("_s.section"), F.col("_s.label"))
    return visits.with_total(found.withColumnsRenamed({"_k0": "section", "_k1": "label"}))
