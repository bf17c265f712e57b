"""Run statistics: change logs, refresh health, scan totals, scan state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv

HANDLED = ("updated", "removed_adult", "removed_unsupported")
OUTCOMES = (*HANDLED, "missing_mal_id", "not_found", "temporary", "invalid_payload", "unexpected")


def reconcile_stats(log: DataFrame) -> DataFrame:
    """Link changes per phase and entity kind, with totals over all phases.

    ``phase`` is NULL in the total rows.
    """
    touched = (F.col("created") + F.col("removed") + F.col("changed")) > 0
    counted = log.groupBy("entity", "phase").agg(
        F.count("*").alias("processed"),
        F.count_if(touched).alias("titles_updated"),
        F.sum("created").alias("created"),
        F.sum("removed").alias("removed"),
        F.sum("changed").alias("changed"),
        F.sum("malformed").alias("malformed"),
        F.count_if(F.col("malformed") > 0).alias("failures"),
    )
    sums = [F.sum(c).alias(c) for c in counted.columns[2:]]
    totals = counted.groupBy("entity").agg(*sums).withColumn("phase", F.lit(None).cast("string"))
    return counted.unionByName(totals)


def refresh_health(outcomes: DataFrame) -> DataFrame:
    """Outcomes per queue, success rate and the degraded flag."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    out = outcomes.groupBy("queue").agg(F.count("*").alias("selected"), *counts)
    handled = sum((F.col(h) for h in HANDLED), F.lit(0))
    out = out.withColumn("success_rate", handled / F.col("selected"))
    degraded = (F.col("selected") >= fv.DEGRADED_MIN_SELECTED) & (
        F.col("success_rate") < fv.DEGRADED_RATE
    )
    return out.withColumn("degraded", degraded)


def scan_summary(results: DataFrame) -> DataFrame:
    """Page and title counters per provider type, and the grand total.

    ``provider_type`` is NULL in the total row.
    """
    names = ("pages_completed", "pages_failed", "inserted", "updated", "removed")
    return results.rollup("provider_type").agg(*[F.sum(n).alias(n) for n in names])


def refused_pages(refused: DataFrame, results: DataFrame, state: DataFrame) -> DataFrame:
    """Pages that are open: refused when they last landed, in a part of the scan that still exists.

    ``refused`` and ``state`` are what earlier batches left. ``results`` has
    ``scan_key``, ``page``, ``has_next_page``, ``seen_at``, ``error`` and ``closes``:
    the first page that, by this response, the scan does not have (any more). A
    scan that ends closes all pages from there on which were refused before; what is
    refused afterwards belongs to its next cycle. Responses of one moment count in the
    order of their pages. Only refused pages and ends of a scan meet in one task.
    """
    known = refused.select("scan_key", "page", "seen_at", F.col("reason").alias("error"))
    latest = known.unionByName(results.select(known.columns)).groupBy("scan_key", "page")
    latest = latest.agg(F.max_by(F.struct("error", "seen_at"), F.struct("seen_at", "error")).alias("r"))
    pages = latest.filter("r.error IS NOT NULL").select(
        "scan_key", "page", F.col("r.error").alias("reason"), F.col("r.seen_at").alias("seen_at"), F.col("page").alias("at")
    )
    ends = results.filter("closes IS NOT NULL").groupBy("scan_key", "seen_at").agg(F.min("closes").alias("at"))
    earlier = state.filter("closed_from IS NOT NULL").select(
        F.col("key").alias("scan_key"), F.col("closed_at").alias("seen_at"), F.col("closed_from").alias("at")
    )
    events = pages.unionByName(ends.unionByName(earlier), allowMissingColumns=True)
    after = Window.partitionBy("scan_key").orderBy(F.desc("seen_at"), F.desc("at"), F.desc("page"))
    closed_from = F.min(F.when(F.col("page").isNull(), F.col("at"))).over(
        after.rowsBetween(Window.unboundedPreceding, -1)
    )
    events = events.withColumn("closed_from", closed_from).filter("page IS NOT NULL")
    still = F.col("closed_from").isNull() | (F.col("page") < F.col("closed_from"))
    return events.filter(still).select("scan_key", "page", "reason", "seen_at")


def advance_state(state: DataFrame, results: DataFrame, refused: DataFrame) -> DataFrame:
    """Scan state after a batch of pages.

    ``refused`` is what :func:`refused_pages` gives for the batch. The smallest page
    that is open stays current, keeps its error and blocks completion, whatever came
    after it. Without one the latest page decides: a page in the middle moves the
    cursor on, the last page resets it to 1 and marks completion. ``cycle`` counts
    how often the scan came to an end; ``closed_at`` and ``closed_from`` tell when
    it last did, and the first page it did not have then.
    """
    fields = F.struct("page", "has_next_page", "seen_at")
    done = F.col("error").isNull() & ~F.col("has_next_page")
    end = F.when(F.col("closes").isNotNull(), F.struct("seen_at", "closes"))
    last = results.groupBy(F.col("scan_key").alias("key")).agg(
        F.max_by(fields, F.struct("seen_at", "page", "has_next_page")).alias("r"),
        F.max(F.when(done, F.col("seen_at"))).alias("_done"),
        F.count("closes").alias("_ends"),
        F.max(end).alias("_end"),
    )
    pinned = refused.groupBy(F.col("scan_key").alias("key")).agg(
        F.min_by(F.struct("page", "reason"), "page").alias("p")
    )
    moved = F.when(F.col("p").isNotNull(), F.col("p.page")).when(F.col("r.has_next_page"), F.col("r.page") + 1)
    seen = F.col("r").isNotNull()
    error = F.substring("p.reason", 1, fv.STATE_ERROR_LENGTH)
    finished = F.when(F.col("p").isNull(), F.col("_done"))
    before = F.when(F.col("closed_from").isNotNull(), F.struct(F.col("closed_at").alias("seen_at"), F.col("closed_from").alias("closes")))
    last = last.join(pinned, "key", "left")
    out = state.join(last, "key", "full_outer").withColumn("_end", F.greatest("_end", before))
    return out.select(
        "key",
        F.when(seen, moved.otherwise(1)).otherwise(F.col("next_page")).cast("int").alias("next_page"),
        F.when(seen, F.col("r.seen_at")).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
        F.coalesce(finished, "last_completed_at").alias("last_completed_at"),
        F.when(seen, error).otherwise(F.col("last_error")).alias("last_error"),
        (F.coalesce("cycle", F.lit(0)) + F.coalesce("_ends", F.lit(0))).cast("long").alias("cycle"),
        F.col("_end.seen_at").alias("closed_at"),
        F.col("_end.closes").cast("int").alias("closed_from"),
    )
