"""Anonymous visit analytics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions.text import token_hash

KEY = ("visitor_token_hash", "visit_date", "route")


def trackable(log: DataFrame) -> DataFrame:
    """Successful browser navigations to an HTML page."""
    agent = F.lower(F.coalesce("user_agent", F.lit("")))
    accept = F.lower(F.coalesce("accept", F.lit("")))
    path = F.col("path")
    excluded = path.isin(*fv.HEALTH_PATHS)
    for prefix in fv.EXCLUDED_PREFIXES:
        excluded = excluded | path.startswith(prefix)
    robot = F.lit(False)
    for marker in fv.BOT_MARKERS:
        robot = robot | agent.contains(marker)
    return log.filter(
        (F.col("method") == "GET")
        & F.col("status").between(200, 399)
        & (F.col("mime_type") == "text/html")
        & ~excluded
        & agent.startswith(fv.BROWSER_PREFIX)
        & ~robot
        & ((accept == "") | accept.contains("text/html"))
    )


def valid_token(c: Column) -> Column:
    """C14: a token we issued; anything else starts a new visitor."""
    return F.coalesce(c.rlike(r"^[\p{L}\p{N}_-]{32,128}\z"), F.lit(False))


def daily(visits: DataFrame) -> DataFrame:
    """Visits of one batch, one row per (token digest, UTC date, route)."""
    return visits.groupBy(*KEY).agg(
        F.count("*").alias("visit_count"),
        F.min("ts").alias("first_visited_at"),
        F.max("ts").alias("last_visited_at"),
    )


def visits_of(log: DataFrame, new_token: Column | None = None) -> DataFrame:
    """Log rows that count as visits, with the token replaced by its digest.

    A missing or malformed token becomes a new visitor; ``new_token`` supplies
    the replacement and defaults to a random one per request.
    """
    fresh = F.uuid() if new_token is None else new_token
    token = F.when(valid_token(F.col("visitor_token")), F.col("visitor_token")).otherwise(fresh)
    return trackable(log).select(
        token_hash(token).alias("visitor_token_hash"),
        F.to_date("ts").alias("visit_date"),
        F.lit(fv.VISIT_ROUTE).alias("route"),
        "ts",
    )


def upsert_visits(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored daily rows with a batch of daily rows added.

    The batch is already one row per key, so the merge is a single
    partially-aggregated shuffle whose key includes the visitor: one busy day
    or route cannot gather in one task.
    """
    return summed(current.unionByName(batch))


def summed(rows: DataFrame) -> DataFrame:
    """One row per visitor, day and route."""
    return (
        rows.groupBy(*KEY)
        .agg(
            F.sum("visit_count").alias("visit_count"),
            F.min("first_visited_at").alias("first_visited_at"),
            F.max("last_visited_at").alias("last_visited_at"),
        )
    )


def _measures() -> list[Column]:
    return [
        F.coalesce(F.sum("visit_count"), F.lit(0)).alias("visits"),
        F.count_distinct("visitor_token_hash").alias("unique_visitors"),
    ]


def visit_totals(visits: DataFrame) -> DataFrame:
    """All visits and distinct visitors."""
    return visits.agg(*_measures())


def visit_categories(visits: DataFrame) -> DataFrame:
    """The same per route."""
    return visits.groupBy(F.col("route").alias("category")).agg(*_measures())


def first_day(period: str, today: date) -> date:
    """First day that a series of ``period`` buckets looks at.

    It lies a fixed number of days back and is not aligned to the bucket, so the
    first week or month may be partial.
    """
    back = {"day": timedelta(days=6), "week": timedelta(weeks=11), "month": timedelta(days=366)}
    if period not in back:
        raise ValueError("period must be day, week or month")
    return today - back[period]


def period_label(period: str) -> Column:
    bucket = F.col("visit_date") if period == "day" else F.trunc("visit_date", period)
    return F.date_format(bucket, "yyyy-MM-dd")


def visits_by(visits: DataFrame, period: str, today: date) -> DataFrame:
    """Day, ISO week or month buckets; periods without visits are absent."""
    recent = visits.filter(F.col("visit_date") >= F.lit(first_day(period, today)))
    return recent.groupBy(period_label(period).alias("period")).agg(*_measures())


def sections(today: date) -> Column:
    """(section, label) of everything in the report that a row counts for; the label is NULL where it does not."""

    def recent(period: str) -> Column:
        return F.when(F.col("visit_date") >= F.lit(first_day(period, today)), period_label(period))

    labels = {
        "total": F.lit(""),
        "daily": recent("day"),
        "weekly": recent("week"),
        "monthly": recent("month"),
        "categories": F.coalesce("route", F.lit("")),
    }
    return F.array(*[F.struct(F.lit(s).alias("section"), c.alias("label")) for s, c in labels.items()])


def with_total(found: DataFrame) -> DataFrame:
    """Report rows, with the total even where there are no visits."""
    total = F.when(F.col("section") != "total", F.col("label"))
    rows = found.select("section", total.alias("label"), "visits", "unique_visitors")
    none = rows.sparkSession.createDataFrame([("total", None, 0, 0)], rows.schema)
    return rows.unionByName(none).groupBy("section", "label").agg(
        F.sum("visits").alias("visits"), F.sum("unique_visitors").alias("unique_visitors")
    )


def report(visits: DataFrame, today: date) -> DataFrame:
    """Every section of the visit report as (section, label, visits, unique_visitors).

    The visits are read once and first summed by visitor, day and route. All
    sections are then grouping sets of one expanded aggregation.
    """
    base = visits.groupBy(*KEY).agg(F.sum("visit_count").alias("visit_count"))
    rows = base.select("visitor_token_hash", "visit_count", F.explode(sections(today)).alias("_s"))
    rows = rows.filter("_s.label IS NOT NULL").select("_s.section", "_s.label", "visitor_token_hash", "visit_count")
    # By visitor first, so that a section with one label does not gather in one task.
    each = rows.groupBy("section", "label", "visitor_token_hash").agg(F.sum("visit_count").alias("n"))
    found = each.groupBy("section", "label").agg(F.sum("n").alias("visits"), F.count("visitor_token_hash").alias("unique_visitors"))
    return with_total(found)
