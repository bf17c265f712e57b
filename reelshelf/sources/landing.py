"""Landed provider responses: page envelopes and detail outcomes (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions import payload as p
from reelshelf.functions import text
from reelshelf.schemas import schema


def landed_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landing rows from a table (``parquet``, ``json``) or raw files (``text``).

    Raw files lie under ``scan_key=.../page=...``, one response per file.
    """
    if fmt != "text":
        return spark.read.schema(schema("landed_pages")).format(fmt).load(path)
    raw = spark.read.schema("value string, scan_key string, page int")
    return raw.text(path, wholetext=True).select(
        "scan_key",
        "page",
        F.lit(200).alias("status_code"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.col("value").alias("body"),
    )


def _problem(body: Column, page: Column, kind: str) -> Column:
    """Why an envelope is not acceptable; NULL when it is."""
    data = p.array(body, "data")
    more = p.boolean(body, "pagination.has_next_page")
    reason = F.when(data.isNull(), "data is not a list").when(more.isNull(), "invalid pagination")

    last_given = p.given(body, "pagination.last_visible_page")
    last = p.integer(body, "pagination.last_visible_page")
    bad_last = last_given & F.coalesce(last <= 0, F.lit(True))
    if kind == "season":
        return reason
    if kind == "anime":
        return reason.when(bad_last, "invalid pagination")

    current_given = p.given(body, "pagination.current_page")
    current = p.integer(body, "pagination.current_page")
    count = F.size(F.filter(data, lambda e: p.is_object(e)))
    return (
        reason.when(current_given & F.coalesce(current != page, F.lit(True)), "wrong page")
        .when(bad_last, "invalid pagination")
        .when(more & (count == 0), "empty nonterminal page")
        .when(more & (page >= last), "inconsistent pagination")
        .when(~more & (count > 0) & (page != last), "inconsistent terminal page")
    )


def check_pages(landed: DataFrame, kind: str) -> DataFrame:
    """A1: landed pages of one kind (season, anime or manga) with a verdict.

    ``reason`` says why a page was refused; only accepted pages have a parsed
    ``body``. Nothing is filtered here, so each page is parsed once. A missing
    status code counts as success.
    """
    if kind not in ("season", "anime", "manga"):
        raise ValueError("kind must be season, anime or manga")
    parsed = landed.withColumn("_body", F.try_parse_json("body"))
    code = F.col("status_code")
    reason = F.when(code >= 400, F.concat(F.lit("HTTP "), code.cast("string")))
    reason = reason.when(~p.is_object(F.col("_body")), "not an object")
    reason = reason.otherwise(_problem(F.col("_body"), F.col("page"), kind))
    checked = parsed.withColumn("reason", reason)
    return checked.select(
        "scan_key",
        "page",
        "status_code",
        "fetched_at",
        "reason",
        p.boolean(F.col("_body"), "pagination.has_next_page").alias("has_next_page"),
        F.when(F.col("reason").isNull(), F.col("_body")).alias("body"),
    )


def read_pages(landed: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """A1: (valid, rejected) pages; the scan of a rejected one does not advance."""
    checked = check_pages(landed, kind)
    valid = checked.filter(F.col("reason").isNull()).drop("reason", "status_code")
    rejected = checked.filter(F.col("reason").isNotNull()).drop("body", "has_next_page")
    return valid, rejected


def entries(pages: DataFrame) -> DataFrame:
    """Objects of the ``data`` list of each accepted page, with their position."""
    data = p.array(F.col("body"), "data")
    rows = pages.select("scan_key", "page", F.posexplode(data).alias("pos", "entry"))
    return rows.filter(p.is_object(F.col("entry")))


def classify_fetch(landed: DataFrame, kind: str) -> DataFrame:
    """A2: detail responses with ``outcome`` and, when usable, ``entry``.

    Outcomes are ok, not_found, temporary, invalid_payload and, for print
    titles only, unsupported_type. A missing status means the fetch never
    completed. Any other status is reported as unexpected.
    """
    parsed = landed.withColumn(
        "_data", F.try_variant_get(F.try_parse_json("body"), "$.data", "variant")
    )
    data, code = F.col("_data"), F.col("status_code")
    usable = p.is_object(data)
    outcome = (
        F.when(code == 404, "not_found")
        .when(code.isNull() | code.isin(*fv.TEMPORARY_STATUS_CODES), "temporary")
        .when(code >= 400, "unexpected")
        .when(~usable, "invalid_payload")
    )
    if kind == "manga":
        same = F.coalesce(p.integer(data, "mal_id") == F.col("mal_id"), F.lit(False))
        label = F.lower(text.blank_to_null(p.string(data, "type")))
        outcome = outcome.when(~same, "invalid_payload").when(
            ~label.isin(*fv.PRINT_TYPES), "unsupported_type"
        )
    outcome = outcome.otherwise("ok")
    return parsed.withColumn("outcome", outcome).select(
        "mal_id",
        "fetched_at",
        "outcome",
        F.when(F.col("outcome") == "ok", data).alias("entry"),
    )
