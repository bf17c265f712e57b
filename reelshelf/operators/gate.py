"""Which entries of a page may be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import text


def _is_tv(label: Column) -> Column:
    return F.coalesce(F.upper(text.strip(label)) == "TV", F.lit(False))


def prepare_season(rows: DataFrame, year: int | None, season: str | None) -> DataFrame:
    """The requested year always wins, the season only for TV or no type."""
    if year is not None:
        rows = rows.withColumn("has_year", F.lit(True)).withColumn("year", F.lit(year))
    if season is not None:
        applies = F.col("type_missing") | _is_tv(F.col("raw_type"))
        chosen = F.when(applies, F.lit(season)).otherwise(F.col("season_named"))
        rows = rows.withColumn("season_named", chosen)
    return rows


def gate_anime(
    rows: DataFrame,
    *,
    year: int | None = None,
    season: str | None = None,
    tv_only: bool = False,
    allowed_types: tuple[str, ...] | None = None,
    default_type: str | None = None,
) -> DataFrame:
    """I15 for anime pages; see :func:`_last_per_title`."""
    rows = prepare_season(rows, year, season)
    if default_type is not None:
        rows = rows.withColumn("raw_type", F.coalesce("raw_type", F.lit(default_type)))
    passes = F.lit(True)
    if tv_only:
        passes = passes & _is_tv(F.col("raw_type"))
    if allowed_types is not None:
        passes = passes & text.anime_type(F.col("raw_type")).isin(*allowed_types)
    if tv_only and season is not None:
        rows = rows.withColumn("season_named", F.lit(season))
    return _last_per_title(rows, passes)


def print_type(expected: Column) -> Column:
    """H12 on cleaned columns: a type that is neither text nor null is unsupported."""
    known = F.col("type_missing") | F.col("raw_type").isNotNull()
    return F.when(known, text.content_type(F.col("raw_type"), expected))


def gate_manga(rows: DataFrame, expected: str) -> DataFrame:
    """I15 for print pages: only the expected content type passes."""
    passes = F.coalesce(print_type(F.lit(expected)) == expected, F.lit(False))
    return _last_per_title(rows, passes)


def _last_per_title(rows: DataFrame, passes: Column) -> DataFrame:
    """One row per provider id: ``adult``, or the last passing ``entry``.

    An adult entry wins over every duplicate on its page; over pages the last
    one decides. Both steps combine inside each task before they shuffle, so a
    provider id with very many copies does not gather anywhere.
    """
    fields = [c for c in rows.columns if c not in ("scan_key", "page", "pos")]
    entry = F.struct("page", "pos", *fields)
    clean = ~F.col("is_adult") & passes
    per_page = (
        rows.filter(F.col("mal_id").isNotNull())
        .groupBy("mal_id", "page")
        .agg(
            F.max("is_adult").alias("adult"),
            F.max_by(entry, F.when(clean, F.col("pos"))).alias("entry"),
            F.min(F.when(clean, F.col("pos"))).alias("first"),
        )
        .filter("adult OR entry IS NOT NULL")
    )
    last = F.max_by(F.struct("adult", "entry"), "page").alias("_last")
    return (
        per_page.groupBy("mal_id")
        .agg(last, F.min(F.struct("page", "first")).alias("first"))
        .select(
            "mal_id",
            F.col("_last.adult").alias("adult"),
            F.when(~F.col("_last.adult"), F.col("_last.entry")).alias("e"),
            "first",
        )
    )


def gate_counts(rows: DataFrame, gated: DataFrame) -> DataFrame:
    """Entries seen, titles kept, adult ids, and entries skipped."""
    seen = rows.agg(F.count("*")).scalar()
    out = gated.agg(
        F.count_if(~F.col("adult")).alias("kept"), F.count_if("adult").alias("adult_ids")
    )
    out = out.withColumn("entries", seen)
    return out.withColumn("skipped", F.col("entries") - F.col("kept"))
