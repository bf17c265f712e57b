"""Counts, bounds, coverage and facet tables (E, F6, F7, G2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions.text import casefold
from reelshelf.operators import filters
from reelshelf.operators.ranking import Key, global_rank, slice_rows
from reelshelf.schemas import LINKS

BOUNDED = ("year", "score", "episodes", "chapters", "volumes")


def total(rows: DataFrame, per_page: int) -> DataFrame:
    """Exact row count and page count."""
    pages = F.ceil(F.col("total") / per_page).cast("bigint")
    return rows.agg(F.count("*").alias("total")).withColumn("pages", pages)


def filter_ranges(cat, content_types: frozenset[str]) -> DataFrame:
    """Min and max of each numeric filter; NULL without data."""
    branches = []
    if "ANIME" in content_types:
        branches.append((filters.public(cat.anime), {"year": "year", "episodes": "episodes"}))
    if content_types & set(fv.PRINT_TYPES.values()):
        rows = filters.scope(filters.public(cat.manga), content_types)
        columns = {"year": "publication_year", "chapters": "chapters", "volumes": "volumes"}
        branches.append((rows, columns))
    parts = []
    for rows, columns in branches:
        columns = {**columns, "score": "score"}
        aggs = []
        for name in BOUNDED:
            kind = "double" if name == "score" else "bigint"
            c = F.col(columns[name]) if name in columns else F.lit(None)
            aggs += [
                F.min(c).cast(kind).alias(f"min_{name}"),
                F.max(c).cast(kind).alias(f"max_{name}"),
            ]
        parts.append(rows.agg(*aggs))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.agg(
        *[f(f"{p}_{n}").alias(f"{p}_{n}") for n in BOUNDED for p, f in (("min", F.min), ("max", F.max))]
    )


def freshness(cat, content_types: frozenset[str]) -> DataFrame:
    """Latest sync time of the scope's public titles, as ISO text."""
    times = []
    if "ANIME" in content_types:
        times.append(filters.public(cat.anime).select("last_sync"))
    if content_types & set(fv.PRINT_TYPES.values()):
        rows = filters.scope(filters.public(cat.manga), content_types)
        times.append(rows.select("last_sync"))
    both = times[0] if len(times) == 1 else times[0].unionByName(times[1])
    latest = F.date_format(F.max("last_sync"), "yyyy-MM-dd'T'HH:mm:ss")
    return both.agg(latest.alias("updated_at"))


def season_coverage(anime: DataFrame) -> DataFrame:
    """Share of TV titles that have a season."""
    tv = F.upper("type") == "TV"
    return anime.agg(
        F.count_if(tv).alias("total_tv"),
        F.count_if(tv & F.col("season").isNotNull()).alias("classified_tv"),
    ).withColumn(
        "rate",
        F.when(F.col("total_tv") > 0, F.col("classified_tv") / F.col("total_tv")).otherwise(0.0),
    )


def metric_coverage(cat) -> DataFrame:
    """E5: public titles with popularity and member counts, per content type."""
    anime = filters.public(cat.anime).select(
        F.lit("ANIME").alias("content_type"), "popularity", "members"
    )
    manga = filters.scope(filters.public(cat.manga), frozenset(fv.PRINT_TYPES.values()))
    counted = anime.unionByName(manga.select("content_type", "popularity", "members"))
    counted = counted.groupBy("content_type").agg(
        F.count("*").alias("total"),
        F.count("popularity").alias("with_popularity"),
        F.count("members").alias("with_members"),
    )
    # A content type without titles is still reported, with zeros.
    kinds = cat.anime.sparkSession.createDataFrame([(k,) for k in fv.SCOPES["ALL"]], "content_type string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in counted.columns[1:]]
    return kinds.join(counted, "content_type", "left").select("content_type", *zero)


def _linked_names(items: DataFrame, cat, link_name: str, facet: str) -> DataFrame:
    """Distinct (content type, entity name) pairs of linked public titles.

    Pairs are deduplicated on ids before the dimension join: partial
    aggregation inside each task collapses even an entity that holds a third
    of all links, and the dimension meets a few rows per entity.
    """
    link = LINKS[link_name]
    dim = getattr(cat, link.dimension).select(
        F.col(link.dimension_key).alias(link.ref), F.col("name").alias("value")
    )
    used = (
        getattr(cat, link.table)
        .join(items.select(link.item, "content_type"), link.item)
        .select("content_type", link.ref)
        .distinct()
    )
    return used.join(dim, link.ref).select(
        "content_type", F.lit(facet).alias("facet_type"), "value"
    )


def _tags(items: DataFrame) -> DataFrame:
    return items.select(
        "content_type", F.lit("tag").alias("facet_type"), F.explode("genres_detailed").alias("value")
    )


def facet_source(cat) -> DataFrame:
    """The seven facet branches as one stream of raw values."""
    anime = filters.public(cat.anime).withColumn("content_type", F.lit("ANIME"))
    manga = filters.public(cat.manga)
    branches = [
        _linked_names(anime, cat, "anime_genre", "genre"),
        _linked_names(manga, cat, "manga_genre", "genre"),
        _tags(anime),
        _tags(manga),
        _linked_names(anime, cat, "studio", "studio"),
        _linked_names(anime, cat, "streaming_service", "streaming_service"),
        _linked_names(manga, cat, "author", "author"),
    ]
    out = branches[0]
    for branch in branches[1:]:
        out = out.unionByName(branch)
    return out


def build_facets(cat) -> DataFrame:
    """Distinct filter options without blanks and adult names."""
    trimmed = F.trim("value")
    return (
        facet_source(cat)
        .filter((trimmed != "") & ~F.lower(trimmed).isin(*fv.ADULT_NAMES))
        .select(
            "content_type", "facet_type", F.substring(trimmed, 1, fv.FACET_VALUE_LENGTH).alias("value")
        )
        .distinct()
    )


def _facet_values(facets: DataFrame, content_types: frozenset[str], facet: str) -> DataFrame:
    return (
        facets.filter(
            F.col("content_type").isin(sorted(content_types)) & (F.col("facet_type") == facet)
        )
        .select("value")
        .distinct()
    )


def facet_page(facets, content_types, facet: str, q: str, offset: int, limit: int) -> DataFrame:
    """one page of options; ``has_more`` tells whether another row follows."""
    if not 1 <= limit <= fv.FACET_PAGE_MAX or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset must not be negative")
    values = _facet_values(facets, content_types, facet)
    if q.strip():
        values = values.filter(F.contains(F.lower("value"), F.lower(F.lit(q.strip()))))
    rows = slice_rows(values, [Key(F.col("value"))], offset, limit + 1)
    more = rows.agg(F.count("*") > limit).scalar()
    return rows.filter(F.col("rank") <= offset + limit).withColumn("has_more", more)


def facet_values(facets, content_types, facet: str, q: str = "") -> DataFrame:
    """all options in order, optionally those containing ``q``."""
    values = _facet_values(facets, content_types, facet)
    if q.strip():
        folded = casefold(F.col("value"))
        values = values.filter(F.contains(folded, F.lit(q.strip().casefold())))
    return global_rank(values, [F.col("value").asc()])
