"""Adult screening of stored titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.schemas import Link
from reelshelf.session import broadcast_if_small


def _named(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*fv.ADULT_NAMES)


def adult_ids(items: DataFrame, links: DataFrame, genre: DataFrame, link: Link) -> DataFrame:
    """Titles flagged, linked to or tagged with a restricted genre.

    Flag and arrays are read where the rows lie; only the ids of restricted
    links are shuffled to find their titles.
    """
    tagged = F.lit(False)
    for column in ("genres", "genres_detailed"):
        # An unknown tag is not a restricted one.
        tagged = tagged | F.coalesce(F.exists(F.array_compact(column), _named), F.lit(False))
    by_row = items.filter(F.col("is_adult") | tagged).select(link.item)
    restricted = genre.filter(_named(F.col("name"))).select(F.col("id").alias(link.ref))
    linked = links.join(broadcast_if_small(restricted), link.ref, "left_semi").select(link.item)
    by_link = items.select(link.item).join(linked, link.item, "left_semi")
    return by_row.unionByName(by_link).distinct()


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of a title or bridge table whose title is not in ``gone``."""
    return rows.join(gone, key, "left_anti").select(*rows.columns)


def purge_adult(items: DataFrame, bridges: dict[str, DataFrame], genre_links: DataFrame, genre: DataFrame, link: Link):
    """Titles and their links without adult titles; also the removed ids."""
    gone = adult_ids(items, genre_links, genre, link)
    bridges = {name: without(rows, gone, link.item) for name, rows in bridges.items()}
    return without(items, gone, link.item), bridges, gone


def backfill_adult(items: DataFrame, links: DataFrame, genre: DataFrame, link: Link) -> DataFrame:
    """The adult flag derived from links and arrays where it was not set."""
    found = adult_ids(items, links, genre, link).withColumn("_found", F.lit(True))
    flag = F.coalesce("is_adult", F.lit(False)) | F.coalesce("_found", F.lit(False))
    return (
        items.join(found, link.item, "left").withColumn("is_adult", flag).select(*items.columns)
    )
