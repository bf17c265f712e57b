"""Field merge of provider entries into titles.

Rows carry the stored columns at top level and the cleaned entry in struct
``e``. A row whose ``e`` is NULL comes out unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions import text
from reelshelf.schemas import schema


def _given(flag: str, new: str, old: str) -> Column:
    """The new value whenever its field was present, even when that clears it."""
    return F.when(F.col(f"e.{flag}"), F.col(f"e.{new}")).otherwise(F.col(old))


def _or_old(new: str, old: str) -> Column:
    return F.coalesce(f"e.{new}", old)


def _common(now: Column) -> dict[str, Column]:
    return {
        "title": _or_old("title", "title"),
        "alternative_title": _or_old("alternative_title", "alternative_title"),
        "synopsis": _given("has_synopsis", "synopsis", "synopsis"),
        "score": _given("has_score", "score", "score"),
        "popularity": _or_old("popularity", "popularity"),
        "members": _or_old("members", "members"),
        "mal_url": _or_old("url", "mal_url"),
        "image_url": _or_old("image_url", "image_url"),
        "is_adult": F.col("e.is_adult"),
        "last_sync": now,
    }


def _apply(rows: DataFrame, merged: dict[str, Column], table: str) -> DataFrame:
    touched = F.col("e").isNotNull()
    return rows.select(
        *[
            F.when(touched, merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c)
            for c in schema(table).names
        ]
    )


def _type_after() -> Column:
    return text.anime_type(F.col("e.raw_type"), text.anime_type(F.col("type")))


def season_after() -> Column:
    """Season once the entry is applied to stored ``type`` and ``season``.

    Films have no season; a sparse TV entry must not erase a known one.
    """
    is_tv = _type_after() == "TV"
    season = F.coalesce("e.season_named", F.when(is_tv, F.col("e.season_aired")))
    return F.coalesce(season, F.when(is_tv, F.col("season")))


def merge_anime(rows: DataFrame, now: Column) -> DataFrame:
    """Anime titles with their entries applied."""
    no_tags = F.array().cast("array<string>")
    merged = _common(now) | {
        "type": _type_after(),
        "status": _or_old("status", "status"),
        "season": season_after(),
        "year": _given("has_year", "year", "year"),
        "episodes": _given("has_episodes", "episodes", "episodes"),
        "sequel": _given("has_relations", "sequel", "sequel"),
        "genres": F.when(F.size("e.genres") > 0, F.col("e.genres")).otherwise(F.col("genres")),
        "genres_detailed": F.array_union(F.coalesce("genres_detailed", no_tags), "e.tags"),
    }
    return _apply(rows, merged, "anime")


def new_anime(gated: DataFrame) -> DataFrame:
    """Blank titles for entries that have none, ready for the merge."""
    key = F.col("mal_id")
    defaults = {
        "anime_id": -key,
        "mal_id": key,
        "title": F.concat(F.lit(fv.ANIME_TITLE_FALLBACK), key.cast("string")),
        "mal_url": F.concat(F.lit(fv.ANIME_URL_FALLBACK), key.cast("string")),
        "type": F.lit("UNKNOWN"),
    }
    return _blank(gated, defaults, "anime")


def merge_manga(rows: DataFrame, expected: Column, now: Column) -> DataFrame:
    """Print titles with their entries applied."""
    merged = _common(now) | {
        # An unsupported type never reclassifies a title.
        "content_type": F.coalesce(_entry_print_type(expected), expected),
        "manga_type": F.when(F.col("e.has_type"), text.blank_to_null(F.col("e.raw_type"))).otherwise(
            F.col("manga_type")
        ),
        "publication_year": _given("has_published", "publication_year", "publication_year"),
        "status": _given("has_status", "status", "status"),
        "chapters": _given("has_chapters", "chapters", "chapters"),
        "volumes": _given("has_volumes", "volumes", "volumes"),
        "genres": _given("has_genres", "genres", "genres"),
        "genres_detailed": _given("has_tags", "tags", "genres_detailed"),
    }
    return _apply(rows, merged, "manga")


def _entry_print_type(expected: Column) -> Column:
    known = F.col("e.type_missing") | F.col("e.raw_type").isNotNull()
    return F.when(known, text.content_type(F.col("e.raw_type"), expected))


def new_manga(gated: DataFrame, expected: Column) -> DataFrame:
    """I4: blank print titles; ``gated`` has the assigned ``manga_id``."""
    key = F.col("mal_id")
    defaults = {
        "manga_id": F.col("manga_id"),
        "mal_id": key,
        "content_type": expected,
        "title": F.concat(F.lit(fv.MANGA_TITLE_FALLBACK), key.cast("string")),
        "mal_url": F.concat(F.lit(fv.MANGA_URL_FALLBACK), key.cast("string")),
    }
    return _blank(gated, defaults, "manga")


def _blank(gated: DataFrame, defaults: dict[str, Column], table: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    defaults = {
        "image_url": F.lit(""),
        "is_adult": F.lit(False),
        "sequel": F.lit(False),
        "genres": empty,
        "genres_detailed": empty,
        **defaults,
    }
    columns = [
        defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)
    ]
    return gated.select(*columns, "e")


def canonicalise(anime: DataFrame) -> DataFrame:
    """A10: stored anime type and status labels in canonical form."""
    kind = F.upper(F.trim("type"))
    for alias, canonical in fv.ANIME_TYPE_ALIASES.items():
        kind = F.when(F.replace(kind, F.lit("_"), F.lit(" ")) == alias, canonical).otherwise(kind)
    label = F.replace(F.upper(F.trim("status")), F.lit(" "), F.lit("_"))
    known = F.create_map(*[F.lit(x) for pair in fv.ANIME_STATUS_ALIASES.items() for x in pair])
    status = F.coalesce(F.try_element_at(known, label), F.col("status"))
    return anime.withColumn("type", kind).withColumn("status", status)


