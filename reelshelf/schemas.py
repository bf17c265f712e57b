"""Table schemas and the shape of each medium."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_TITLE_COMMON = (
    "mal_id bigint, title string, alternative_title string, synopsis string, "
    "score double, popularity bigint, members bigint, is_adult boolean, "
    "mal_url string, image_url string, genres array<string>, "
    "genres_detailed array<string>, last_sync timestamp, last_attempt timestamp"
)

DDL = {
    "anime": f"anime_id bigint, {_TITLE_COMMON}, type string, season string, "
    "status string, year int, episodes int, sequel boolean, "
    "last_streaming_attempt timestamp, last_season_attempt timestamp",
    "manga": f"manga_id bigint, {_TITLE_COMMON}, content_type string, "
    "manga_type string, publication_year int, status string, chapters int, volumes int",
    "genre": "id bigint, name string",
    "studio": "id bigint, mal_id bigint, name string, normalized_name string",
    "streaming_service": "name string, normalized_name string",
    "author": "id bigint, mal_id bigint, name string, normalized_name string",
    "anime_genre": "anime_id bigint, genre_id bigint",
    "manga_genre": "manga_id bigint, genre_id bigint",
    "anime_studio": "anime_id bigint, studio_id bigint",
    "anime_streaming_service": "anime_id bigint, service_key string, url string",
    "manga_author": "manga_id bigint, author_id bigint, role string",
    "catalogue_facet": "content_type string, facet_type string, value string",
    "sync_state": "key string, next_page int, last_attempt_at timestamp, "
    "last_completed_at timestamp, last_error string, cycle bigint, closed_at timestamp, closed_from int",
    "refused_pages": "scan_key string, page int, reason string, seen_at timestamp",
    "anime_directory": "mal_id bigint, item_id bigint",
    "manga_directory": "mal_id bigint, item_id bigint",
    "run_titles": "queue string, medium string, item_id bigint, outcome string",
    "scan_titles": "provider_type string, medium string, item_id bigint, outcome string",
    "scan_links": "entity string, item_id bigint, created bigint, removed bigint, changed bigint, "
    "malformed bigint, phase string",
    "scan_pages": "provider_type string, pages_completed bigint, pages_failed bigint",
    "site_visit": "visitor_token_hash string, visit_date date, route string, "
    "visit_count bigint, first_visited_at timestamp, last_visited_at timestamp",
    "visitor_number": "visitor_token_hash string, number bigint",
    "visit_bitmap": "visit_date date, route string, block bigint, visitors binary, visit_count bigint",
    "landed_pages": "scan_key string, page int, status_code int, fetched_at timestamp, body string",
    "landed_details": "kind string, mal_id bigint, status_code int, "
    "fetched_at timestamp, body string",
    "access_log": "method string, status int, mime_type string, path string, "
    "user_agent string, accept string, visitor_token string, ts timestamp",
}


def schema(table: str) -> T.StructType:
    """Explicit schema of a table; data files are never inferred."""
    return T.StructType.fromDDL(DDL[table])


@dataclass(frozen=True)
class Medium:
    """Column names in which the two title tables differ."""

    name: str
    key: str
    year: str
    length: str
    genre_links: str


ANIME = Medium("anime", "anime_id", "year", "episodes", "anime_genre")
MANGA = Medium("manga", "manga_id", "publication_year", "chapters", "manga_genre")


@dataclass(frozen=True)
class Link:
    """A bridge table: title key, entity key, and the dimension's columns."""

    table: str
    item: str
    ref: str
    dimension: str
    dimension_key: str
    match: str


LINKS = {
    "anime_genre": Link("anime_genre", "anime_id", "genre_id", "genre", "id", "name"),
    "manga_genre": Link("manga_genre", "manga_id", "genre_id", "genre", "id", "name"),
    "studio": Link("anime_studio", "anime_id", "studio_id", "studio", "id", "normalized_name"),
    "streaming_service": Link(
        "anime_streaming_service",
        "anime_id",
        "service_key",
        "streaming_service",
        "normalized_name",
        "normalized_name",
    ),
    "author": Link("manga_author", "manga_id", "author_id", "author", "id", "normalized_name"),
}
