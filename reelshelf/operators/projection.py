"""Output tiers, nested children and page hydration (B)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import filters
from reelshelf.schemas import ANIME, LINKS, MANGA, Link, Medium

TIERS = ("preview", "list", "detail")

IDENTITY = (
    "content_type",
    "record_id",
    "mal_id",
    "score",
    "popularity",
    "members",
    "title",
    "year",
    "length",
)


def identity(items: DataFrame, medium: Medium) -> DataFrame:
    """The nine columns that every medium shares."""
    kind = F.lit("ANIME") if medium is ANIME else F.col("content_type")
    return items.select(
        kind.alias("content_type"),
        F.col(medium.key).alias("record_id"),
        "mal_id",
        "score",
        "popularity",
        "members",
        "title",
        F.col(medium.year).alias("year"),
        F.col(medium.length).alias("length"),
    )


def nest(links: DataFrame, dim: DataFrame, link: Link, alias: str, value: Column, *order) -> DataFrame:
    """One sorted array of child structs per title.

    Children sort by the stored case-folded key first.

    The arrays are output values; callers narrow ``links`` to the titles they
    show, so only the children of those titles are gathered.
    """
    dim = dim.withColumnRenamed(link.dimension_key, link.ref)
    entry = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)], value.alias("_v"))
    return (
        links.join(dim, link.ref)
        .groupBy(link.item)
        .agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
        .select(link.item, F.transform("_entries", lambda e: e["_v"]).alias(alias))
    )


def _attach(items: DataFrame, children: DataFrame, key: str, alias: str) -> DataFrame:
    empty = F.array().cast(children.schema[alias].dataType)
    return items.join(children, key, "left").withColumn(alias, F.coalesce(alias, empty))


def _narrow(links: DataFrame, key: str, ids: list[int] | None) -> DataFrame:
    return links if ids is None else links.filter(F.col(key).isin(ids))


def _genres(items: DataFrame, cat, medium: Medium, ids) -> DataFrame:
    link = LINKS[medium.genre_links]
    links = _narrow(getattr(cat, medium.genre_links), link.item, ids)
    names = nest(links, cat.genre, link, "_genres", F.col("name"), F.col("name"))
    items = _attach(items, names, medium.key, "_genres")
    # The stored array of the same name gives way to the linked genres.
    return items.drop("genres").withColumnRenamed("_genres", "genres")


def project_anime(items: DataFrame, cat, tier: str = "list", ids: list[int] | None = None):
    """B1: anime rows at one of three levels of detail."""
    columns = [
        F.col("anime_id").alias("id"),
        "mal_id",
        F.lit("ANIME").alias("content_type"),
        "title",
        "type",
        "season",
        "year",
        "score",
        "popularity",
        "members",
        "episodes",
        "image_url",
        "genres",
    ]
    out = _genres(items, cat, ANIME, ids)
    if tier != "preview":
        studio = F.struct("mal_id", "name")
        links = _narrow(cat.anime_studio, "anime_id", ids).select("anime_id", "studio_id")
        studios = nest(links, cat.studio, LINKS["studio"], "studios", studio, F.col("normalized_name"))
        out = _attach(out, studios, "anime_id", "studios")
        service = F.struct("name", "url")
        links = _narrow(cat.anime_streaming_service, "anime_id", ids)
        dim = cat.streaming_service.select("name", "normalized_name")
        key = F.col("service_key")
        services = nest(
            links, dim, LINKS["streaming_service"], "streaming_services", service, key
        )
        out = _attach(out, services, "anime_id", "streaming_services")
        columns += [
            "alternative_title",
            "status",
            "mal_url",
            "sequel",
            "studios",
            "streaming_services",
        ]
    if tier == "detail":
        columns += ["synopsis", "genres_detailed", _iso("last_sync").alias("last_sync")]
    return out.select(*columns)


def project_manga(items: DataFrame, cat, tier: str = "list", ids: list[int] | None = None):
    """B2: print rows at one of three levels of detail."""
    columns = [
        F.col("manga_id").alias("id"),
        "mal_id",
        "content_type",
        "title",
        F.col("manga_type").alias("type"),
        "manga_type",
        F.col("publication_year").alias("year"),
        "publication_year",
        "score",
        "popularity",
        "members",
        "chapters",
        "volumes",
        "image_url",
        "genres",
    ]
    out = _genres(items, cat, MANGA, ids)
    if tier != "preview":
        links = _narrow(cat.manga_author, "manga_id", ids)
        author = F.struct("mal_id", "name", "role")
        order = [F.col("normalized_name"), F.coalesce("role", F.lit(""))]
        authors = nest(links, cat.author, LINKS["author"], "authors", author, *order)
        out = _attach(out, authors, "manga_id", "authors")
        columns += ["alternative_title", "status", "mal_url", "authors"]
    if tier == "detail":
        tags = F.coalesce("genres_detailed", F.array().cast("array<string>"))
        columns += [
            "synopsis",
            tags.alias("genres_detailed"),
            _iso("last_sync").alias("last_sync"),
        ]
    return out.select(*columns)


def _iso(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def hydrate(page: DataFrame, cat, tier: str = "list") -> DataFrame:
    """Full rows of one page, each with its global ``rank``.

    A page holds at most 100 identity rows. Their ids become literals, so the
    scans of titles and links prune row groups instead of joining.
    """
    spark = page.sparkSession
    found = page.select("content_type", "record_id", "rank").take(fv.PER_PAGE_MAX + 1)
    if len(found) > fv.PER_PAGE_MAX:
        raise ValueError(f"a page has at most {fv.PER_PAGE_MAX} rows")
    ranks = spark.createDataFrame(found, "content_type string, id bigint, rank bigint")
    anime_ids = [r.record_id for r in found if r.content_type == "ANIME"]
    print_ids = [r.record_id for r in found if r.content_type != "ANIME"]
    cat = cat.picked(anime_ids, print_ids)
    anime = filters.public(cat.anime).filter(F.col("anime_id").isin(anime_ids))
    manga = filters.public(cat.manga).filter(F.col("manga_id").isin(print_ids))
    rows = project_anime(anime, cat, tier, anime_ids).unionByName(
        project_manga(manga, cat, tier, print_ids), allowMissingColumns=True
    )
    return rows.join(F.broadcast(ranks), ["content_type", "id"])


def detail(cat, content_type: str, mal_id: int) -> DataFrame:
    """One public record by type and provider id; empty when missing."""
    kind = content_type.strip().upper()
    if kind == "ANIME":
        found = filters.public(cat.anime).filter(F.col("mal_id") == mal_id)
        ids = _keys(found, ANIME)
        cat = cat.picked(ids, [])
        return project_anime(filters.public(cat.anime).filter(F.col("anime_id").isin(ids)), cat, "detail", ids)
    if kind not in fv.PRINT_TYPES.values():
        raise ValueError("content_type must be ANIME, MANGA, or MANHWA")
    found = filters.public(cat.manga).filter((F.col("mal_id") == mal_id) & (F.col("content_type") == kind))
    ids = _keys(found, MANGA)
    cat = cat.picked([], ids)
    return project_manga(filters.public(cat.manga).filter(F.col("manga_id").isin(ids)), cat, "detail", ids)


def _keys(found: DataFrame, medium: Medium) -> list[int]:
    """Key of the one title with a provider id: read first, so that it prunes every other scan."""
    return [r[0] for r in found.select(medium.key).take(2)]
