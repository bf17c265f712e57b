"""Filters, joins, sorts, paging and projections of the catalogue."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import filters, profile, projection, ranking
from reelshelf.plans.spec import CatalogueQuery, preset
from reelshelf.queries.registry import query
from reelshelf.schemas import ANIME, LINKS, MANGA
from reelshelf.sources.bindings import catalogue, view

# --- SQL shared by several oracles ------------------------------------------

IDENTITY_SQL = """SELECT 'ANIME' AS content_type, anime_id AS record_id, mal_id, score, popularity, members, title,
  CAST(year AS BIGINT) AS year, CAST(episodes AS BIGINT) AS length FROM {anime} WHERE NOT is_adult
UNION ALL SELECT content_type, manga_id, mal_id, score, popularity, members, title,
  CAST(publication_year AS BIGINT), CAST(chapters AS BIGINT) FROM {manga} WHERE NOT is_adult"""

TAIL = "content_type, mal_id NULLS LAST, record_id"
ORDERS = {
    "top_rated": f"score DESC NULLS LAST, lower(title), title, {TAIL}",
    "newest": f"year DESC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
    "oldest": f"year ASC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
    "title": f"lower(title), title, score DESC NULLS LAST, {TAIL}",
    "most_popular": f"popularity ASC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
    "most_members": f"members DESC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
    "most_episodes": f"length DESC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
    "most_chapters": f"length DESC NULLS LAST, score DESC NULLS LAST, lower(title), title, {TAIL}",
}


def ids(rows, key):
    return rows.select(F.col(key).alias("id"))


# --- A3, B4, G1 -------------------------------------------------------------


@query(
    "a3_public_scan",
    """SELECT anime_id, mal_id, title, type, season, year, score, popularity, members, episodes, image_url
FROM {anime} WHERE NOT is_adult""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return filters.public(cat.anime).select(
        "anime_id",
        "mal_id",
        "title",
        "type",
        "season",
        "year",
        "score",
        "popularity",
        "members",
        "episodes",
        "image_url",
    )


@query("b4_identity_rows", "SELECT content_type, record_id, mal_id, score, popularity, members, title, year, length FROM {rows} WHERE content_type = 'ANIME'", rows=IDENTITY_SQL)
def _(spark, sf):
    return catalogue(spark, sf).identity_rows(CatalogueQuery(scope="ANIME"))


@query("g1_union_branches", "SELECT * FROM {rows}", rows=IDENTITY_SQL)
def _(spark, sf):
    return catalogue(spark, sf).identity_rows(CatalogueQuery())


# --- C: filters -------------------------------------------------------------


@query(
    "c1_scope",
    "SELECT manga_id AS id, content_type, title FROM {manga} WHERE NOT is_adult AND content_type IN ('MANHWA')",
)
def _(spark, sf):
    rows = filters.scope(filters.public(view(spark, sf, "manga")), CatalogueQuery(scope="manhwa").content_types)
    return rows.select(F.col("manga_id").alias("id"), "content_type", "title")


@query(
    "c2_search",
    r"""SELECT content_type, record_id, title FROM (
SELECT 'ANIME' AS content_type, anime_id AS record_id, title, alternative_title, is_adult FROM {anime}
UNION ALL SELECT content_type, manga_id, title, alternative_title, is_adult FROM {manga}) AS t
WHERE NOT is_adult AND (title ILIKE '%#1%' ESCAPE '\' OR alternative_title ILIKE '%#1%' ESCAPE '\')""",
)
def _(spark, sf):
    rows = catalogue(spark, sf).identity_rows(CatalogueQuery(q=" #1 "))
    return rows.select("content_type", "record_id", "title")


@query(
    "c3_score_year_range",
    "SELECT content_type, record_id, score, year FROM {rows} WHERE score >= 6.5 AND year >= 2000 AND year <= 2015",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    spec = CatalogueQuery(min_score=6.5, min_year=2000, max_year=2015)
    return catalogue(spark, sf).identity_rows(spec).select("content_type", "record_id", "score", "year")


@query(
    "c4_episode_range",
    "SELECT anime_id AS record_id, episodes AS length FROM {anime} WHERE NOT is_adult AND episodes BETWEEN 12 AND 26",
)
def _(spark, sf):
    spec = CatalogueQuery(min_episodes=12, max_episodes=26)
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "length")


@query(
    "c5_chapter_volume_range",
    """SELECT content_type, manga_id AS record_id, chapters AS length FROM {manga}
WHERE NOT is_adult AND chapters BETWEEN 20 AND 200 AND volumes BETWEEN 2 AND 30""",
)
def _(spark, sf):
    spec = CatalogueQuery(min_chapters=20, max_chapters=200, min_volumes=2, max_volumes=30)
    return catalogue(spark, sf).identity_rows(spec).select("content_type", "record_id", "length")


@query(
    "c6_anime_type",
    "SELECT anime_id AS record_id, title FROM {anime} WHERE NOT is_adult AND type IN ('SPECIAL', 'OVA')",
)
def _(spark, sf):
    spec = CatalogueQuery(scope="ANIME", types=("tv_special", "ova"))
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "c7_season",
    "SELECT anime_id AS record_id, title FROM {anime} WHERE NOT is_adult AND season IN ('winter', 'fall')",
)
def _(spark, sf):
    spec = CatalogueQuery(scope="ANIME", seasons="Winter,FALL")
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "c8_anime_status",
    "SELECT anime_id AS record_id, title FROM {anime} WHERE NOT is_adult AND status IN ('CURRENTLY_AIRING', 'NOT_YET_AIRED')",
)
def _(spark, sf):
    spec = CatalogueQuery(scope="ANIME", statuses=("airing", "not-yet airing"))
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "c9_print_status",
    "SELECT manga_id AS record_id, title FROM {manga} WHERE NOT is_adult AND content_type = 'MANGA' AND lower(trim(status)) IN ('finished', 'on hiatus')",
)
def _(spark, sf):
    spec = CatalogueQuery(scope="MANGA", statuses="FINISHED,On_Hiatus")
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "c11_scope_narrowing",
    """SELECT 'anime_only' AS request, 'ANIME' AS content_type, count(*) AS n FROM {anime} WHERE NOT is_adult AND episodes >= 5
UNION ALL SELECT 'print_only', content_type, count(*) FROM {manga} WHERE NOT is_adult AND volumes <= 10 GROUP BY content_type""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    requests = {
        "anime_only": CatalogueQuery(min_episodes=5),
        "print_only": CatalogueQuery(max_volumes=10),
        "conflict": CatalogueQuery(min_episodes=5, max_volumes=10),
    }
    out = None
    for name, spec in requests.items():
        counts = cat.identity_rows(spec).groupBy("content_type").agg(F.count("*").alias("n"))
        part = counts.select(F.lit(name).alias("request"), "content_type", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c12_presets",
    """SELECT 'new-season' AS preset, count(*) AS n FROM {anime} WHERE NOT is_adult AND type = 'TV' AND status = 'CURRENTLY_AIRING' AND season = 'winter' AND year = 2004
UNION ALL SELECT 'short-series', count(*) FROM {anime} WHERE NOT is_adult AND type = 'TV' AND episodes <= 13
UNION ALL SELECT 'long-series', count(*) FROM {anime} WHERE NOT is_adult AND type = 'TV' AND episodes >= 24
UNION ALL SELECT 'movies', count(*) FROM {anime} WHERE NOT is_adult AND type = 'MOVIE'
UNION ALL SELECT 'completed-anime', count(*) FROM {anime} WHERE NOT is_adult AND status = 'FINISHED_AIRING'
UNION ALL SELECT 'highly-rated', count(*) FROM {anime} WHERE NOT is_adult AND score >= 8
UNION ALL SELECT 'completed-manga', count(*) FROM {manga} WHERE NOT is_adult AND content_type = 'MANGA' AND lower(trim(status)) = 'finished'
UNION ALL SELECT 'completed-manhwa', count(*) FROM {manga} WHERE NOT is_adult AND content_type = 'MANHWA' AND lower(trim(status)) = 'finished'""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    names = {
        "ANIME": ["new-season", "short-series", "long-series", "movies", "completed-anime", "highly-rated"],
        "MANGA": ["completed-manga"],
        "MANHWA": ["completed-manhwa"],
    }
    out = None
    for scope, chosen in names.items():
        for name in chosen:
            spec = preset(name, CatalogueQuery(scope=scope), date(2004, 2, 1))
            part = cat.identity_rows(spec).agg(F.count("*").alias("n"))
            part = part.select(F.lit(name).alias("preset"), "n")
            out = part if out is None else out.unionByName(part)
    return out


# --- D: semi and anti joins -------------------------------------------------


@query(
    "d1_genre_include_all",
    """SELECT anime_id AS record_id, title FROM {anime} AS a WHERE NOT is_adult
AND EXISTS (SELECT 1 FROM {anime_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id WHERE l.anime_id = a.anime_id AND g.name = 'NATION_3')
AND EXISTS (SELECT 1 FROM {anime_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id WHERE l.anime_id = a.anime_id AND g.name = 'NATION_7')""",
)
def _(spark, sf):
    spec = CatalogueQuery(scope="ANIME", genres=("NATION_3", "NATION_7"))
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "d2_genre_exclude",
    """SELECT manga_id AS record_id, title FROM {manga} AS m WHERE NOT is_adult
AND NOT EXISTS (SELECT 1 FROM {manga_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id WHERE l.manga_id = m.manga_id AND g.name = 'NATION_1')
AND NOT EXISTS (SELECT 1 FROM {manga_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id WHERE l.manga_id = m.manga_id AND g.name = 'NATION_2')""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    rows = filters.without(
        filters.public(cat.manga), cat.manga_genre, cat.genre, LINKS["manga_genre"], ("NATION_1", "NATION_2")
    )
    return rows.select(F.col("manga_id").alias("record_id"), "title")


@query(
    "d3_tag_include_all",
    "SELECT manga_id AS record_id, title FROM {manga} WHERE NOT is_adult AND list_contains(genres_detailed, 'building') AND list_contains(genres_detailed, 'school')",
)
def _(spark, sf):
    rows = filters.with_tags(filters.public(view(spark, sf, "manga")), ("building", "school"))
    return rows.select(F.col("manga_id").alias("record_id"), "title")


@query(
    "d4_tag_exclude",
    "SELECT anime_id AS record_id, title FROM {anime} WHERE NOT is_adult AND NOT list_contains(genres_detailed, 'red') AND NOT list_contains(genres_detailed, 'bolt')",
)
def _(spark, sf):
    rows = filters.without_tags(filters.public(view(spark, sf, "anime")), ("red", "bolt"))
    return rows.select(F.col("anime_id").alias("record_id"), "title")


@query(
    "d5_studio_any",
    """SELECT anime_id AS record_id, title FROM {anime} AS a WHERE NOT is_adult AND EXISTS (SELECT 1 FROM {anime_studio} AS l JOIN {studio} AS s ON s.id = l.studio_id
WHERE l.anime_id = a.anime_id AND s.normalized_name IN ('supplier#000000003', 'supplier#000000008'))""",
)
def _(spark, sf):
    spec = CatalogueQuery(studios=(" Supplier#000000003", "SUPPLIER#000000008"))
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "d6_streaming_any",
    """SELECT anime_id AS record_id, title FROM {anime} AS a WHERE NOT is_adult AND EXISTS (SELECT 1 FROM {anime_streaming_service} AS l JOIN {streaming_service} AS s
ON s.normalized_name = l.service_key WHERE l.anime_id = a.anime_id AND s.normalized_name IN ('machinery', 'furniture'))""",
)
def _(spark, sf):
    spec = CatalogueQuery(streaming_services="Machinery,FURNITURE")
    return catalogue(spark, sf).identity_rows(spec).select("record_id", "title")


@query(
    "d7_author_any",
    """SELECT content_type, manga_id AS record_id, title FROM {manga} AS m WHERE NOT is_adult AND EXISTS (SELECT 1 FROM {manga_author} AS l JOIN {author} AS s ON s.id = l.author_id
WHERE l.manga_id = m.manga_id AND s.normalized_name IN ('author 7', 'author 12'))""",
)
def _(spark, sf):
    spec = CatalogueQuery(authors=("Author 7", "author  12"))
    return catalogue(spark, sf).identity_rows(spec).select("content_type", "record_id", "title")


@query(
    "d10_unlinked",
    "SELECT anime_id, title FROM {anime} AS a WHERE NOT EXISTS (SELECT 1 FROM {anime_streaming_service} AS l WHERE l.anime_id = a.anime_id)",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return ranking.unlinked(cat.anime, cat.anime_streaming_service, "anime_id").select("anime_id", "title")


# --- F: order, paging, queues -----------------------------------------------


def _sort_query(sort: str, scope: str) -> None:
    where = {"ALL": "TRUE", "ANIME": "content_type = 'ANIME'", "MANGA": "content_type = 'MANGA'"}[scope]

    @query(
        f"f1_sort_{sort}",
        f"SELECT content_type, record_id, row_number() OVER (ORDER BY {ORDERS[sort]}) AS rank FROM {{rows}} WHERE {where}",
        rows=IDENTITY_SQL,
    )
    def _(spark, sf):
        rows = catalogue(spark, sf).identity_rows(CatalogueQuery(scope=scope, sort=sort))
        ranked = ranking.global_rank(rows, ranking.order_keys(sort))
        return ranked.select("content_type", "record_id", "rank")


for _sort in fv.COMMON_SORTS:
    _sort_query(_sort, "ALL")
_sort_query("most_episodes", "ANIME")
_sort_query("most_chapters", "MANGA")


@query(
    "f3_page",
    f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS["top_rated"]}) AS rank FROM {{rows}} WHERE score >= 7)
WHERE rank BETWEEN 49 AND 72""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    return catalogue(spark, sf).page(CatalogueQuery(min_score=7, page=3))


@query(
    "f3_deep_page",
    f"""SELECT content_type, record_id, rank FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS["newest"]}) AS rank FROM {{rows}})
WHERE rank BETWEEN 101 AND 200""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    rows = catalogue(spark, sf).identity_rows(CatalogueQuery())
    part, before = ranking.narrowed(rows, ranking.sort_keys("newest"), 100, 200, 150, sample=64)
    page = ranking.slice_rows(part, ranking.sort_keys("newest"), 100 - before, 100)
    return page.select("content_type", "record_id", (F.col("rank") + before).alias("rank"))


@query(
    "f3_keyset_page",
    f"""SELECT content_type, record_id FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS["most_popular"]}) AS rank FROM {{rows}})
WHERE rank BETWEEN 25 AND 48""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    spec = CatalogueQuery(sort="most_popular")
    last = cat.page(spec).filter(F.col("rank") == spec.per_page).first()
    return ranking.after(cat.identity_rows(spec), "most_popular", last.asDict(), 24).select("content_type", "record_id")


SEASON_ORDERS = {
    "most_popular": "popularity ASC NULLS LAST, members DESC NULLS LAST, score DESC NULLS LAST, title, anime_id",
    "most_members": "members DESC NULLS LAST, popularity ASC NULLS LAST, score DESC NULLS LAST, title, anime_id",
    "top_rated": "score DESC, title, anime_id",
}


def _seasonal_query(sort: str) -> None:
    extra = "AND score IS NOT NULL" if sort == "top_rated" else ""

    @query(
        f"f5_seasonal_{sort}",
        f"""SELECT * FROM (SELECT anime_id, title, row_number() OVER (ORDER BY {SEASON_ORDERS[sort]}) AS rank, count(*) OVER () AS total
FROM {{anime}} WHERE NOT is_adult AND year = 2015 AND season = 'spring' {extra}) WHERE rank <= 12""",
    )
    def _(spark, sf):
        cat = catalogue(spark, sf)
        spec = CatalogueQuery(scope="ANIME")
        page = cat.seasonal(2015, "spring", spec, sort, limit=12)
        total = cat.season_rows(2015, "spring", spec, sort).agg(F.count("*")).scalar()
        return page.select("anime_id", "title", "rank").withColumn("total", total)


def _busy_season_query(sort: str) -> None:
    """The same over a season that holds many titles: every title takes the same year."""
    extra = "AND score IS NOT NULL" if sort == "top_rated" else ""

    @query(
        f"f5_busy_season_{sort}",
        f"""SELECT * FROM (SELECT anime_id, title, row_number() OVER (ORDER BY {SEASON_ORDERS[sort]}) AS rank, count(*) OVER () AS total
FROM {{anime}} WHERE NOT is_adult AND season = 'spring' {extra}) WHERE rank BETWEEN 4 AND 15""",
    )
    def _(spark, sf):
        cat = catalogue(spark, sf)
        cat = replace(cat, anime=cat.anime.withColumn("year", F.lit(2015)))
        spec = CatalogueQuery(scope="ANIME")
        rows = cat.season_rows(2015, "spring", spec, sort)
        page = ranking.slice_rows(rows, ranking.seasonal_keys(sort), 3, 12)
        total = rows.agg(F.count("*")).scalar()
        return page.select("anime_id", "title", "rank").withColumn("total", total)


for _sort in fv.SEASONAL_SORTS:
    _seasonal_query(_sort)
    _busy_season_query(_sort)


@query(
    "f8_random_sample",
    """SELECT content_type, record_id, mal_id FROM (SELECT *, sha256(content_type || '-' || record_id || '-7') AS digest FROM {rows})
WHERE digest < '051eb851' ORDER BY digest LIMIT 6""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    rows = catalogue(spark, sf).identity_rows(CatalogueQuery())
    return ranking.random_sample(rows, 6, seed=7).select("content_type", "record_id", "mal_id")


@query(
    "f3_deep_slice",
    f"""SELECT content_type, record_id, rank FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS["newest"]}) AS rank FROM {{rows}})
WHERE rank BETWEEN 101 AND 200""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    # Beyond this limit the slice is selected; the sample is smaller than the default limit.
    rows = catalogue(spark, sf).identity_rows(CatalogueQuery())
    page = ranking.slice_rows(rows, ranking.sort_keys("newest"), 100, 100, top_k=150)
    return page.select("content_type", "record_id", "rank")


@query(
    "f9_random_window",
    """SELECT content_type, record_id, row_number() OVER (ORDER BY record_id < 190, record_id, content_type) AS rank
FROM {rows} WHERE score >= 9 ORDER BY rank LIMIT 12""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    rows = catalogue(spark, sf).identity_rows(CatalogueQuery(min_score=9))
    return ranking.random_window(rows, 190, 12).select("content_type", "record_id", "rank")


@query(
    "f9_random_bounds",
    "SELECT min(record_id) AS min_id, max(record_id) AS max_id FROM {rows} WHERE score >= 9",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    return ranking.id_bounds(catalogue(spark, sf).identity_rows(CatalogueQuery(min_score=9)))


@query(
    "f10_work_queue",
    """SELECT * FROM (SELECT manga_id, mal_id, row_number() OVER (ORDER BY last_attempt ASC NULLS FIRST, manga_id) AS rank FROM {manga})
WHERE rank <= 1000""",
)
def _(spark, sf):
    rows = ranking.work_queue(view(spark, sf, "manga"), "last_attempt", "manga_id", fv.REFRESH_LIMIT)
    return rows.select("manga_id", "mal_id", "rank")


@query(
    "f10_explicit_queue",
    "SELECT anime_id, mal_id, row_number() OVER (ORDER BY mal_id) AS rank FROM {anime} WHERE mal_id IN (90, 5, 33, 17, 121)",
)
def _(spark, sf):
    rows = ranking.explicit_queue(view(spark, sf, "anime"), [90, 5, 33, 17, 121])
    return rows.select("anime_id", "mal_id", "rank")


@query(
    "f11_season_queue",
    """SELECT * FROM (SELECT anime_id, row_number() OVER (ORDER BY last_season_attempt ASC NULLS FIRST, anime_id) AS rank
FROM {anime} WHERE season IS NULL AND mal_id > 0 AND upper(type) = 'TV') WHERE rank <= 1000""",
)
def _(spark, sf):
    return ranking.season_queue(view(spark, sf, "anime"), fv.REFRESH_LIMIT).select("anime_id", "rank")


@query(
    "f12_streaming_queue",
    """SELECT * FROM (SELECT anime_id, row_number() OVER (ORDER BY last_streaming_attempt ASC NULLS FIRST, anime_id) AS rank
FROM {anime} AS a WHERE NOT is_adult AND mal_id > 0 AND NOT EXISTS (SELECT 1 FROM {anime_streaming_service} AS l WHERE l.anime_id = a.anime_id))
WHERE rank <= 2000""",
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return ranking.streaming_queue(cat.anime, cat.anime_streaming_service, fv.STREAMING_LIMIT).select("anime_id", "rank")


# --- B: projections ---------------------------------------------------------

CHILD_SQL = {
    "anime_names": "SELECT l.anime_id, string_agg(g.name, ',' ORDER BY g.name) AS genres FROM {anime_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id GROUP BY l.anime_id",
    "anime_studios": """SELECT l.anime_id, string_agg(COALESCE(CAST(s.mal_id AS VARCHAR), '') || ':' || s.name, ',' ORDER BY s.normalized_name) AS studios
FROM {anime_studio} AS l JOIN {studio} AS s ON s.id = l.studio_id GROUP BY l.anime_id""",
    "anime_services": """SELECT l.anime_id, string_agg(s.name || '=' || l.url, ',' ORDER BY s.normalized_name) AS services
FROM {anime_streaming_service} AS l JOIN {streaming_service} AS s ON s.normalized_name = l.service_key GROUP BY l.anime_id""",
    "manga_names": "SELECT l.manga_id, string_agg(g.name, ',' ORDER BY g.name) AS genres FROM {manga_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id GROUP BY l.manga_id",
    "manga_authors": """SELECT l.manga_id, string_agg(COALESCE(CAST(s.mal_id AS VARCHAR), '') || ':' || s.name || ':' || l.role, ',' ORDER BY s.normalized_name, l.role) AS authors
FROM {manga_author} AS l JOIN {author} AS s ON s.id = l.author_id GROUP BY l.manga_id""",
}


def _joined(column: str, *parts):
    """An array of structs as one comparable string."""
    text = F.transform(column, lambda e: F.concat(*[p(e) for p in parts]))
    return F.array_join(text, ",")


def _flat_studios():
    return _joined(
        "studios", lambda e: F.coalesce(e["mal_id"].cast("string"), F.lit("")), lambda e: F.lit(":"), lambda e: e["name"]
    )


def _flat_services():
    return _joined("streaming_services", lambda e: e["name"], lambda e: F.lit("="), lambda e: e["url"])


def _flat_authors():
    return _joined(
        "authors",
        lambda e: F.coalesce(e["mal_id"].cast("string"), F.lit("")),
        lambda e: F.lit(":"),
        lambda e: e["name"],
        lambda e: F.lit(":"),
        lambda e: e["role"],
    )


ANIME_PREVIEW = "a.anime_id AS id, a.mal_id, 'ANIME' AS content_type, a.title, a.type, a.season, a.year, a.score, a.popularity, a.members, a.episodes, a.image_url, COALESCE(g.genres, '') AS genres"
ANIME_LIST = ANIME_PREVIEW + ", a.alternative_title, a.status, a.mal_url, a.sequel, COALESCE(s.studios, '') AS studios, COALESCE(v.services, '') AS streaming_services"
ANIME_JOIN = "FROM {anime} AS a LEFT JOIN {anime_names} AS g ON g.anime_id = a.anime_id LEFT JOIN {anime_studios} AS s ON s.anime_id = a.anime_id LEFT JOIN {anime_services} AS v ON v.anime_id = a.anime_id"
ANIME_DETAIL = ANIME_LIST + ", a.synopsis, array_to_string(a.genres_detailed, ',') AS genres_detailed, strftime(a.last_sync, '%Y-%m-%dT%H:%M:%S') AS last_sync"
MANGA_PREVIEW = "m.manga_id AS id, m.mal_id, m.content_type, m.title, m.manga_type AS type, m.manga_type, m.publication_year AS year, m.publication_year, m.score, m.popularity, m.members, m.chapters, m.volumes, m.image_url, COALESCE(g.genres, '') AS genres"
MANGA_DETAIL = MANGA_PREVIEW + ", m.alternative_title, m.status, m.mal_url, COALESCE(w.authors, '') AS authors, m.synopsis, array_to_string(m.genres_detailed, ',') AS genres_detailed, strftime(m.last_sync, '%Y-%m-%dT%H:%M:%S') AS last_sync"
MANGA_JOIN = "FROM {manga} AS m LEFT JOIN {manga_names} AS g ON g.manga_id = m.manga_id LEFT JOIN {manga_authors} AS w ON w.manga_id = m.manga_id"


def _flat_anime(rows):
    out = rows.withColumn("genres", F.array_join("genres", ","))
    if "studios" in rows.columns:
        out = out.withColumn("studios", _flat_studios()).withColumn("streaming_services", _flat_services())
    if "genres_detailed" in rows.columns:
        out = out.withColumn("genres_detailed", F.array_join("genres_detailed", ","))
    return out


def _flat_manga(rows):
    out = rows.withColumn("genres", F.array_join("genres", ","))
    if "authors" in rows.columns:
        out = out.withColumn("authors", _flat_authors())
    if "genres_detailed" in rows.columns:
        out = out.withColumn("genres_detailed", F.array_join("genres_detailed", ","))
    return out


@query("b1_anime_preview", f"SELECT {ANIME_PREVIEW} {ANIME_JOIN} WHERE NOT a.is_adult", **CHILD_SQL)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return _flat_anime(projection.project_anime(filters.public(cat.anime), cat, "preview"))


@query("b1_anime_detail", f"SELECT {ANIME_DETAIL} {ANIME_JOIN} WHERE NOT a.is_adult", **CHILD_SQL)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return _flat_anime(projection.project_anime(filters.public(cat.anime), cat, "detail"))


@query("b2_manga_detail", f"SELECT {MANGA_DETAIL} {MANGA_JOIN} WHERE NOT m.is_adult", **CHILD_SQL)
def _(spark, sf):
    cat = catalogue(spark, sf)
    return _flat_manga(projection.project_manga(filters.public(cat.manga), cat, "detail"))


@query("b3_sorted_children", "SELECT manga_id, authors FROM {manga_authors}", **CHILD_SQL)
def _(spark, sf):
    cat = catalogue(spark, sf)
    order = [F.col("normalized_name"), F.coalesce("role", F.lit(""))]
    value = F.struct("mal_id", "name", "role")
    rows = projection.nest(cat.manga_author, cat.author, LINKS["author"], "authors", value, *order)
    return rows.withColumn("authors", _flat_authors())


@query(
    "b5_hydrated_page",
    f"""SELECT p.rank, p.content_type, p.record_id AS id, p.title, COALESCE(a.alternative_title, m.alternative_title) AS alternative_title,
a.episodes, m.chapters, COALESCE(ga.genres, gm.genres, '') AS genres, CASE WHEN p.content_type = 'ANIME' THEN COALESCE(s.studios, '') END AS studios,
CASE WHEN p.content_type <> 'ANIME' THEN COALESCE(w.authors, '') END AS authors
FROM (SELECT *, row_number() OVER (ORDER BY {ORDERS["top_rated"]}) AS rank FROM {{rows}} WHERE year >= 2005) AS p
LEFT JOIN {{anime}} AS a ON p.content_type = 'ANIME' AND a.anime_id = p.record_id
LEFT JOIN {{manga}} AS m ON p.content_type <> 'ANIME' AND m.manga_id = p.record_id
LEFT JOIN {{anime_names}} AS ga ON ga.anime_id = a.anime_id LEFT JOIN {{manga_names}} AS gm ON gm.manga_id = m.manga_id
LEFT JOIN {{anime_studios}} AS s ON s.anime_id = a.anime_id LEFT JOIN {{manga_authors}} AS w ON w.manga_id = m.manga_id
WHERE p.rank <= 24""",
    rows=IDENTITY_SQL,
    **CHILD_SQL,
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    rows = cat.listing(CatalogueQuery(min_year=2005), "list")
    return rows.select(
        "rank",
        "content_type",
        "id",
        "title",
        "alternative_title",
        "episodes",
        "chapters",
        F.array_join("genres", ",").alias("genres"),
        _flat_studios().alias("studios"),
        _flat_authors().alias("authors"),
    )


@query("b6_detail_lookup", f"SELECT {ANIME_DETAIL} {ANIME_JOIN} WHERE NOT a.is_adult AND a.mal_id = 42", **CHILD_SQL)
def _(spark, sf):
    return _flat_anime(projection.detail(catalogue(spark, sf), "anime", 42))


@query(
    "b6_print_detail_lookup",
    f"SELECT {MANGA_DETAIL} {MANGA_JOIN} WHERE NOT m.is_adult AND m.mal_id = 42 AND m.content_type = 'MANHWA'",
    **CHILD_SQL,
)
def _(spark, sf):
    return _flat_manga(projection.detail(catalogue(spark, sf), "manhwa", 42))


# --- E1-E5, E8, F6, F7, A7, D8, G2 -------------------------------------------


@query(
    "e1_total",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages FROM {rows} WHERE score >= 5",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    return catalogue(spark, sf).total(CatalogueQuery(min_score=5))


@query(
    "e2_filter_ranges",
    """SELECT CAST(min(y) AS BIGINT) AS min_year, CAST(max(y) AS BIGINT) AS max_year, min(score) AS min_score, max(score) AS max_score,
CAST(min(e) AS BIGINT) AS min_episodes, CAST(max(e) AS BIGINT) AS max_episodes, CAST(min(c) AS BIGINT) AS min_chapters, CAST(max(c) AS BIGINT) AS max_chapters,
CAST(min(v) AS BIGINT) AS min_volumes, CAST(max(v) AS BIGINT) AS max_volumes FROM (
SELECT year AS y, score, episodes AS e, NULL AS c, NULL AS v FROM {anime} WHERE NOT is_adult
UNION ALL SELECT publication_year, score, NULL, chapters, volumes FROM {manga} WHERE NOT is_adult)""",
)
def _(spark, sf):
    return profile.filter_ranges(catalogue(spark, sf), CatalogueQuery().content_types)


@query(
    "e3_freshness",
    """SELECT strftime(max(last_sync), '%Y-%m-%dT%H:%M:%S') AS updated_at FROM (SELECT last_sync FROM {anime} WHERE NOT is_adult
UNION ALL SELECT last_sync FROM {manga} WHERE NOT is_adult AND content_type IN ('MANGA', 'MANHWA'))""",
)
def _(spark, sf):
    return profile.freshness(catalogue(spark, sf), CatalogueQuery().content_types)


@query(
    "e4_season_coverage",
    """SELECT total_tv, classified_tv, CASE WHEN total_tv > 0 THEN classified_tv / total_tv ELSE 0.0 END AS rate FROM (
SELECT count(*) FILTER (WHERE upper(type) = 'TV') AS total_tv, count(*) FILTER (WHERE upper(type) = 'TV' AND season IS NOT NULL) AS classified_tv FROM {anime})""",
)
def _(spark, sf):
    return profile.season_coverage(view(spark, sf, "anime"))


@query(
    "e5_metric_coverage",
    """SELECT content_type, count(*) AS total, count(popularity) AS with_popularity, count(members) AS with_members FROM {rows} GROUP BY content_type""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    return profile.metric_coverage(catalogue(spark, sf))


FACET_SOURCE_SQL = """SELECT 'ANIME' AS content_type, 'genre' AS facet_type, g.name AS value FROM {anime} AS a JOIN {anime_genre} AS l ON l.anime_id = a.anime_id JOIN {genre} AS g ON g.id = l.genre_id WHERE NOT a.is_adult
UNION ALL SELECT m.content_type, 'genre', g.name FROM {manga} AS m JOIN {manga_genre} AS l ON l.manga_id = m.manga_id JOIN {genre} AS g ON g.id = l.genre_id WHERE NOT m.is_adult
UNION ALL SELECT 'ANIME', 'tag', unnest(genres_detailed) FROM {anime} WHERE NOT is_adult
UNION ALL SELECT content_type, 'tag', unnest(genres_detailed) FROM {manga} WHERE NOT is_adult
UNION ALL SELECT 'ANIME', 'studio', s.name FROM {anime} AS a JOIN {anime_studio} AS l ON l.anime_id = a.anime_id JOIN {studio} AS s ON s.id = l.studio_id WHERE NOT a.is_adult
UNION ALL SELECT 'ANIME', 'streaming_service', s.name FROM {anime} AS a JOIN {anime_streaming_service} AS l ON l.anime_id = a.anime_id JOIN {streaming_service} AS s ON s.normalized_name = l.service_key WHERE NOT a.is_adult
UNION ALL SELECT m.content_type, 'author', s.name FROM {manga} AS m JOIN {manga_author} AS l ON l.manga_id = m.manga_id JOIN {author} AS s ON s.id = l.author_id WHERE NOT m.is_adult"""
FACET_SQL = """SELECT DISTINCT content_type, facet_type, left(trim(value), 255) AS value FROM {facet_source}
WHERE value IS NOT NULL AND trim(value) <> '' AND lower(trim(value)) NOT IN ('hentai', 'erotica')"""
FACETS = {"facet_source": FACET_SOURCE_SQL, "facets": FACET_SQL}


@query("e8_build_facets", "SELECT * FROM {facets}", **FACETS)
def _(spark, sf):
    return profile.build_facets(catalogue(spark, sf))


@query(
    "d8_facet_joins",
    "SELECT content_type, facet_type, count(DISTINCT value) AS n FROM {facet_source} WHERE facet_type <> 'tag' GROUP BY content_type, facet_type",
    **FACETS,
)
def _(spark, sf):
    rows = profile.facet_source(catalogue(spark, sf)).filter(F.col("facet_type") != "tag")
    return rows.groupBy("content_type", "facet_type").agg(F.count_distinct("value").alias("n"))


@query(
    "g2_union_distinct",
    "SELECT facet_type, value FROM {facets} GROUP BY facet_type, value",
    **FACETS,
)
def _(spark, sf):
    return profile.build_facets(catalogue(spark, sf)).select("facet_type", "value").distinct()


@query(
    "f6_facet_page",
    """SELECT value, row_number() OVER (ORDER BY value) AS rank, count(*) OVER () > 20 AS has_more FROM (
SELECT DISTINCT value FROM {facets} WHERE content_type IN ('ANIME', 'MANGA', 'MANHWA') AND facet_type = 'author' AND value ILIKE '%r 1%')
ORDER BY value LIMIT 20""",
    **FACETS,
)
def _(spark, sf):
    facets = profile.build_facets(catalogue(spark, sf))
    return profile.facet_page(facets, CatalogueQuery().content_types, "author", "R 1", 0, 20)


def _facet_list_query(facet: str, scope: str, q: str) -> None:
    kinds = ", ".join(f"'{k}'" for k in fv.SCOPES[scope])

    @query(
        f"f7_facet_list_{facet}",
        f"""SELECT value, row_number() OVER (ORDER BY value) AS rank FROM (SELECT DISTINCT value FROM {{facets}}
WHERE content_type IN ({kinds}) AND facet_type = '{facet}' AND contains(lower(value), '{q}'))""",
        **FACETS,
    )
    def _(spark, sf):
        facets = profile.build_facets(catalogue(spark, sf))
        return profile.facet_values(facets, frozenset(fv.SCOPES[scope]), facet, q.upper())


for _facet, _scope, _q in (
    ("genre", "ANIME", ""),
    ("tag", "ALL", "o"),
    ("studio", "ANIME", "00"),
    ("streaming_service", "ANIME", ""),
    ("author", "ALL", "author 1"),
):
    _facet_list_query(_facet, _scope, _q)


# --- H18 ----------------------------------------------------------------------


@query(
    "h18_japan_season",
    """SELECT year, season, next_year, next_season, count(*) AS n FROM (
SELECT year(t) AS year, ['winter', 'spring', 'summer', 'fall'][quarter(t)] AS season,
  year(t + INTERVAL 3 MONTH) AS next_year, ['winter', 'spring', 'summer', 'fall'][quarter(t) % 4 + 1] AS next_season
FROM (SELECT o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) + INTERVAL 9 HOUR AS t FROM {orders})) GROUP BY ALL""",
)
def _(spark, sf):
    from reelshelf.functions.calendar import current_season, next_season
    from reelshelf.sources.bindings import source

    orders = source(spark, sf, "orders")
    ts = F.col("o_orderdate") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    now, later = current_season(ts), next_season(ts)
    return (
        orders.select(
            now["year"].alias("year"),
            now["season"].alias("season"),
            later["year"].alias("next_year"),
            later["season"].alias("next_season"),
        )
        .groupBy("year", "season", "next_year", "next_season")
        .agg(F.count("*").alias("n"))
    )
