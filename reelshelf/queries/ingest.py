"""Payload parsing, merging and relationship reconciliation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from reelshelf.functions import text
from reelshelf.operators import adult, apply, gate, identity, merge, parsing, reconcile
from reelshelf.queries.registry import query
from reelshelf.schemas import LINKS
from reelshelf.session import materialise
from reelshelf.sources import landing, payloads
from reelshelf.sources.bindings import catalogue, source, view

NOW_TEXT = "2024-06-01 00:00:00"

# What the anime payloads mean, computed from the sample without any JSON.
PAY = """SELECT p_partkey AS k, CAST(p_partkey // 50 AS INT) AS page, CAST(p_partkey % 50 AS INT) AS pos, p_name, p_brand,
  CASE WHEN p_partkey % 47 = 0 OR p_partkey % 43 = 0 OR p_partkey % 53 = 0 THEN NULL ELSE p_partkey END AS mal_id,
  p_partkey % 31 = 0 OR p_partkey % 37 = 0 AS is_adult,
  CASE WHEN p_partkey % 9 > 1 THEN 'New ' || p_name END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'EN ' || p_partkey WHEN p_partkey % 2 = 0 THEN 'JP ' || p_partkey END AS alternative_title,
  p_partkey % 5 <> 0 AS has_synopsis, CASE WHEN p_partkey % 5 > 2 THEN 'S' || p_partkey END AS synopsis,
  CASE p_partkey % 8 WHEN 2 THEN 'SPECIAL' WHEN 3 THEN 'TV' WHEN 6 THEN 'MOVIE' WHEN 7 THEN 'TV' END AS type,
  CASE p_partkey % 6 WHEN 0 THEN 'CURRENTLY_AIRING' WHEN 1 THEN 'FINISHED_AIRING' WHEN 5 THEN 'NOT_YET_AIRED' END AS status,
  CASE p_partkey % 7 WHEN 0 THEN 'winter' WHEN 6 THEN 'summer' END AS season_named,
  ['winter', 'spring', 'summer', 'fall'][CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 12) // 3 + 1
    WHEN p_partkey % 3 = 1 AND p_partkey % 14 BETWEEN 1 AND 12 THEN (p_partkey % 14 - 1) // 3 + 1 END] AS season_aired,
  p_partkey % 5 <> 0 AS has_year, CAST(CASE WHEN p_partkey % 5 > 1 THEN 2000 + p_partkey % 25 END AS INT) AS year,
  p_partkey % 7 <> 6 AS has_score, CAST(CASE p_partkey % 7 WHEN 4 THEN p_partkey % 10 + 0.5 WHEN 5 THEN p_partkey % 10 + 1 END AS DOUBLE) AS score,
  CASE WHEN p_partkey % 5 = 1 THEN p_partkey END AS popularity,
  CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_partkey * 3 END AS members,
  p_partkey % 3 <> 0 AS has_episodes, CAST(CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 50 END AS INT) AS episodes,
  CASE WHEN p_partkey % 4 > 1 THEN 'https://p.example/' || p_partkey END AS url,
  CASE p_partkey % 5 WHEN 1 THEN 'L' || p_partkey WHEN 2 THEN 'I' || p_partkey END AS image_url,
  p_partkey % 4 <> 0 AS has_relations, p_partkey % 4 = 2 AS sequel,
  CASE p_partkey % 6 WHEN 2 THEN ['Action', 'Drama'] WHEN 3 THEN [p_brand] WHEN 4 THEN ['NATION_3'] ELSE [] END AS genres,
  CASE p_partkey % 6 WHEN 2 THEN ['action', 'drama'] WHEN 3 THEN [lower(p_brand)] WHEN 4 THEN ['nation_3'] ELSE [] END
    || CASE WHEN p_partkey % 31 = 0 THEN ['hentai'] ELSE [] END || CASE WHEN p_partkey % 5 = 0 THEN ['school'] ELSE [] END AS tags
FROM {part}"""
KEPT = "SELECT * FROM {pay} WHERE mal_id IS NOT NULL AND NOT is_adult"
V = {"pay": PAY, "kept": KEPT}


def now():
    return F.lit(NOW_TEXT).cast("timestamp")


def anime_rows(spark, sf):
    return parsing.clean_anime(payloads.parsed(payloads.anime_bodies(spark, sf)))


def stored_anime_rows(spark, sf):
    """The same, written once: the ingest job parses a page once and reads it twice."""
    return materialise(anime_rows(spark, sf), "clean")


def manga_rows(spark, sf):
    return parsing.clean_manga(payloads.parsed(payloads.manga_bodies(spark, sf)))


def _field_query(name: str, columns: str, sql: str | None = None) -> None:
    """One H rule over every anime payload."""
    names = columns.split(", ")

    @query(name, f"SELECT k, {sql or columns} FROM {{pay}}", **V)
    def _(spark, sf):
        rows = anime_rows(spark, sf)
        arrays = [F.array_join(c, ",").alias(c) if c in ("genres", "tags") else F.col(c) for c in names]
        return rows.select("k", *arrays)


_field_query("h1_entity_names", "genres", "array_to_string(genres, ',') AS genres")
_field_query("h2_detailed_tags", "tags", "array_to_string(tags, ',') AS tags")
_field_query("h3_adult_classification", "is_adult")
_field_query("h4_valid_score", "has_score, score")
_field_query("h5_valid_metric", "popularity, members")
_field_query("h7_anime_status", "status")
_field_query("h8_season", "season_named")
_field_query("h9_season_from_date", "season_aired")
_field_query("h10_blank_to_null", "has_synopsis, synopsis")
_field_query("h16_cover_image", "image_url")
_field_query("h17_sequel_flag", "has_relations, sequel")


@query("h6_anime_type", "SELECT k, COALESCE(type, 'UNKNOWN') AS type FROM {pay}", **V)
def _(spark, sf):
    return anime_rows(spark, sf).select("k", text.anime_type(F.col("raw_type")).alias("type"))


PRINT_YEAR = """CAST(CASE c_custkey % 5 WHEN 2 THEN 1990 + c_custkey % 30 WHEN 3 THEN 1970 + c_custkey % 40 END AS INT)"""


@query("h11_publication_year", f"SELECT c_custkey AS k, {PRINT_YEAR} AS publication_year FROM {{customer}}")
def _(spark, sf):
    return manga_rows(spark, sf).select("k", "publication_year")


@query(
    "h12_print_type",
    """SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 2 THEN 'MANHWA' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'MANGA' END AS content_type FROM {customer}""",
)
def _(spark, sf):
    return manga_rows(spark, sf).select("k", gate.print_type(F.lit("MANGA")).alias("content_type"))


@query(
    "h13_entity_name_key",
    """SELECT s_suppkey AS k, s_name || ' Studio' AS name, lower(s_name) || ' studio' AS key FROM {supplier} WHERE s_suppkey % 3 <> 0
UNION ALL SELECT s_suppkey, s_name || ' Straße', lower(s_name) || ' strasse' FROM {supplier} WHERE s_suppkey % 6 = 0
UNION ALL SELECT s_suppkey, NULL, NULL FROM {supplier} WHERE s_suppkey % 6 = 3""",
)
def _(spark, sf):
    raw = (
        F.when(F.col("s_suppkey") % 6 == 0, F.concat("s_name", F.lit("  Straße ")))
        .when(F.col("s_suppkey") % 6 == 3, F.concat("s_name", F.repeat(F.lit("x"), 150)))
        # Full-width letters fold to ASCII.
        .otherwise(F.concat(F.lit(" "), "s_name", F.lit("  Ｓtudio")))
    )
    rows = source(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), raw.alias("raw"))
    raw = F.col("raw")
    return rows.select("k", text.entity_name(raw).alias("name"), text.entity_key(raw).alias("key"))


@query(
    "h14_safe_url",
    """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'https://a.example/' || c_name WHEN 1 THEN 'HTTP://b.example' END AS url FROM {customer}""",
)
def _(spark, sf):
    kind = F.col("c_custkey") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit(" https://a.example/"), "c_name", F.lit("\t")))
        .when(kind == 1, "HTTP://b.example")
        .when(kind == 2, F.concat(F.lit("javascript:"), "c_name"))
        .when(kind == 3, "https:///path")
    )
    return source(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.safe_url(raw).alias("url"))


# Values of the print payloads without JSON.
AUTHORS = """SELECT c_custkey AS k, 0 AS n, 'author ' || (1 + 3 * (c_custkey % 60)) AS name, 'author ' || (1 + 3 * (c_custkey % 60)) AS key,
  CAST(NULL AS BIGINT) AS provider_id, 'Story' AS role FROM {customer} WHERE c_custkey % 6 > 2
UNION ALL SELECT c_custkey, 1, 'Pen ' || (c_custkey % 60), 'pen ' || (c_custkey % 60), 502 + 3 * (c_custkey % 60), 'Art' FROM {customer} WHERE c_custkey % 6 > 2
UNION ALL SELECT c_custkey, 2, 'Odd ' || (c_custkey % 5), 'odd ' || (c_custkey % 5), NULL, NULL FROM {customer} WHERE c_custkey % 6 = 5"""
AUTHOR_STATE = """SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 6 IN (1, 4, 5) THEN 1 ELSE 0 END AS BIGINT) AS malformed, c_custkey % 6 IN (2, 3) AS complete
FROM {customer} WHERE c_custkey % 6 <> 0"""
STUDIOS = """SELECT p_partkey AS k, 'Supplier#' || lpad(CAST(2 + 10 * (p_partkey % 9) AS VARCHAR), 9, '0') AS name,
  'supplier#' || lpad(CAST(2 + 10 * (p_partkey % 9) AS VARCHAR), 9, '0') AS key, 1001 + 10 * (p_partkey % 9) AS provider_id FROM {part} WHERE p_partkey % 6 > 2
UNION ALL SELECT p_partkey, 'supplier#' || lpad(CAST(5 + 10 * (p_partkey % 9) AS VARCHAR), 9, '0'),
  'supplier#' || lpad(CAST(5 + 10 * (p_partkey % 9) AS VARCHAR), 9, '0'), NULL FROM {part} WHERE p_partkey % 6 > 2
UNION ALL SELECT p_partkey, 'Studio ' || (p_partkey % 20), 'studio ' || (p_partkey % 20), NULL FROM {part} WHERE p_partkey % 6 > 2
UNION ALL SELECT p_partkey, 'Odd ' || (p_partkey % 5), 'odd ' || (p_partkey % 5), NULL FROM {part} WHERE p_partkey % 6 = 5"""
STUDIO_STATE = """SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 6 IN (1, 4, 5) THEN 1 ELSE 0 END AS BIGINT) AS malformed, p_partkey % 6 IN (2, 3) AS complete
FROM {part} WHERE p_partkey % 6 <> 0"""
SERVICES = """SELECT p_partkey AS k, 'Machinery' AS name, 'machinery' AS key, 'https://machinery.example/' || p_partkey AS url FROM {part} WHERE p_partkey % 5 > 2
UNION ALL SELECT p_partkey, 'New Tube', 'new tube', 'HTTPS://tube.example/' || p_partkey FROM {part} WHERE p_partkey % 5 > 2"""
SERVICE_STATE = """SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 5 IN (1, 4) THEN 1 ELSE 0 END AS BIGINT) AS malformed, p_partkey % 5 IN (2, 3) AS complete
FROM {part} WHERE p_partkey % 5 <> 0"""
E = {
    "authors": AUTHORS,
    "author_state": AUTHOR_STATE,
    "studios": STUDIOS,
    "studio_state": STUDIO_STATE,
    "services": SERVICES,
    "service_state": SERVICE_STATE,
}


def _titles(rows):
    """Cleaned rows keyed for the entity parsers."""
    seq = F.struct("page", "pos", F.col("k").alias("item_id"))
    return rows.withColumn("item_id", F.col("k")).withColumn("seq", seq)


def _with_state(values, completeness, *columns):
    """Parsed entities next to the completeness of their title."""
    state = completeness.select(F.col("item_id").alias("k"), "malformed", "complete")
    values = values.select(F.col("item_id").alias("k"), *columns)
    return state.join(values, "k", "left")


@query("h15_author_role", "SELECT k, key, role FROM {authors}", **E)
def _(spark, sf):
    values, _ = parsing.parse_authors(_titles(manga_rows(spark, sf)))
    return values.select(F.col("item_id").alias("k"), "key", "role")


@query("i6_parse_studios", "SELECT s.k, malformed, complete, name, key, provider_id FROM {studio_state} AS s LEFT JOIN {studios} AS v ON v.k = s.k", **E)
def _(spark, sf):
    return _with_state(*parsing.parse_studios(_titles(anime_rows(spark, sf))), "name", "key", "provider_id")


@query("i7_parse_streaming", "SELECT s.k, malformed, complete, name, key, url FROM {service_state} AS s LEFT JOIN {services} AS v ON v.k = s.k", **E)
def _(spark, sf):
    return _with_state(*parsing.parse_streaming(_titles(anime_rows(spark, sf))), "name", "key", "url")


@query("i8_parse_authors", "SELECT s.k, malformed, complete, name, key, provider_id, role FROM {author_state} AS s LEFT JOIN {authors} AS v ON v.k = s.k", **E)
def _(spark, sf):
    return _with_state(*parsing.parse_authors(_titles(manga_rows(spark, sf))), "name", "key", "provider_id", "role")


@query(
    "h18_season_counts",
    """SELECT season_aired, count(*) AS n FROM {pay} GROUP BY season_aired""",
    **V,
)
def _(spark, sf):
    return anime_rows(spark, sf).groupBy("season_aired").agg(F.count("*").alias("n"))


@query(
    "h19_season_override",
    """SELECT k, TRUE AS has_year, CAST(2021 AS INT) AS year, CASE WHEN k % 8 IN (0, 1, 3, 7) THEN 'spring' ELSE season_named END AS season_named FROM {pay}""",
    **V,
)
def _(spark, sf):
    rows = gate.prepare_season(anime_rows(spark, sf), 2021, "spring")
    return rows.select("k", "has_year", "year", "season_named")


BRANDS = """SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'Crunchyroll ' || c_mktsegment WHEN 1 THEN 'Watch' WHEN 2 THEN c_mktsegment WHEN 3 THEN 'HBO Max' WHEN 4 THEN NULL ELSE 'YouTube Netflix' END AS name,
  CASE c_custkey % 6 WHEN 1 THEN 'https://www.AMAZON.com/gp/video/1' WHEN 4 THEN 'https://tv.apple.com/x' END AS url FROM {customer}"""


@query(
    "h21_service_brand",
    """SELECT k, CASE k % 6 WHEN 0 THEN 'crunchyroll' WHEN 1 THEN 'prime-video' WHEN 2 THEN 'external' WHEN 3 THEN 'max' WHEN 4 THEN 'apple-tv' ELSE 'netflix' END AS brand FROM {brands}""",
    brands=BRANDS,
)
def _(spark, sf):
    rows = spark.sql(BRANDS, customer=source(spark, sf, "customer"))
    return rows.select("k", text.service_brand(F.col("name"), F.col("url")).alias("brand"))


@query(
    "h22_distinct_names",
    """SELECT item_id, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(name) ORDER BY pos) AS rn FROM (
SELECT l_orderkey % 500 AS item_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag || l_linestatus) ELSE lower(l_returnflag || l_linestatus) END AS name
FROM {lineitem} WHERE l_linenumber <> 5)) WHERE rn = 1""",
)
def _(spark, sf):
    flags = F.concat("l_returnflag", "l_linestatus")
    name = (
        F.when(F.col("l_linenumber") == 5, " ")
        .when(F.col("l_linenumber") % 2 == 0, F.concat(F.upper(flags), F.lit(" ")))
        .otherwise(F.lower(flags))
    )
    rows = source(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("item_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        name.alias("name"),
    )
    return parsing.distinct_names(rows)


# --- A1, A2 -------------------------------------------------------------------

PAGES = "SELECT page, count(*) AS objects FROM {pay} GROUP BY page"


@query(
    "a1_read_pages",
    """SELECT page, CASE page % 11 WHEN 1 THEN 'invalid pagination' WHEN 2 THEN 'invalid pagination' WHEN 3 THEN 'wrong page' WHEN 4 THEN 'invalid pagination'
WHEN 5 THEN 'inconsistent pagination' WHEN 6 THEN 'inconsistent terminal page' WHEN 7 THEN 'data is not a list' WHEN 8 THEN 'empty nonterminal page' WHEN 9 THEN 'not an object' WHEN 10 THEN 'HTTP 503' END AS reason,
CASE WHEN page % 11 = 0 THEN objects ELSE 0 END AS entries FROM {pages}""",
    pages=PAGES,
    **V,
)
def _(spark, sf):
    pages = materialise(payloads.landed(payloads.anime_bodies(spark, sf), "bulk"), "landed")
    valid, rejected = landing.read_pages(pages, "manga")
    found = landing.entries(landing.check_pages(pages, "manga"))
    counts = found.groupBy("page").agg(F.count("*").alias("entries"))
    good = valid.select("page", F.lit(None).cast("string").alias("reason")).join(counts, "page", "left")
    bad = rejected.select("page", "reason", F.lit(0).cast("bigint").alias("entries"))
    return good.unionByName(bad)


def _details(spark, sf, kind):
    bodies = payloads.anime_bodies(spark, sf) if kind == "anime" else payloads.manga_bodies(spark, sf)
    k = F.col("k")
    status = F.when(k % 13 == 0, 404).when(k % 13 == 1, 503).when(k % 13 == 2, 429).when(k % 13 == 3, F.lit(None)).otherwise(200)
    body = F.when(k % 13 == 4, F.lit('{"data":[]}')).when(k % 13 == 5, F.lit("{}"))
    return bodies.select(
        F.lit(kind).alias("kind"),
        k.alias("mal_id"),
        status.cast("int").alias("status_code"),
        now().alias("fetched_at"),
        body.otherwise(F.concat(F.lit('{"data":'), "body", F.lit("}"))).alias("body"),
    )


@query(
    "a2_classify_anime",
    """SELECT p_partkey AS mal_id, CASE p_partkey % 13 WHEN 0 THEN 'not_found' WHEN 1 THEN 'temporary' WHEN 2 THEN 'temporary' WHEN 3 THEN 'temporary'
WHEN 4 THEN 'invalid_payload' WHEN 5 THEN 'invalid_payload' ELSE 'ok' END AS outcome FROM {part}""",
)
def _(spark, sf):
    return landing.classify_fetch(_details(spark, sf, "anime"), "anime").select("mal_id", "outcome")


PRINT_OUTCOME = """CASE c_custkey % 13 WHEN 0 THEN 'not_found' WHEN 1 THEN 'temporary' WHEN 2 THEN 'temporary' WHEN 3 THEN 'temporary'
WHEN 4 THEN 'invalid_payload' WHEN 5 THEN 'invalid_payload' ELSE CASE WHEN c_custkey % 47 = 0 OR c_custkey % 43 = 0 THEN 'invalid_payload'
WHEN c_custkey % 7 = 3 THEN 'unsupported_type' ELSE 'ok' END END"""


@query("a2_classify_print", f"SELECT c_custkey AS mal_id, {PRINT_OUTCOME} AS outcome FROM {{customer}}")
def _(spark, sf):
    return landing.classify_fetch(_details(spark, sf, "manga"), "manga").select("mal_id", "outcome")


# --- D9, A6, A10, A11 ---------------------------------------------------------

ADULT = """SELECT anime_id FROM {anime} AS a WHERE is_adult OR len(list_filter(genres, lambda x: lower(trim(x)) IN ('hentai', 'erotica'))) > 0
OR len(list_filter(genres_detailed, lambda x: lower(trim(x)) IN ('hentai', 'erotica'))) > 0
OR EXISTS (SELECT 1 FROM {anime_genre} AS l JOIN {screened_genre} AS g ON g.id = l.genre_id WHERE l.anime_id = a.anime_id AND lower(trim(g.name)) IN ('hentai', 'erotica'))"""


def _screened(spark, sf):
    return replace(catalogue(spark, sf), genre=view(spark, sf, "screened_genre"))


@query("d9_adult_ids", ADULT)
def _(spark, sf):
    cat = _screened(spark, sf)
    return adult.adult_ids(cat.anime, cat.anime_genre, cat.genre, LINKS["anime_genre"])


@query(
    "a6_adult_purge",
    """SELECT 'anime' AS rows_of, count(*) AS n, CAST(sum(anime_id) AS BIGINT) AS ids FROM {anime} WHERE anime_id NOT IN (SELECT anime_id FROM {adult})
UNION ALL SELECT 'anime_studio', count(*), CAST(sum(anime_id) AS BIGINT) FROM {anime_studio} WHERE anime_id NOT IN (SELECT anime_id FROM {adult})
UNION ALL SELECT 'removed', count(*), CAST(sum(anime_id) AS BIGINT) FROM {adult}""",
    adult=ADULT,
)
def _(spark, sf):
    cat = _screened(spark, sf)
    items, bridges, gone = adult.purge_adult(
        cat.anime, {"anime_studio": cat.anime_studio}, cat.anime_genre, cat.genre, LINKS["anime_genre"]
    )
    parts = {"anime": items, "anime_studio": bridges["anime_studio"], "removed": gone}
    out = None
    for name, rows in parts.items():
        part = rows.agg(F.count("*").alias("n"), F.sum("anime_id").alias("ids"))
        part = part.select(F.lit(name).alias("rows_of"), "n", "ids")
        out = part if out is None else out.unionByName(part)
    return out


STORED_LABELS = """SELECT p_partkey AS anime_id, CASE p_partkey % 4 WHEN 0 THEN ' tv_special' WHEN 1 THEN 'Tv' WHEN 2 THEN 'OVA ' END AS type,
  CASE p_partkey % 5 WHEN 0 THEN 'airing' WHEN 1 THEN ' Finished Airing ' WHEN 2 THEN 'Not yet airing' WHEN 3 THEN 'Weird' END AS status FROM {part}"""


@query(
    "a6_print_purge",
    """SELECT 'manga' AS rows_of, manga_id, CAST(NULL AS BIGINT) AS author_id FROM {manga} WHERE manga_id NOT IN (SELECT manga_id FROM {adult})
UNION ALL SELECT 'manga_author', manga_id, author_id FROM {manga_author} WHERE manga_id NOT IN (SELECT manga_id FROM {adult})
UNION ALL SELECT 'removed', manga_id, NULL FROM {adult}""",
    adult=ADULT.replace("anime_genre", "manga_genre").replace("anime_id", "manga_id").replace("{anime}", "{manga}"),
)
def _(spark, sf):
    cat = _screened(spark, sf)
    items, bridges, gone = adult.purge_adult(
        cat.manga, {"manga_author": cat.manga_author}, cat.manga_genre, cat.genre, LINKS["manga_genre"]
    )
    none = F.lit(None).cast("bigint").alias("author_id")
    out = items.select(F.lit("manga").alias("rows_of"), "manga_id", none)
    links = bridges["manga_author"].select(F.lit("manga_author").alias("rows_of"), "manga_id", "author_id")
    return out.unionByName(links).unionByName(gone.select(F.lit("removed").alias("rows_of"), "manga_id", none))


@query(
    "a10_canonical_labels",
    """SELECT anime_id, CASE anime_id % 4 WHEN 0 THEN 'SPECIAL' WHEN 1 THEN 'TV' WHEN 2 THEN 'OVA' END AS type,
CASE anime_id % 5 WHEN 0 THEN 'CURRENTLY_AIRING' WHEN 1 THEN 'FINISHED_AIRING' WHEN 2 THEN 'NOT_YET_AIRED' WHEN 3 THEN 'Weird' END AS status FROM {stored}""",
    stored=STORED_LABELS,
)
def _(spark, sf):
    return merge.canonicalise(spark.sql(STORED_LABELS, part=source(spark, sf, "part")))


@query(
    "a11_adult_backfill",
    "SELECT anime_id, anime_id IN (SELECT anime_id FROM {adult}) AS is_adult FROM {anime}",
    adult=ADULT,
)
def _(spark, sf):
    cat = _screened(spark, sf)
    rows = adult.backfill_adult(cat.anime, cat.anime_genre, cat.genre, LINKS["anime_genre"])
    return rows.select("anime_id", "is_adult")


# --- I1-I4, I15, A4, A5: merges -------------------------------------------------

AFTER_TYPE = "COALESCE(p.type, a.type, 'UNKNOWN')"
AFTER_SEASON = f"COALESCE(p.season_named, CASE WHEN {AFTER_TYPE} = 'TV' THEN COALESCE(p.season_aired, a.season) END)"
ANIME_MERGED = f"""SELECT COALESCE(a.anime_id, -p.k) AS anime_id, p.k AS mal_id, COALESCE(p.title, a.title, 'MAL anime ' || p.k) AS title,
  COALESCE(p.alternative_title, a.alternative_title) AS alternative_title, CASE WHEN p.has_synopsis THEN p.synopsis ELSE a.synopsis END AS synopsis,
  {AFTER_TYPE} AS type, COALESCE(p.status, a.status) AS status, {AFTER_SEASON} AS season, CASE WHEN p.has_year THEN p.year ELSE a.year END AS year,
  CASE WHEN p.has_score THEN p.score ELSE a.score END AS score, COALESCE(p.popularity, a.popularity) AS popularity, COALESCE(p.members, a.members) AS members,
  CASE WHEN p.has_episodes THEN p.episodes ELSE a.episodes END AS episodes, COALESCE(p.url, a.mal_url, 'https://myanimelist.net/anime/' || p.k) AS mal_url,
  COALESCE(p.image_url, a.image_url, '') AS image_url, CASE WHEN p.has_relations THEN p.sequel ELSE COALESCE(a.sequel, FALSE) END AS sequel,
  array_to_string(CASE WHEN len(p.genres) > 0 THEN p.genres ELSE COALESCE(a.genres, []) END, ',') AS genres,
  array_to_string(COALESCE(a.genres_detailed, []) || list_filter(p.tags, lambda x: NOT list_contains(COALESCE(a.genres_detailed, []), x)), ',') AS genres_detailed,
  FALSE AS is_adult, a.anime_id IS NOT NULL AS known, a.season IS NULL AND {AFTER_SEASON} IS NOT NULL AS season_assigned
FROM {{kept}} AS p LEFT JOIN {{anime}} AS a ON a.mal_id = p.mal_id"""
M = {**V, "merged": ANIME_MERGED}
ANIME_COLUMNS = (
    "anime_id, mal_id, title, alternative_title, synopsis, type, status, season, year, score, popularity, "
    "members, episodes, mal_url, image_url, sequel, genres, genres_detailed, is_adult"
)


def _flat(rows, columns):
    arrays = [F.array_join(c, ",").alias(c) if c.startswith("genres") else F.col(c) for c in columns.split(", ")]
    return rows.select(*arrays)


def _gated(spark, sf):
    return gate.gate_anime(stored_anime_rows(spark, sf)).filter("NOT adult")


@query("i1_merge_anime", f"SELECT {ANIME_COLUMNS} FROM {{merged}} WHERE known", **M)
def _(spark, sf):
    rows = view(spark, sf, "anime").join(_gated(spark, sf).select("mal_id", "e"), "mal_id")
    return _flat(merge.merge_anime(rows, now()), ANIME_COLUMNS)


@query("i2_new_anime", f"SELECT {ANIME_COLUMNS} FROM {{merged}} WHERE NOT known", **M)
def _(spark, sf):
    known = view(spark, sf, "anime").select("mal_id")
    fresh = _gated(spark, sf).join(known, "mal_id", "left_anti")
    return _flat(merge.merge_anime(merge.new_anime(fresh), now()), ANIME_COLUMNS)


PRINT_KEPT = "c_custkey % 47 <> 0 AND c_custkey % 43 <> 0 AND c_custkey % 31 <> 0 AND c_custkey % 59 <> 0 AND c_custkey % 7 IN (0, 1, 5, 6)"
# Stored titles stand for every second key only, so that the rest is new.
STORED_MANGA = "SELECT * FROM {manga} WHERE manga_id % 2 = 0"
PRINT_MERGED = f"""SELECT m.manga_id AS known_id, c_custkey AS mal_id, CASE WHEN c_custkey % 9 > 0 THEN 'New ' || c_name ELSE COALESCE(m.title, 'MAL manga ' || c_custkey) END AS title,
  CASE WHEN c_custkey % 2 = 0 THEN 'JP ' || c_custkey ELSE m.alternative_title END AS alternative_title,
  CASE c_custkey % 3 WHEN 0 THEN m.synopsis WHEN 2 THEN 'S' || c_custkey END AS synopsis, 'MANGA' AS content_type,
  CASE c_custkey % 7 WHEN 0 THEN m.manga_type WHEN 6 THEN 'Manga' END AS manga_type,
  CASE c_custkey % 4 WHEN 0 THEN m.status WHEN 1 THEN 'Publishing' END AS status,
  CASE WHEN c_custkey % 5 = 0 THEN m.publication_year ELSE {PRINT_YEAR} END AS publication_year,
  CASE c_custkey % 3 WHEN 0 THEN m.score WHEN 2 THEN CAST(c_custkey % 9 + 0.25 AS DOUBLE) END AS score,
  CASE WHEN c_custkey % 3 = 1 THEN c_custkey ELSE m.popularity END AS popularity, m.members,
  CAST(CASE c_custkey % 3 WHEN 0 THEN m.chapters WHEN 2 THEN c_custkey % 300 END AS INT) AS chapters,
  CAST(CASE c_custkey % 4 WHEN 1 THEN NULL WHEN 2 THEN c_custkey % 40 ELSE m.volumes END AS INT) AS volumes,
  COALESCE(m.mal_url, 'https://myanimelist.net/manga/' || c_custkey) AS mal_url, COALESCE(m.image_url, '') AS image_url,
  array_to_string(CASE c_custkey % 4 WHEN 0 THEN COALESCE(m.genres, []) WHEN 2 THEN ['NATION_3', 'Fresh ' || (c_custkey % 5)] ELSE [] END, ',') AS genres,
  array_to_string(CASE WHEN c_custkey % 4 = 0 AND c_custkey % 5 <> 0 THEN COALESCE(m.genres_detailed, []) ELSE
    CASE WHEN c_custkey % 4 = 2 THEN ['nation_3', 'fresh ' || (c_custkey % 5)] ELSE [] END || CASE WHEN c_custkey % 5 = 0 THEN ['isekai'] ELSE [] END END, ',') AS genres_detailed,
  FALSE AS is_adult
FROM {{customer}} LEFT JOIN {{stored_manga}} AS m ON m.mal_id = c_custkey WHERE {PRINT_KEPT}"""
P = {"stored_manga": STORED_MANGA, "merged": PRINT_MERGED}
PRINT_COLUMNS = (
    "mal_id, title, alternative_title, synopsis, content_type, manga_type, status, publication_year, score, "
    "popularity, members, chapters, volumes, mal_url, image_url, genres, genres_detailed, is_adult"
)


def _stored_manga(spark, sf):
    return view(spark, sf, "manga").filter("manga_id % 2 = 0")


def _gated_manga(spark, sf):
    return gate.gate_manga(materialise(manga_rows(spark, sf), "clean"), "MANGA").filter("NOT adult")


@query("i3_merge_manga", f"SELECT known_id AS manga_id, {PRINT_COLUMNS} FROM {{merged}} WHERE known_id IS NOT NULL", **P)
def _(spark, sf):
    rows = _stored_manga(spark, sf).join(_gated_manga(spark, sf).select("mal_id", "e"), "mal_id")
    return _flat(merge.merge_manga(rows, F.lit("MANGA"), now()), "manga_id, " + PRINT_COLUMNS)


@query(
    "i4_new_manga",
    f"""SELECT (SELECT max(manga_id) FROM {{stored_manga}}) + row_number() OVER (ORDER BY mal_id) AS manga_id, {PRINT_COLUMNS}
FROM {{merged}} WHERE known_id IS NULL""",
    **P,
)
def _(spark, sf):
    stored = _stored_manga(spark, sf)
    fresh = _gated_manga(spark, sf).join(stored.select("mal_id"), "mal_id", "left_anti").select("mal_id", "e")
    fresh = identity.numbered(fresh, stored, "mal_id", "manga_id")
    rows = merge.merge_manga(merge.new_manga(fresh, F.lit("MANGA")), F.lit("MANGA"), now())
    return _flat(rows, "manga_id, " + PRINT_COLUMNS)


# Many keys fold onto few ids, so pages hold duplicates and ids recur on later pages.
FOLDED = "SELECT k, page, pos, mal_id % 97 + 1 AS mal_id, is_adult, COALESCE(type, 'UNKNOWN') AS type, k % 8 IN (0, 1, 4) AS untyped FROM {pay} WHERE mal_id IS NOT NULL"


@query(
    "i15_gate_entries",
    """SELECT mal_id, adult, CASE WHEN NOT adult THEN k END AS k FROM (SELECT *, row_number() OVER (PARTITION BY mal_id ORDER BY page DESC) AS rn FROM (
SELECT mal_id, page, bool_or(is_adult) AS adult, max(k) FILTER (WHERE NOT is_adult AND (untyped OR type = 'TV')) AS k FROM {folded} GROUP BY mal_id, page)
WHERE adult OR k IS NOT NULL) WHERE rn = 1""",
    folded=FOLDED,
    **V,
)
def _(spark, sf):
    rows = stored_anime_rows(spark, sf).withColumn("mal_id", F.col("mal_id") % 97 + 1)
    gated = gate.gate_anime(rows, allowed_types=("TV",), default_type="TV")
    return gated.select("mal_id", "adult", F.col("e.k").alias("k"))


@query(
    "a4_anime_page_upsert",
    f"""SELECT outcome, season_assigned, count(*) AS n, CAST(sum(mal_id) AS BIGINT) AS ids FROM (
SELECT CASE WHEN known THEN 'updated' ELSE 'inserted' END AS outcome, season_assigned, mal_id FROM {{merged}}
UNION ALL SELECT 'removed_adult', FALSE, p.mal_id FROM {{pay}} AS p JOIN {{anime}} AS a ON a.mal_id = p.mal_id WHERE p.is_adult
UNION ALL SELECT 'stored', FALSE, anime_id FROM {{anime}} AS a WHERE NOT EXISTS (SELECT 1 FROM {{pay}} AS p WHERE p.mal_id = a.mal_id AND p.is_adult)
UNION ALL SELECT 'stored', FALSE, anime_id FROM {{merged}} WHERE NOT known) GROUP BY ALL""",
    **M,
)
def _(spark, sf):
    applied = apply.apply_anime_page(catalogue(spark, sf), stored_anime_rows(spark, sf), now(), discover_missing=True)
    stored = applied.catalogue.anime.select(
        F.lit("stored").alias("outcome"), F.lit(False).alias("season_assigned"), F.col("anime_id").alias("mal_id")
    )
    rows = applied.titles.select("outcome", "season_assigned", "mal_id").unionByName(stored)
    return rows.groupBy("outcome", "season_assigned").agg(
        F.count("*").alias("n"), F.sum("mal_id").alias("ids")
    )


@query(
    "a5_season_import",
    """SELECT saved, skipped, assigned FROM (SELECT least(count(*), 500) AS saved FROM {kept}),
(SELECT count(*) - count(*) FILTER (WHERE mal_id IS NOT NULL AND NOT is_adult) AS skipped FROM {pay}),
(SELECT count(*) AS assigned FROM (SELECT * FROM {kept} ORDER BY page, pos LIMIT 500) AS p LEFT JOIN {anime} AS a ON a.mal_id = p.mal_id
WHERE a.season IS NULL AND (p.k % 8 IN (0, 1, 3, 7) OR p.season_named IS NOT NULL OR (COALESCE(p.type, a.type, 'UNKNOWN') = 'TV' AND p.season_aired IS NOT NULL)))""",
    **V,
)
def _(spark, sf):
    applied, counts = apply.import_season(
        catalogue(spark, sf), stored_anime_rows(spark, sf), now(), 2021, "spring", limit=500
    )
    assigned = applied.titles.agg(F.count_if("season_assigned")).scalar()
    return counts.withColumn("assigned", assigned)


@query(
    "a5_season_import_all",
    """SELECT saved, skipped, assigned FROM (SELECT count(*) AS saved FROM {kept}),
(SELECT count(*) - count(*) FILTER (WHERE mal_id IS NOT NULL AND NOT is_adult) AS skipped FROM {pay}),
(SELECT count(*) AS assigned FROM {kept} AS p LEFT JOIN {anime} AS a ON a.mal_id = p.mal_id
WHERE a.season IS NULL AND (p.k % 8 IN (0, 1, 3, 7) OR p.season_named IS NOT NULL OR (COALESCE(p.type, a.type, 'UNKNOWN') = 'TV' AND p.season_aired IS NOT NULL)))""",
    **V,
)
def _(spark, sf):
    applied, counts = apply.import_season(catalogue(spark, sf), stored_anime_rows(spark, sf), now(), 2021, "spring")
    assigned = applied.titles.agg(F.count_if("season_assigned")).scalar()
    return counts.withColumn("assigned", assigned)


# --- I5, I9-I14: links and identities -------------------------------------------


@query(
    "i5_reconcile_genres",
    """SELECT action, count(*) AS n FROM (SELECT CASE WHEN l.anime_id IS NULL THEN 'create' WHEN w.anime_id IS NULL THEN 'remove' ELSE 'keep' END AS action FROM (
SELECT k AS anime_id, unnest(genres) AS name FROM {kept}) AS w FULL JOIN (SELECT l.anime_id, g.name FROM {anime_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id
WHERE l.anime_id IN (SELECT k FROM {kept} WHERE len(genres) > 0)) AS l ON l.anime_id = w.anime_id AND l.name = w.name) GROUP BY action""",
    **V,
)
def _(spark, sf):
    cat, link = catalogue(spark, sf), LINKS["anime_genre"]
    # Stored first: a filter on cleaned fields moves below the cleaning and reads the payload once a field.
    wanted = stored_anime_rows(spark, sf).filter("mal_id IS NOT NULL AND NOT is_adult")
    wanted = wanted.select(F.col("k").alias("item_id"), "genres", F.lit(True).alias("has_genres"))
    scope, named, unknown = reconcile.reconcile_genres(cat.genre, wanted, False, link)
    genre = cat.genre.unionByName(identity.numbered(unknown, cat.genre, "name").select("id", "name"))
    incoming = named.join(genre.withColumnRenamed("id", link.ref), "name").select(link.item, link.ref)
    actions = reconcile.reconcile_links(cat.anime_genre, incoming, scope, link)
    return actions.groupBy("action").agg(F.count("*").alias("n"))


@query(
    "i9_reconcile_studio_links",
    """SELECT COALESCE(c.anime_id, i.anime_id) AS anime_id, COALESCE(c.studio_id, i.studio_id) AS studio_id,
CASE WHEN c.anime_id IS NULL THEN 'create' WHEN i.anime_id IS NOT NULL THEN 'keep' WHEN c.complete THEN 'remove' ELSE 'retain' END AS action
FROM (SELECT l.*, s.complete FROM {anime_studio} AS l JOIN {studio_scope} AS s ON s.anime_id = l.anime_id) AS c
FULL JOIN {incoming_studio} AS i ON i.anime_id = c.anime_id AND i.studio_id = c.studio_id""",
)
def _(spark, sf):
    return reconcile.reconcile_links(
        view(spark, sf, "anime_studio"),
        view(spark, sf, "incoming_studio"),
        view(spark, sf, "studio_scope"),
        LINKS["studio"],
    )


@query(
    "i10_reconcile_streaming_links",
    """SELECT COALESCE(c.anime_id, i.k) AS anime_id, COALESCE(c.service_key, i.key) AS service_key, COALESCE(i.url, c.url) AS url,
CASE WHEN c.anime_id IS NULL THEN 'create' WHEN i.k IS NOT NULL THEN CASE WHEN i.url = c.url THEN 'keep' ELSE 'update' END WHEN c.complete THEN 'remove' ELSE 'retain' END AS action
FROM (SELECT l.*, s.complete FROM {anime_streaming_service} AS l JOIN {service_state} AS s ON s.k = l.anime_id AND s.k % 5 > 1) AS c
FULL JOIN (SELECT k, key, CASE WHEN k % 2 = 0 AND key = 'machinery' THEN url || '?x' ELSE url END AS url FROM {services}) AS i ON i.k = c.anime_id AND i.key = c.service_key""",
    **E,
)
def _(spark, sf):
    values, completeness = parsing.parse_streaming(_titles(anime_rows(spark, sf)))
    scope = completeness.filter("is_list").select(F.col("item_id").alias("anime_id"), "complete")
    moved = (F.col("item_id") % 2 == 0) & (F.col("key") == "machinery")
    url = F.when(moved, F.concat("url", F.lit("?x"))).otherwise(F.col("url"))
    incoming = values.select(F.col("item_id").alias("anime_id"), F.col("key").alias("service_key"), url.alias("url"))
    links = view(spark, sf, "anime_streaming_service")
    return reconcile.reconcile_links(links, incoming, scope, LINKS["streaming_service"], "url")


@query(
    "i11_reconcile_author_links",
    """SELECT COALESCE(c.manga_id, i.k) AS manga_id, COALESCE(c.author_id, i.author_id) AS author_id, CASE WHEN i.k IS NULL THEN c.role ELSE i.role END AS role,
CASE WHEN c.manga_id IS NULL THEN 'create' WHEN i.k IS NOT NULL THEN CASE WHEN i.role IS NOT DISTINCT FROM c.role THEN 'keep' ELSE 'update' END WHEN c.complete THEN 'remove' ELSE 'retain' END AS action
FROM (SELECT l.*, s.complete FROM {manga_author} AS l JOIN {author_state} AS s ON s.k = l.manga_id AND s.k % 6 > 1) AS c
FULL JOIN (SELECT k, CASE n WHEN 0 THEN 1 + 3 * (k % 60) WHEN 1 THEN 2 + 3 * (k % 60) ELSE 200 + k % 5 END AS author_id, CASE WHEN k % 5 > 0 THEN role END AS role FROM {authors}) AS i
ON i.k = c.manga_id AND i.author_id = c.author_id""",
    **E,
)
def _(spark, sf):
    values, completeness = parsing.parse_authors(_titles(manga_rows(spark, sf)))
    scope = completeness.filter("is_list").select(F.col("item_id").alias("manga_id"), "complete")
    resolved = identity.resolve_authors(view(spark, sf, "author"), values)[1]
    # Roles that some titles withdraw.
    role = F.when(F.col("item_id") % 5 > 0, F.col("role"))
    incoming = resolved.select(F.col("item_id").alias("manga_id"), F.col("ref_id").alias("author_id"), role.alias("role"))
    return reconcile.reconcile_links(view(spark, sf, "manga_author"), incoming, scope, LINKS["author"], "role")


# Suppliers whose provider id and name rows differ merge, per payload rule.
MERGES = """SELECT DISTINCT n.id AS old_id, i.id AS new_id FROM {studios} AS v JOIN {studio} AS i ON i.mal_id = v.provider_id
JOIN {studio} AS n ON n.normalized_name = v.key WHERE n.id <> i.id"""


@query(
    "i12_resolve_studios",
    """SELECT id, mal_id, name, normalized_name FROM (
SELECT s.id, s.mal_id, COALESCE(a.name, b.name, s.name) AS name, COALESCE(a.key, s.normalized_name) AS normalized_name FROM {studio} AS s
LEFT JOIN (SELECT DISTINCT provider_id, name, key FROM {studios} WHERE provider_id IS NOT NULL) AS a ON a.provider_id = s.mal_id
LEFT JOIN (SELECT DISTINCT name, key FROM {studios} WHERE provider_id IS NULL) AS b ON b.key = s.normalized_name
WHERE s.id NOT IN (SELECT old_id FROM {merges})
UNION ALL SELECT (SELECT max(id) FROM {studio}) + row_number() OVER (ORDER BY key), provider_id, name, key FROM (SELECT DISTINCT name, key, provider_id FROM {studios}) AS v
WHERE key NOT IN (SELECT normalized_name FROM {studio}) AND (provider_id IS NULL OR provider_id NOT IN (SELECT mal_id FROM {studio} WHERE mal_id IS NOT NULL)))""",
    merges=MERGES,
    **E,
)
def _(spark, sf):
    values, _ = parsing.parse_studios(_titles(anime_rows(spark, sf)))
    values = values.withColumn("seq", F.struct("seq", "pos"))
    return identity.resolve_studios(view(spark, sf, "studio"), values)[0]


@query(
    "i12_move_links",
    """SELECT DISTINCT l.anime_id, COALESCE(m.new_id, l.studio_id) AS studio_id FROM {anime_studio} AS l LEFT JOIN {merges} AS m ON m.old_id = l.studio_id""",
    merges=MERGES,
    **E,
)
def _(spark, sf):
    values, _ = parsing.parse_studios(_titles(anime_rows(spark, sf)))
    values = values.withColumn("seq", F.struct("seq", "pos"))
    remap = identity.resolve_studios(view(spark, sf, "studio"), values)[2]
    return identity.move_links(view(spark, sf, "anime_studio"), remap, "anime_id", "studio_id")


@query(
    "i12_merge_chains",
    """SELECT DISTINCT src AS old_id, (SELECT min(r.id) FROM {studio} AS r WHERE r.id > src - 7 AND r.id // 7 = src // 7) AS new_id
FROM (SELECT id + 1 AS src FROM {studio} WHERE id % 7 < 6 AND id + 1 IN (SELECT id FROM {studio}))""",
)
def _(spark, sf):
    ids = view(spark, sf, "studio").select("id")
    edges = ids.filter("id % 7 < 6").select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    return identity.canonical_ids(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))


@query(
    "i13_resolve_services",
    """SELECT COALESCE(c.name, s.name) AS name, COALESCE(c.key, s.normalized_name) AS normalized_name FROM {streaming_service} AS s
FULL JOIN (SELECT key, max(name) AS name FROM {services} AS v WHERE NOT EXISTS (SELECT 1 FROM {anime_streaming_service} AS l WHERE l.anime_id = v.k AND l.service_key = v.key) GROUP BY key) AS c
ON c.key = s.normalized_name""",
    **E,
)
def _(spark, sf):
    cat = catalogue(spark, sf)
    values, _ = parsing.parse_streaming(_titles(anime_rows(spark, sf)))
    linked = cat.anime_streaming_service.select(
        F.col("anime_id").alias("item_id"), F.col("service_key").alias("key")
    )
    created = values.join(linked, ["item_id", "key"], "left_anti")
    return identity.resolve_services(cat.streaming_service, created)


@query(
    "i14_resolve_authors",
    """SELECT COALESCE(a.id, (SELECT max(id) FROM {author}) + 1 + CAST(right(v.key, 1) AS BIGINT)) AS id, a.mal_id,
COALESCE(v.name, a.name) AS name, COALESCE(v.key, a.normalized_name) AS normalized_name FROM {author} AS a
FULL JOIN (SELECT DISTINCT n, name, key, provider_id FROM {authors}) AS v ON (v.n = 0 AND v.key = a.normalized_name) OR (v.n = 1 AND v.provider_id = a.mal_id)""",
    **E,
)
def _(spark, sf):
    values, _ = parsing.parse_authors(_titles(manga_rows(spark, sf)))
    values = values.withColumn("seq", F.struct("seq", "pos"))
    return identity.resolve_authors(view(spark, sf, "author"), values)[0]
