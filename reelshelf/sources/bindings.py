"""Catalogue views over a star-schema sample, for tests and benchmarks.

Each view is one SELECT that Spark and an ANSI engine both accept; ``{name}``
stands for a source table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reelshelf.plans.catalogue import Catalogue

SOURCES = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}

VIEWS = {
    "anime": """SELECT p_partkey AS anime_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey END AS mal_id,
  p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS alternative_title,
  CASE p_type WHEN 'MEDIUM' THEN 'TV' WHEN 'STANDARD' THEN 'MOVIE' WHEN 'LARGE' THEN 'OVA' WHEN 'PROMO' THEN 'ONA' WHEN 'SMALL' THEN 'SPECIAL' ELSE 'UNKNOWN' END AS type,
  CASE WHEN p_type <> 'MEDIUM' THEN NULL WHEN p_partkey % 5 = 0 THEN 'winter' WHEN p_partkey % 5 = 1 THEN 'spring' WHEN p_partkey % 5 = 2 THEN 'summer' WHEN p_partkey % 5 = 3 THEN 'fall' END AS season,
  CASE p_partkey % 4 WHEN 0 THEN 'CURRENTLY_AIRING' WHEN 1 THEN 'FINISHED_AIRING' WHEN 2 THEN 'NOT_YET_AIRED' END AS status,
  CAST(CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 1995 + p_partkey % 31 END AS INT) AS year,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(10 + p_partkey * 37 % 90 AS DOUBLE) / 10 END AS score,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey * 7919 % 50021 END AS popularity,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey * 104729 % 1000003 END AS members,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS episodes,
  p_partkey % 29 = 0 AS is_adult, split(p_name, ' ') AS genres_detailed,
  split(CASE WHEN p_partkey % 37 = 0 THEN ' Hentai ,' ELSE '' END || p_type, ',') AS genres,
  CAST(CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 365 AS INT) END AS TIMESTAMP) AS last_sync,
  CAST(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(p_partkey % 97 AS INT) END AS TIMESTAMP) AS last_attempt,
  CAST(CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE DATE '2023-02-01' + CAST(p_partkey % 89 AS INT) END AS TIMESTAMP) AS last_streaming_attempt,
  CAST(CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE DATE '2023-03-01' + CAST(p_partkey % 83 AS INT) END AS TIMESTAMP) AS last_season_attempt,
  CASE WHEN p_partkey % 10 <> 0 THEN 'About ' || p_name END AS synopsis, p_partkey % 6 = 0 AS sequel,
  'https://catalogue.example/anime/' || CAST(p_partkey AS VARCHAR(20)) AS mal_url,
  'https://img.example/' || CAST(p_partkey AS VARCHAR(20)) || '.jpg' AS image_url
FROM {part}""",
    "manga": """SELECT c_custkey AS manga_id, c_custkey AS mal_id, CASE WHEN c_custkey % 3 = 0 THEN 'MANHWA' ELSE 'MANGA' END AS content_type,
  c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS alternative_title,
  CASE c_custkey % 4 WHEN 0 THEN ' Finished ' WHEN 1 THEN 'Publishing' WHEN 2 THEN 'on hiatus' END AS status,
  CAST(CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 1985 + c_custkey % 41 END AS INT) AS publication_year,
  CASE WHEN c_acctbal <= 0 THEN NULL ELSE CAST(10 + c_custkey * 53 % 90 AS DOUBLE) / 10 END AS score,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 6007 % 70001 END AS popularity,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey * 7001 % 900001 END AS members,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 1 + c_custkey % 300 END AS INT) AS chapters,
  CAST(CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE 1 + c_custkey % 40 END AS INT) AS volumes,
  c_custkey % 31 = 0 AS is_adult, split(lower(c_mktsegment) || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'school' ELSE 'seinen' END, ' ') AS genres_detailed,
  split(CASE WHEN c_custkey % 41 = 0 THEN 'EROTICA,' ELSE '' END || c_mktsegment, ',') AS genres,
  CASE WHEN c_custkey % 3 = 0 THEN 'Manhwa' ELSE 'Manga' END AS manga_type,
  CAST(CASE WHEN c_custkey % 21 = 0 THEN NULL ELSE DATE '2024-03-01' + CAST(c_custkey % 300 AS INT) END AS TIMESTAMP) AS last_sync,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE DATE '2023-01-01' + CAST(c_custkey % 97 AS INT) END AS TIMESTAMP) AS last_attempt,
  CASE WHEN c_custkey % 10 <> 0 THEN 'About ' || c_name END AS synopsis,
  'https://catalogue.example/manga/' || CAST(c_custkey AS VARCHAR(20)) AS mal_url,
  'https://img.example/m' || CAST(c_custkey AS VARCHAR(20)) || '.jpg' AS image_url
FROM {customer}""",
    "genre": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}",
    # The same dimension with one restricted name, for the adult screens.
    "screened_genre": """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey = 24 THEN ' Erotica ' ELSE n_name END AS name
FROM {nation}""",
    "anime_genre": """SELECT DISTINCT l_partkey AS anime_id, CAST(s_nationkey AS BIGINT) AS genre_id
FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_linenumber = 2""",
    "manga_genre": "SELECT DISTINCT o_custkey AS manga_id, o_orderkey % 25 AS genre_id FROM {orders}",
    "studio": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey + 1000 END AS mal_id,
  s_name AS name, lower(s_name) AS normalized_name FROM {supplier}""",
    "anime_studio": "SELECT DISTINCT l_partkey AS anime_id, l_suppkey AS studio_id FROM {lineitem} WHERE l_linenumber = 1",
    "streaming_service": "SELECT DISTINCT c_mktsegment AS name, lower(c_mktsegment) AS normalized_name FROM {customer}",
    "anime_streaming_service": """SELECT anime_id, service_key, 'https://' || service_key || '.example/' || CAST(anime_id AS VARCHAR(20)) AS url
FROM (SELECT DISTINCT l_partkey AS anime_id, lower(c_mktsegment) AS service_key
  FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey
  WHERE l_linenumber = 3 AND l_returnflag = 'R') AS pairs""",
    "author": """SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE id + 500 END AS mal_id,
  'Author ' || CAST(id AS VARCHAR(10)) AS name, 'author ' || CAST(id AS VARCHAR(10)) AS normalized_name
FROM (SELECT DISTINCT o_orderkey % 200 AS id FROM {orders}) AS ids""",
    "manga_author": """SELECT o_custkey AS manga_id, o_orderkey % 200 AS author_id, min(o_orderpriority) AS role
FROM {orders} GROUP BY o_custkey, o_orderkey % 200""",
    "site_visit": """SELECT v AS visitor_token_hash, visit_date, route, count(*) AS visit_count,
  min(ts) AS first_visited_at, max(ts) AS last_visited_at
FROM (SELECT {sha256}(CAST(user_id AS {text})) AS v, CAST(ts AS DATE) AS visit_date,
  event_type AS route, ts FROM {events}) AS hits GROUP BY v, visit_date, route""",
    # Incoming studio links: another slice of the same relation.
    "incoming_studio": """SELECT DISTINCT l_partkey AS anime_id, l_suppkey AS studio_id
FROM {lineitem} WHERE l_linenumber = 2 AND l_partkey % 10 <> 0""",
    "studio_scope": """SELECT p_partkey AS anime_id, p_partkey % 3 <> 0 AS complete FROM {part} WHERE p_partkey % 10 <> 0""",
}

_ANSI = {"sha256": "sha256", "text": "VARCHAR"}


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One sample table, read with its known schema."""
    return spark.read.schema(SOURCES[name]).parquet(f"{folder}/{name}.parquet")


def _needs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n not in _ANSI]


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One catalogue view as a DataFrame."""
    sql = VIEWS[name].replace("{sha256}(CAST(user_id AS {text}))", "sha2(CAST(user_id AS STRING), 256)")
    inputs = {
        n: source(spark, folder, n) if n in SOURCES else view(spark, folder, n)
        for n in _needs(sql)
    }
    return spark.sql(sql, **inputs)


def catalogue(spark: SparkSession, folder: str) -> Catalogue:
    """All catalogue tables over the sample in ``folder``."""
    return Catalogue(**{t: view(spark, folder, t) for t in Catalogue.tables()})


def ansi(body: str, **extra: str) -> str:
    """``body`` with every view it names defined as a common table expression."""
    texts = {**VIEWS, **extra}
    done: dict[str, str] = {}

    def fill(sql: str) -> str:
        for name in _needs(sql):
            if name in texts and name not in done:
                done[name] = ""  # keeps a recursive view from defining itself again
                text = fill(texts[name])
                del done[name]
                done[name] = text
        return re.sub(r"\{(\w+)\}", lambda m: _ANSI.get(m[1], m[1]), sql)

    main = fill(body)
    if not done:
        return main
    recursive = any(re.search(rf"\b{n}\b", t) for n, t in done.items())
    ctes = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{main}"
