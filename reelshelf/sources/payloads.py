"""Provider-like JSON derived from the sample tables, for tests and benchmarks.

Each field cycles through present, absent, null and wrongly typed values by the
row's key, so every merge rule meets every case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.sources.bindings import source

# Field name -> Spark SQL text that yields JSON, or NULL to leave the field out.
ANIME = {
    "mal_id": "CASE WHEN k % 47 = 0 THEN 'true' WHEN k % 43 = 0 THEN '\"' || k || '\"' "
    "WHEN k % 53 = 0 THEN k || '.5' ELSE '' || k END",
    "title": "CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN '\"\"' ELSE '\"New ' || p_name || '\"' END",
    "title_english": "CASE WHEN k % 4 = 0 THEN '\"EN ' || k || '\"' ELSE 'null' END",
    "title_japanese": "CASE WHEN k % 2 = 0 THEN '\"JP ' || k || '\"' END",
    "synopsis": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '\"  \"' ELSE '\" S' || k || ' \"' END",
    "type": "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '\"tv_special\"' WHEN 3 THEN '\"Tv\"' "
    "WHEN 4 THEN '5' WHEN 5 THEN '\"  \"' WHEN 6 THEN '\" Movie \"' ELSE '\"TV\"' END",
    "status": "CASE k % 6 WHEN 0 THEN '\"Currently Airing\"' WHEN 1 THEN '\"finished-airing\"' WHEN 2 THEN '\"weird\"' "
    "WHEN 3 THEN NULL WHEN 4 THEN 'null' ELSE '\"Not yet aired\"' END",
    "season": "CASE k % 7 WHEN 0 THEN '\" Winter \"' WHEN 1 THEN '\"autumn\"' WHEN 3 THEN 'null' WHEN 6 THEN '\"summer\"' END",
    "aired": "CASE k % 3 WHEN 0 THEN '{\"from\":\"2020-' || lpad('' || (k % 12 + 1), 2, '0') || '-01T00:00:00+00:00\"}' "
    "WHEN 1 THEN '{\"prop\":{\"from\":{\"month\":' || (k % 14) || '}}}' ELSE 'null' END",
    "year": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE '' || (2000 + k % 25) END",
    "score": "CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '0' WHEN 2 THEN 'true' WHEN 3 THEN '\"7\"' "
    "WHEN 4 THEN (k % 10) || '.5' WHEN 5 THEN '' || (k % 10 + 1) END",
    "popularity": "CASE k % 5 WHEN 0 THEN '-1' WHEN 1 THEN '' || k WHEN 2 THEN '1.5' WHEN 3 THEN 'true' END",
    "members": "CASE k % 4 WHEN 0 THEN '0' WHEN 1 THEN '' || (k * 3) WHEN 2 THEN 'null' ELSE '\"9\"' END",
    "episodes": "CASE k % 3 WHEN 1 THEN 'null' WHEN 2 THEN '' || (k % 50) END",
    "url": "CASE k % 4 WHEN 0 THEN '\"\"' WHEN 1 THEN NULL ELSE '\"https://p.example/' || k || '\"' END",
    "images": "CASE k % 5 WHEN 1 THEN '{\"jpg\":{\"large_image_url\":\"L' || k || '\",\"image_url\":\"I\"}}' "
    "WHEN 2 THEN '{\"jpg\":{\"large_image_url\":\"\",\"image_url\":\"I' || k || '\"}}' WHEN 3 THEN '{\"jpg\":null}' "
    "WHEN 4 THEN '{\"jpg\":{\"image_url\":5}}' END",
    "relations": "CASE k % 4 WHEN 1 THEN 'null' WHEN 2 THEN '[{\"relation\":\"Prequel\"},{\"relation\":\"Sequel\"}]' "
    "WHEN 3 THEN '[5,{\"relation\":\"Other\"}]' END",
    "genres": "CASE k % 6 WHEN 1 THEN '[]' WHEN 2 THEN '[{\"name\":\" Action \"},{\"name\":\"Action\"},{\"name\":\"Drama\"}]' "
    "WHEN 3 THEN '[{\"name\":\"' || p_brand || '\"}]' WHEN 4 THEN '[null,\"x\",{\"name\":5},{\"name\":\"  \"},{\"name\":\"NATION_3\"}]' "
    "WHEN 5 THEN '{\"name\":\"x\"}' END",
    "explicit_genres": "CASE WHEN k % 31 = 0 THEN '[{\"name\":\" Hentai\"}]' END",
    "themes": "CASE WHEN k % 5 = 0 THEN '[{\"name\":\"School\"}]' END",
    "rating": "CASE k % 37 WHEN 0 THEN '\"Rx - Hentai\"' WHEN 1 THEN '5' ELSE '\"PG\"' END",
    # A stored studio under its id and a new name, a stored name without id, a
    # repeated spelling, and now and then a defect.
    "studios": "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '[]' ELSE '[{\"mal_id\":' || (1001 + 10 * (k % 9)) "
    "|| ',\"name\":\"Supplier#' || lpad('' || (2 + 10 * (k % 9)), 9, '0') || '\"},"
    "{\"name\":\" supplier#' || lpad('' || (5 + 10 * (k % 9)), 9, '0') || '\"},"
    "{\"name\":\"Studio   ' || (k % 20) || '\"},{\"mal_id\":9,\"name\":\"STUDIO ' || (k % 20) || '\"}' || "
    "CASE k % 6 WHEN 4 THEN ',null' WHEN 5 THEN ',{\"mal_id\":-1,\"name\":\"Odd ' || (k % 5) || '\"}' ELSE '' END || ']' END",
    "streaming": "CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '5' WHEN 2 THEN '[]' ELSE '[{\"name\":\"Machinery\",\"url\":\" https://machinery.example/' || k "
    "|| '\"},{\"name\":\"New  Tube\",\"url\":\"HTTPS://tube.example/' || k || '\"}' || "
    "CASE k % 5 WHEN 4 THEN ',{\"name\":\"Bad\",\"url\":\"javascript:alert(1)\"}' ELSE '' END || ']' END",
}

MANGA = {
    "mal_id": "CASE WHEN k % 47 = 0 THEN 'null' WHEN k % 43 = 0 THEN '[' || k || ']' ELSE '' || k END",
    "title": "CASE k % 9 WHEN 0 THEN NULL ELSE '\"New ' || c_name || '\"' END",
    "title_japanese": "CASE WHEN k % 2 = 0 THEN '\"JP ' || k || '\"' END",
    "type": "CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '\" MANHWA\"' WHEN 3 THEN '\"Novel\"' WHEN 4 THEN '5' WHEN 5 THEN '\"\"' "
    "ELSE '\"Manga\"' END",
    "synopsis": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'null' ELSE '\"S' || k || '\"' END",
    "status": "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '\" Publishing \"' WHEN 2 THEN '\"\"' ELSE 'false' END",
    "published": "CASE k % 5 WHEN 1 THEN 'null' WHEN 2 THEN '{\"prop\":{\"from\":{\"year\":' || (1990 + k % 30) || '}},\"from\":\"1980-01-01\"}' "
    "WHEN 3 THEN '{\"prop\":{\"from\":{\"year\":0}},\"from\":\" ' || (1970 + k % 40) || '-05\"}' "
    "WHEN 4 THEN '{\"from\":\"soon\"}' END",
    "score": "CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE (k % 9) || '.25' END",
    "popularity": "CASE k % 3 WHEN 0 THEN 'null' WHEN 1 THEN '' || k ELSE '-4' END",
    "chapters": "CASE k % 3 WHEN 1 THEN 'null' WHEN 2 THEN '' || (k % 300) END",
    "volumes": "CASE k % 4 WHEN 1 THEN 'null' WHEN 2 THEN '' || (k % 40) END",
    "genres": "CASE k % 4 WHEN 1 THEN '[]' WHEN 2 THEN '[{\"name\":\"NATION_3\"},{\"name\":\"Fresh ' || (k % 5) || '\"}]' WHEN 3 THEN 'null' END",
    "themes": "CASE WHEN k % 5 = 0 THEN '[{\"name\":\"Isekai\"},{\"name\":\"ISEKAI\"}]' END",
    "demographics": "CASE WHEN k % 31 = 0 THEN '[{\"name\":\"EROTICA\"}]' END",
    "rating": "CASE WHEN k % 59 = 0 THEN '\"hentai\"' END",
    "authors": "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '\"x\"' WHEN 2 THEN '[]' ELSE '[{\"mal_id\":' || (501 + 3 * (k % 60)) || ',\"name\":\"Author ' || (1 + 3 * (k % 60)) "
    "|| '\",\"type\":\"People\"},{\"name\":\"author   ' || (1 + 3 * (k % 60)) || '\",\"role\":\" Story \"},"
    "{\"mal_id\":' || (502 + 3 * (k % 60)) || ',\"name\":\"Pen ' || (k % 60) || '\",\"type\":\"Art\"}' || "
    "CASE k % 6 WHEN 4 THEN ',\"plain\"' WHEN 5 THEN ',{\"mal_id\":-1,\"name\":\"Odd ' || (k % 5) || '\"}' ELSE '' END || ']' END",
}


def _bodies(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    # A sample table is one small file. JSON work should use every core.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("k", F.col(key)).repartition(cores, F.floor(F.col(key) / 50))
    parts = [F.concat(F.lit(f'"{name}":'), F.expr(sql)) for name, sql in fields.items()]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return rows.select(
        "k",
        F.floor(F.col("k") / 50).cast("int").alias("page"),
        (F.col("k") % 50).cast("int").alias("pos"),
        text.alias("body"),
    )


def anime_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """One provider object per anime as JSON text: (k, page, pos, body)."""
    return _bodies(source(spark, folder, "part"), "p_partkey", ANIME)


def manga_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """One provider object per print title as JSON text."""
    return _bodies(source(spark, folder, "customer"), "c_custkey", MANGA)


def parsed(bodies: DataFrame, scan_key: str = "sample") -> DataFrame:
    """The same as entries: (scan_key, k, page, pos, entry)."""
    return bodies.select(
        F.lit(scan_key).alias("scan_key"), "k", "page", "pos", F.try_parse_json("body").alias("entry")
    )


def landed(bodies: DataFrame, scan_key: str) -> DataFrame:
    """The same as landed pages of up to 50 objects, with every kind of bad envelope."""
    cores = bodies.sparkSession.sparkContext.defaultParallelism
    pages = bodies.repartition(cores, "page").groupBy("page").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda e: e["body"]), ","
        ).alias("data")
    )
    last = F.lit(1_000_000)
    paging = (
        F.when(F.col("page") % 11 == 1, F.lit("null"))
        .when(F.col("page") % 11 == 2, F.lit('{"has_next_page":0}'))
        .when(F.col("page") % 11 == 3, F.lit('{"has_next_page":true,"current_page":999999}'))
        .when(F.col("page") % 11 == 4, F.lit('{"has_next_page":true,"last_visible_page":0}'))
        .when(F.col("page") % 11 == 5, F.lit('{"has_next_page":true,"last_visible_page":1}'))
        .when(F.col("page") % 11 == 6, F.concat(F.lit('{"has_next_page":false,"last_visible_page":'), last, F.lit("}")))
        .otherwise(F.concat(F.lit('{"has_next_page":true,"current_page":'), "page", F.lit("}")))
    )
    data = (
        F.when(F.col("page") % 11 == 7, F.lit('{"a":1}'))
        .when(F.col("page") % 11 == 8, F.lit("[null,7]"))
        .otherwise(F.concat(F.lit("["), "data", F.lit("]")))
    )
    body = F.concat(F.lit('{"data":'), data, F.lit(',"pagination":'), paging, F.lit("}"))
    body = F.when(F.col("page") % 11 == 9, F.lit("oops")).otherwise(body)
    return pages.select(
        F.lit(scan_key).alias("scan_key"),
        "page",
        F.when(F.col("page") % 11 == 10, 503).otherwise(200).cast("int").alias("status_code"),
        F.lit("2024-05-01").cast("timestamp").alias("fetched_at"),
        body.alias("body"),
    )
