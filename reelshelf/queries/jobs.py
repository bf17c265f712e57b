"""Batch and streaming jobs that write versions: publishing, refreshes, streams."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import apply, ranking, visitors, visits
from reelshelf.plans.catalogue import Catalogue
from reelshelf.plans.scheduled import answered, run_scheduled, select_queue
from reelshelf.plans.spec import CatalogueQuery
from reelshelf.queries.catalogue import FACETS, IDENTITY_SQL
from reelshelf.queries.ingest import (
    M,
    P,
    PRINT_OUTCOME,
    SERVICES,
    V,
    _details,
    _stored_manga,
    manga_rows,
    now,
    stored_anime_rows,
)
from reelshelf.queries.registry import query
from reelshelf.queries.visits import HEALTH_SQL
from reelshelf.session import materialise, scratch_dir
from reelshelf.sources import landing, payloads
from reelshelf.sources.bindings import SOURCES, VIEWS, catalogue, view
from reelshelf.sources.store import Store, publish_facets
from reelshelf.streaming.pages import TYPE_SCAN, UNKNOWN_SCAN, ingest_pages_stream
from reelshelf.streaming.visits import stored_visits, visit_stream, visit_windows, visitor_stream


def folder(spark) -> str:
    """A fresh folder below the shared scratch folder."""
    return f"{scratch_dir(spark)}/reelshelf/job-{uuid.uuid4().hex}"


def store_of(spark, cat: Catalogue) -> Store:
    """A new store that holds the sample catalogue."""
    store = Store(spark, folder(spark) + "/store")
    store.load({t: getattr(cat, t) for t in Catalogue.tables()})
    return store


# --- A4 print, A7 -------------------------------------------------------------


@query(
    "a4_manga_page_upsert",
    """SELECT outcome, count(*) AS n, CAST(sum(mal_id) AS BIGINT) AS ids FROM (
SELECT CASE WHEN known_id IS NULL THEN 'inserted' ELSE 'updated' END AS outcome, mal_id FROM {merged}
UNION ALL SELECT 'removed_adult', mal_id FROM {gone}
UNION ALL SELECT 'stored', mal_id FROM {stored_manga} WHERE mal_id NOT IN (SELECT mal_id FROM {gone})
UNION ALL SELECT 'stored', mal_id FROM {merged} WHERE known_id IS NULL) GROUP BY outcome""",
    gone="""SELECT mal_id FROM {stored_manga} WHERE mal_id % 47 <> 0 AND mal_id % 43 <> 0 AND (mal_id % 31 = 0 OR mal_id % 59 = 0)""",
    **P,
)
def _(spark, sf):
    cat = replace(catalogue(spark, sf), manga=_stored_manga(spark, sf))
    rows = materialise(manga_rows(spark, sf), "clean")
    applied = apply.apply_manga_page(cat, rows, now(), expected="MANGA")
    stored = applied.catalogue.manga.select(F.lit("stored").alias("outcome"), "mal_id")
    rows = applied.titles.select("outcome", "mal_id").unionByName(stored)
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("mal_id").alias("ids"))


# Titles as a page of known and new ones leaves them.
PAGED = {
    **V,
    "restricted": "SELECT a.anime_id FROM {anime} AS a JOIN {pay} AS p ON p.mal_id = a.mal_id WHERE p.is_adult",
    "paged": "SELECT COALESCE(a.anime_id, -p.k) AS anime_id, p.* FROM {kept} AS p LEFT JOIN {anime} AS a ON a.mal_id = p.mal_id",
}


def _paged(spark, sf) -> Store:
    cat = store_of(spark, catalogue(spark, sf)).catalogue()
    applied = apply.apply_anime_page(cat, stored_anime_rows(spark, sf), now(), discover_missing=True)
    cat.store.commit(applied.catalogue)
    return cat.store


@query(
    "a4_stored_titles",
    """SELECT anime_id, mal_id, title FROM {anime} WHERE anime_id NOT IN (SELECT anime_id FROM {restricted}) AND anime_id NOT IN (SELECT anime_id FROM {paged})
UNION ALL SELECT p.anime_id, p.mal_id, COALESCE(p.title, a.title, 'MAL anime ' || p.k) FROM {paged} AS p LEFT JOIN {anime} AS a ON a.anime_id = p.anime_id""",
    **PAGED,
)
def _(spark, sf):
    return _paged(spark, sf).read("anime").select("anime_id", "mal_id", "title")


@query(
    "a4_stored_genre_links",
    """SELECT anime_id, unnest(genres) AS name FROM {paged} WHERE len(genres) > 0
UNION ALL SELECT l.anime_id, g.name FROM {anime_genre} AS l JOIN {genre} AS g ON g.id = l.genre_id
WHERE l.anime_id NOT IN (SELECT anime_id FROM {restricted}) AND l.anime_id NOT IN (SELECT anime_id FROM {paged} WHERE len(genres) > 0)""",
    **PAGED,
)
def _(spark, sf):
    store = _paged(spark, sf)
    genre = store.read("genre").withColumnRenamed("id", "genre_id")
    return store.read("anime_genre").join(genre, "genre_id").select("anime_id", "name")


@query(
    "a7_publish_facets",
    "SELECT content_type, facet_type, count(*) AS n, min(value) AS first_value, max(value) AS last_value FROM {facets} GROUP BY content_type, facet_type",
    **FACETS,
)
def _(spark, sf):
    store = Store(spark, folder(spark))
    publish_facets(store, catalogue(spark, sf))
    rows = store.read("catalogue_facet").groupBy("content_type", "facet_type")
    return rows.agg(
        F.count("*").alias("n"), F.min("value").alias("first_value"), F.max("value").alias("last_value")
    )


def _bucket_sql(rows: str) -> str:
    """``rows`` with ``bucket``: Spark's hash (Murmur3 of a 64-bit id, seed 42) modulo 16, in steps of 32 bits."""
    mask = 4294967295

    def times(x, factor):
        return f"(({x}) * {factor}::UBIGINT) & {mask}"

    def turned(x, bits):
        return f"((({x}) << {bits}) & {mask}) | (({x}) >> {32 - bits})"

    steps = [f"SELECT *, 42::UBIGINT AS h, 0::UBIGINT AS k, (record_id & {mask})::UBIGINT AS low, ((record_id >> 32) & {mask})::UBIGINT AS high FROM {rows}"]
    for word in ("low", "high"):
        for value in (
            f"{times(word, 3432918353)} AS k",
            f"{turned('k', 15)} AS k",
            f"xor(h, {times('k', 461845907)}) AS h",
            f"{turned('h', 13)} AS h",
            f"(h * 5 + 3864292196) & {mask} AS h",
        ):
            name = value.rsplit(" ", 1)[1]
            steps.append(f"SELECT * EXCLUDE ({name}), {value} FROM ({steps[-1]})")
    for value in ("xor(h, 8::UBIGINT)", "xor(h, h >> 16)", times("h", 2246822507), "xor(h, h >> 13)", times("h", 3266489909), "xor(h, h >> 16)"):
        steps.append(f"SELECT * EXCLUDE (h), {value} AS h FROM ({steps[-1]})")
    return f"(SELECT *, h & 15 AS bucket FROM ({steps[-1]}))"


# Two percent of sixteen buckets is one; 10 is the one that seed 7 draws.
@query(
    "f8_store_sample",
    f"""SELECT content_type, record_id, mal_id FROM {_bucket_sql("{rows}")} WHERE bucket = 10
ORDER BY sha256(content_type || '-' || record_id || '-7') LIMIT 6""",
    rows=IDENTITY_SQL,
)
def _(spark, sf):
    cat = store_of(spark, catalogue(spark, sf)).catalogue()
    return cat.random(CatalogueQuery(), 6, seed=7).select("content_type", "record_id", "mal_id")


# --- I16-I19: refreshes from every landed answer ----------------------------------

FETCHED = """CASE WHEN q.mal_id IS NULL THEN 'missing_mal_id' WHEN q.mal_id % 13 = 0 THEN 'not_found' WHEN q.mal_id % 13 < 4 THEN 'temporary'
WHEN q.mal_id % 13 < 6 THEN 'invalid_payload' WHEN q.mal_id % 31 = 0 OR q.mal_id % 37 = 0 THEN 'removed_adult' ELSE 'updated' END"""
# Every title has an answer, but for those that cannot be requested: the first 1,000
# of the queue may be among these.
REFRESH_QUEUE = """SELECT * FROM {anime} WHERE mal_id IS NOT NULL UNION ALL
SELECT * FROM (SELECT * FROM {anime} ORDER BY last_attempt ASC NULLS FIRST, anime_id LIMIT 1000) WHERE mal_id IS NULL"""
# Season of a refreshed title, as the merge leaves it.
SEASON_AFTER = """COALESCE(p.season_named, CASE WHEN COALESCE(p.type, q.type) = 'TV' THEN COALESCE(p.season_aired, q.season) END)"""


def _answers(spark, sf, kind):
    answers = apply.detail_entries(landing.classify_fetch(_details(spark, sf, kind), kind), kind)
    return materialise(answers, "answers")


def _anime_answered(spark, sf):
    """Stored catalogue, titles to refresh and answers of the anime side."""
    cat = store_of(spark, catalogue(spark, sf)).catalogue()
    answers = _answers(spark, sf, "anime")
    return cat, answered(cat, "anime", answers, select_queue(cat, "anime_refresh", fv.REFRESH_LIMIT)), answers


def _committed(applied: apply.Applied, keep: str = "outcomes"):
    """Outcome rows, kept, and the store after the commit."""
    titles = materialise(applied.titles, keep)
    applied.catalogue.store.commit(applied.catalogue)
    return titles, applied.catalogue.store


def _refresh_sql(mark: str) -> str:
    """Outcome of each title; season and attempt of the row that is then stored."""
    return f"""SELECT q.anime_id AS item_id, {FETCHED} AS outcome, {FETCHED} = 'updated' AND q.season IS NULL AND {SEASON_AFTER} IS NOT NULL AS season_assigned,
CASE WHEN {FETCHED} = 'updated' THEN {SEASON_AFTER} WHEN {FETCHED} <> 'removed_adult' THEN q.season END AS season,
CASE WHEN {FETCHED} = 'updated' AND p.title IS NOT NULL THEN p.title WHEN {FETCHED} <> 'removed_adult' THEN q.title END AS title,
{FETCHED} <> 'removed_adult' AS {mark} FROM {{refresh_queue}} AS q LEFT JOIN {{pay}} AS p ON p.k = q.mal_id"""


def _refreshed(applied: apply.Applied, mark: str):
    titles, store = _committed(applied)
    rows = store.read("anime").select(
        F.col("anime_id").alias("item_id"), "season", "title", (F.col(mark) == now()).alias(mark)
    )
    out = titles.select("item_id", "outcome", "season_assigned").join(rows, "item_id", "left")
    return out.withColumn(mark, F.coalesce(mark, F.lit(False)))


@query("i16_anime_refresh", _refresh_sql("last_attempt"), refresh_queue=REFRESH_QUEUE, **V)
def _(spark, sf):
    return _refreshed(apply.apply_refresh(*_anime_answered(spark, sf), now()), "last_attempt")


@query("i18_season_backfill", _refresh_sql("last_season_attempt"), refresh_queue=REFRESH_QUEUE, **V)
def _(spark, sf):
    return _refreshed(apply.apply_season_backfill(*_anime_answered(spark, sf), now()), "last_season_attempt")


PRINTED = {
    "fetched": f"SELECT c_custkey AS mal_id, {PRINT_OUTCOME} AS outcome FROM {{customer}}",
    "outcomes": """SELECT q.mal_id, CASE f.outcome WHEN 'ok' THEN CASE WHEN q.mal_id % 31 = 0 OR q.mal_id % 59 = 0 THEN 'removed_adult' ELSE 'updated' END
WHEN 'unsupported_type' THEN 'removed_unsupported' ELSE f.outcome END AS outcome FROM {manga} AS q JOIN {fetched} AS f ON f.mal_id = q.mal_id""",
}


@query(
    "i17_print_refresh",
    "SELECT mal_id AS item_id, outcome, NOT starts_with(outcome, 'removed') AS attempted FROM {outcomes}",
    **PRINTED,
)
def _(spark, sf):
    cat = store_of(spark, catalogue(spark, sf)).catalogue()
    answers = _answers(spark, sf, "manga")
    chosen = answered(cat, "manga", answers, select_queue(cat, "print_refresh", fv.REFRESH_LIMIT))
    titles, store = _committed(apply.apply_print_refresh(cat, chosen, answers, now()))
    rows = store.read("manga").select(F.col("manga_id").alias("item_id"), (F.col("last_attempt") == now()).alias("attempted"))
    out = titles.select("item_id", "outcome").join(rows, "item_id", "left")
    return out.withColumn("attempted", F.coalesce("attempted", F.lit(False)))


# Links of an updated title as its answer leaves them: a list replaces the links it is
# complete for, a list with a bad entry only adds, no list leaves them alone.
LINKED = """SELECT COALESCE(c.anime_id, i.k) AS anime_id, COALESCE(c.service_key, i.key) AS service_key, COALESCE(i.url, c.url) AS url,
i.k IS NULL AND c.anime_id % 5 IN (2, 3) AS gone, i.url IS DISTINCT FROM c.url AND (i.k IS NOT NULL OR c.anime_id % 5 IN (2, 3)) AS moved
FROM (SELECT l.* FROM {anime_streaming_service} AS l JOIN {streamed} AS s ON s.item_id = l.anime_id AND s.fetched = 'updated') AS c
FULL JOIN (SELECT v.* FROM {services} AS v JOIN {streamed} AS s ON s.item_id = v.k AND s.fetched = 'updated') AS i ON i.k = c.anime_id AND i.key = c.service_key"""
STREAMED = {
    "refresh_queue": REFRESH_QUEUE,
    "streamed": f"SELECT q.anime_id AS item_id, q.mal_id, {FETCHED} AS fetched FROM {{refresh_queue}} AS q",
    "services": SERVICES,
    "linked": LINKED,
}


@query(
    "i19_streaming_backfill",
    """SELECT s.item_id, CASE WHEN s.fetched = 'updated' AND NOT EXISTS (SELECT 1 FROM {linked} AS l WHERE l.anime_id = s.item_id AND l.moved) THEN 'checked' ELSE s.fetched END AS outcome,
CASE WHEN s.fetched = 'updated' THEN CASE s.mal_id % 5 WHEN 0 THEN 'missing' WHEN 2 THEN 'empty' ELSE 'given' END END AS payload FROM {streamed} AS s""",
    **STREAMED,
)
def _(spark, sf):
    titles, _ = _committed(apply.apply_streaming_backfill(*_anime_answered(spark, sf), now()))
    return titles.select("item_id", "outcome", "payload")


@query(
    "i19_stored_links",
    """SELECT anime_id, service_key, url FROM {linked} WHERE NOT gone
UNION ALL SELECT anime_id, service_key, url FROM {anime_streaming_service} WHERE anime_id NOT IN (SELECT item_id FROM {streamed} WHERE fetched IN ('updated', 'removed_adult'))""",
    **STREAMED,
)
def _(spark, sf):
    _, store = _committed(apply.apply_streaming_backfill(*_anime_answered(spark, sf), now()))
    return store.read("anime_streaming_service").select("anime_id", "service_key", "url")


# --- J1, J2, I20 ----------------------------------------------------------------------

MOVIE_SCAN = TYPE_SCAN.format("movie")
MYSTERY_SCAN = "mystery:1"
ARRIVED = "SELECT * FROM {pay} WHERE mal_id IS NOT NULL AND page % 11 NOT IN (1, 2, 4, 7, 8, 9, 10)"
MOVIES = "SELECT * FROM {arrived} WHERE NOT is_adult AND k % 8 IN (0, 1, 4, 6)"
INGESTED = """SELECT COALESCE(a.anime_id, -p.k) AS anime_id, COALESCE(p.title, a.title, 'MAL anime ' || p.k) AS title,
CASE WHEN p.k IS NULL THEN a.type ELSE 'MOVIE' END AS type, CASE WHEN p.k IS NULL THEN a.season ELSE p.season_named END AS season
FROM (SELECT * FROM {anime} AS a WHERE NOT EXISTS (SELECT 1 FROM {arrived} AS r WHERE r.is_adult AND r.mal_id = a.mal_id)) AS a
FULL JOIN {movies} AS p ON p.mal_id = a.mal_id"""
# Some days later the largest page that answered 503 is gone, page 1 is fine, and the scan
# ends in its middle: what lay behind either end is closed, what lay before stays open.
REFUSED = """SELECT page, CASE page % 11 WHEN 7 THEN 'data is not a list' WHEN 9 THEN 'not an object' WHEN 10 THEN 'HTTP 503' ELSE 'invalid pagination' END AS reason
FROM (SELECT DISTINCT page, max(page) OVER () // 2 + 1 AS last FROM {pay}) WHERE page % 11 IN (1, 2, 4, 7, 9, 10) AND page > 1 AND page < last"""
PAGES_FAILED = """SELECT count(*) FILTER (WHERE page % 11 IN (1, 2, 4, 7, 9, 10)) + CAST(max(page) >= 10 AS INT) AS failed,
count(*) FILTER (WHERE page % 11 NOT IN (1, 2, 4, 7, 9, 10)) + 2 AS done FROM (SELECT DISTINCT page FROM {pay})"""
# The first page that is still open is asked for again, whatever came after it.
CURSOR = """SELECT CAST(COALESCE((SELECT min(page) FROM {refused}), 1) AS INT) AS next_page"""
STATE = """SELECT (SELECT next_page FROM {cursor}) AS next_page, (SELECT min_by(reason, page) FROM {refused}) AS last_error,
CAST(count(*) FILTER (WHERE page % 11 = 6) + CAST(max(page) >= 10 AS INT) + 1 AS BIGINT) AS cycle, CAST(max(page) // 2 + 2 AS INT) AS closed_from,
CASE WHEN (SELECT count(*) FROM {refused}) = 0 THEN '2024-05-04' END AS completed FROM (SELECT DISTINCT page FROM {pay})"""
J = {**V, "arrived": ARRIVED, "movies": MOVIES, "ingested": INGESTED, "refused": REFUSED, "cursor": CURSOR}


def land_pages(spark, sf, root):
    """Pages of one scan, some under a key that no scan has, and what the provider says later on."""
    pages = materialise(payloads.landed(payloads.anime_bodies(spark, sf), MOVIE_SCAN), "landed")
    odd = pages.filter("page % 11 = 0").withColumn("scan_key", F.lit(MYSTERY_SCAN))
    top = pages.agg(F.max("page")).first()[0]
    empty = '{{"data":[],"pagination":{{"has_next_page":{}}}}}'
    later = [(1, 200, "2024-05-03", empty.format("true")), (top // 2 + 1, 200, "2024-05-04", empty.format("false"))]
    if top >= 10:
        later.append((top - (top - 10) % 11, 404, "2024-05-02", None))
    later = spark.createDataFrame(later, "page int, status_code int, fetched_at string, body string").select(
        F.lit(MOVIE_SCAN).alias("scan_key"), "page", "status_code", F.col("fetched_at").cast("timestamp"), "body"
    )
    pages.unionByName(odd).unionByName(later).write.parquet(root + "/pages")


def _ingested(spark, sf) -> Store:
    root = folder(spark)
    land_pages(spark, sf, root)
    store = store_of(spark, catalogue(spark, sf))
    ingest_pages_stream(spark, root + "/pages", store, root + "/checkpoint").awaitTermination()
    return store


@query("j1_page_stream", "SELECT i.*, c.next_page FROM {ingested} AS i, {cursor} AS c", **J)
def _(spark, sf):
    store = _ingested(spark, sf)
    cursor = store.find("sync_state", [MOVIE_SCAN]).select("next_page").scalar()
    rows = store.read("anime").select("anime_id", "title", "type", "season")
    return rows.withColumn("next_page", cursor)


@query("j1_scan_state", STATE, **J)
def _(spark, sf):
    state = _ingested(spark, sf).find("sync_state", [MOVIE_SCAN])
    completed = F.date_format("last_completed_at", "yyyy-MM-dd").alias("completed")
    return state.select("next_page", "last_error", "cycle", "closed_from", completed)


@query(
    "j1_refused_pages",
    f"""SELECT '{MOVIE_SCAN}' AS scan_key, page, reason FROM {{refused}}
UNION ALL SELECT DISTINCT '{MYSTERY_SCAN}', page, '{UNKNOWN_SCAN}' FROM {{pay}} WHERE page % 11 = 0""",
    **J,
)
def _(spark, sf):
    return _ingested(spark, sf).read("refused_pages").select("scan_key", "page", "reason")


# The scheduled run on the sample: restricted titles go first, then one page scan
# and the details of every title, for each of the four queues, are applied.
RUN = {
    **V,
    "base_anime": VIEWS["anime"],
    "anime": "SELECT * FROM {base_anime} WHERE NOT is_adult AND anime_id % 37 <> 0",
    "base_manga": VIEWS["manga"],
    "manga": "SELECT * FROM {base_manga} WHERE NOT is_adult AND manga_id % 41 <> 0",
    "arrived": ARRIVED,
    "movies": MOVIES,
    "scanned": """SELECT 'inserted' AS outcome, k FROM {movies} WHERE mal_id NOT IN (SELECT mal_id FROM {anime} WHERE mal_id IS NOT NULL)
UNION ALL SELECT 'updated', k FROM {movies} WHERE mal_id IN (SELECT mal_id FROM {anime})
UNION ALL SELECT 'removed', k FROM {arrived} WHERE is_adult AND mal_id IN (SELECT mal_id FROM {anime})""",
    "stored": """SELECT COALESCE(a.anime_id, -p.k) AS anime_id, COALESCE(a.mal_id, p.k) AS mal_id, a.last_attempt
FROM (SELECT * FROM {anime} AS a WHERE NOT EXISTS (SELECT 1 FROM {arrived} AS r WHERE r.is_adult AND r.mal_id = a.mal_id)) AS a
FULL JOIN {movies} AS p ON p.mal_id = a.mal_id""",
    "refreshed": f"SELECT q.anime_id, q.mal_id, q.last_attempt, {FETCHED} AS outcome FROM {{stored}} AS q",
    "left_over": "SELECT * FROM {refreshed} WHERE outcome <> 'removed_adult'",
    "waiting": """SELECT * FROM {left_over} ORDER BY CASE WHEN mal_id IS NULL THEN last_attempt ELSE TIMESTAMP '2024-06-01' END ASC NULLS FIRST, anime_id LIMIT 1000""",
    **PRINTED,
    "outcomes": """SELECT 'season_backfill' AS queue, outcome FROM {refreshed} WHERE mal_id IS NOT NULL
UNION ALL SELECT 'anime_refresh', outcome FROM {left_over} WHERE mal_id IS NOT NULL
UNION ALL SELECT 'anime_refresh', outcome FROM {waiting} WHERE mal_id IS NULL
UNION ALL SELECT 'streaming_backfill', CASE outcome WHEN 'updated' THEN 'checked' ELSE outcome END FROM {left_over} WHERE mal_id IS NOT NULL
UNION ALL SELECT 'print_refresh', outcome FROM {print_outcomes}""",
    "print_outcomes": PRINTED["outcomes"],
}


def _scheduled(spark, sf):
    """The report of one whole run on a new store."""
    root = folder(spark)
    land_pages(spark, sf, root)
    anime, printed = _details(spark, sf, "anime"), _details(spark, sf, "manga")
    kinds = F.explode(F.array(*[F.lit(q) for q in ("season_backfill", "anime_refresh", "streaming_backfill")]))
    details = anime.withColumn("kind", kinds).unionByName(printed.withColumn("kind", F.lit("print_refresh")))
    details.write.parquet(root + "/details")
    store = store_of(spark, catalogue(spark, sf))
    return run_scheduled(spark, store, root + "/pages", root + "/checkpoint", root + "/details", now())


@query("i20_scheduled_run", HEALTH_SQL, **RUN)
def _(spark, sf):
    return _scheduled(spark, sf).health


@query(
    "i20_scan_summary",
    f"""SELECT provider_type, CAST(sum(done) AS BIGINT) AS pages_completed, CAST(sum(failed) AS BIGINT) AS pages_failed, CAST(sum(inserted) AS BIGINT) AS inserted,
CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(removed) AS BIGINT) AS removed FROM (
SELECT 'movie' AS provider_type, 0 AS done, 0 AS failed, CAST(outcome = 'inserted' AS INT) AS inserted, CAST(outcome = 'updated' AS INT) AS updated, CAST(outcome = 'removed' AS INT) AS removed FROM {{scanned}}
UNION ALL SELECT 'movie', done, failed, 0, 0, 0 FROM {{pages_failed}}
UNION ALL SELECT '{UNKNOWN_SCAN}', 0, 1, 0, 0, 0 FROM (SELECT DISTINCT page FROM {{pay}}) WHERE page % 11 = 0) GROUP BY GROUPING SETS ((provider_type), ())""",
    pages_failed=PAGES_FAILED,
    **RUN,
)
def _(spark, sf):
    return _scheduled(spark, sf).scans


@query(
    "i20_removed",
    """SELECT (SELECT count(*) FROM {base_anime}) - (SELECT count(*) FROM {anime}) + (SELECT count(*) FROM {scanned} WHERE outcome = 'removed')
+ (SELECT count(*) FROM {refreshed} WHERE outcome = 'removed_adult') AS removed_anime,
(SELECT count(*) FROM {base_manga}) - (SELECT count(*) FROM {manga}) + (SELECT count(*) FROM {print_outcomes} WHERE outcome = 'removed_adult') AS removed_print""",
    **RUN,
)
def _(spark, sf):
    report = _scheduled(spark, sf)
    counts = [(report.removed_anime, report.removed_print)]
    return spark.createDataFrame(counts, "removed_anime bigint, removed_print bigint")


def event_visits(spark, sf):
    """The event file as a stream of visits."""
    events = spark.readStream.schema(SOURCES["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    return events.select(
        F.sha2(F.col("user_id").cast("string"), 256).alias("visitor_token_hash"),
        F.to_date("ts").alias("visit_date"),
        F.col("event_type").alias("route"),
        "ts",
    )


VISITS = """SELECT visitor_token_hash, CAST(visit_date AS VARCHAR) AS visit_date, route, visit_count FROM {site_visit}"""


@query("j2_visit_stream", VISITS)
def _(spark, sf):
    root = folder(spark)
    store = Store(spark, root + "/store")
    visit_stream(event_visits(spark, sf), store, root + "/checkpoint").awaitTermination()
    return stored_visits(store).select(
        "visitor_token_hash", F.col("visit_date").cast("string"), "route", "visit_count"
    )


@query("j2_visit_windows", VISITS)
def _(spark, sf):
    root = folder(spark)
    rows = visit_windows(event_visits(spark, sf)).select(
        "visitor_token_hash", F.col("visit_date").cast("string").alias("visit_date"), "route", "visit_count"
    )

    def replace_all(batch, batch_id):
        batch.write.mode("overwrite").parquet(root + "/days")

    sink = rows.writeStream.outputMode("complete").foreachBatch(replace_all)
    sink.option("checkpointLocation", root + "/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(root + "/days")


REPORT_SQL = """SELECT 'total' AS section, NULL AS label, CAST(sum(visit_count) AS BIGINT) AS visits, count(DISTINCT visitor_token_hash) AS unique_visitors FROM {site_visit}
UNION ALL SELECT 'daily', CAST(visit_date AS VARCHAR), CAST(sum(visit_count) AS BIGINT), count(DISTINCT visitor_token_hash) FROM {site_visit} WHERE visit_date >= DATE '2024-01-24' GROUP BY visit_date
UNION ALL SELECT 'weekly', CAST(CAST(date_trunc('week', visit_date) AS DATE) AS VARCHAR), CAST(sum(visit_count) AS BIGINT), count(DISTINCT visitor_token_hash) FROM {site_visit} GROUP BY 2
UNION ALL SELECT 'monthly', CAST(CAST(date_trunc('month', visit_date) AS DATE) AS VARCHAR), CAST(sum(visit_count) AS BIGINT), count(DISTINCT visitor_token_hash) FROM {site_visit} GROUP BY 2
UNION ALL SELECT 'categories', route, CAST(sum(visit_count) AS BIGINT), count(DISTINCT visitor_token_hash) FROM {site_visit} GROUP BY route"""


@query("e6_e7_visit_report", REPORT_SQL)
def _(spark, sf):
    return visits.report(view(spark, sf, "site_visit"), date(2024, 1, 30))


@query("e6_e7_stored_report", REPORT_SQL)
def _(spark, sf):
    # Three batches: most visitors and days are in each of them.
    store, rows = Store(spark, folder(spark) + "/store"), view(spark, sf, "site_visit")
    part = F.pmod(F.xxhash64("visitor_token_hash", "visit_date", "route"), F.lit(3))
    for batch in range(3):
        visitors.add_visits(store, rows.filter(part == batch), "visitors", batch)
    return visitors.report(visitors.stored_bitmaps(store), date(2024, 1, 30))


@query(
    "j2_visitor_stream",
    f"""SELECT visit_date, route, CAST(sum(visit_count) AS BIGINT) AS visits, count(DISTINCT visitor_token_hash) AS unique_visitors
FROM ({VISITS}) GROUP BY visit_date, route""",
)
def _(spark, sf):
    root = folder(spark)
    store = Store(spark, root + "/store")
    visitor_stream(event_visits(spark, sf), store, root + "/checkpoint").awaitTermination()
    rows = visitors.counted(visitors.stored_bitmaps(store), F.col("visit_date").cast("string"), "route")
    return rows.withColumnsRenamed({"_k0": "visit_date", "_k1": "route"})
