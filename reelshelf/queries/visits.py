"""Visit analytics and run statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from reelshelf.functions.text import token_hash
from reelshelf.operators import health, visits
from reelshelf.queries.registry import query
from reelshelf.sources.bindings import source, view

TODAY = date(2024, 1, 30)

# An access log drawn from the event stream; each rule has rows that break it.
LOG_SQL = """SELECT event_id, ts,
  CASE WHEN event_id % 7 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CAST(CASE event_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 302 WHEN 2 THEN 500 ELSE 200 END AS INT) AS status,
  CASE WHEN event_id % 13 = 0 THEN 'application/json' ELSE 'text/html' END AS mime_type,
  CASE event_id % 17 WHEN 0 THEN '/health' WHEN 1 THEN '/api/v1/anime' WHEN 2 THEN '/assets/a.js' WHEN 3 THEN '/healthy' ELSE '/anime/5' END AS path,
  CASE event_id % 5 WHEN 0 THEN 'curl/8' WHEN 1 THEN 'Mozilla/5.0 Googlebot' WHEN 2 THEN NULL ELSE 'Mozilla/5.0 (X11)' END AS user_agent,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'application/json' ELSE 'TEXT/HTML,*/*' END AS accept,
  CASE user_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN repeat('a b', 20) WHEN 3 THEN repeat('x', 129)
    ELSE repeat('tok_', 8) || CAST(user_id AS VARCHAR(20)) END AS visitor_token,
  CAST(user_id AS VARCHAR(20)) AS user_text, user_id
FROM {events}"""

TRACKABLE = """method = 'GET' AND status BETWEEN 200 AND 399 AND mime_type = 'text/html' AND path <> '/health'
AND NOT starts_with(path, '/api/v1') AND NOT starts_with(path, '/assets/') AND user_agent = 'Mozilla/5.0 (X11)' AND (accept IS NULL OR accept LIKE 'TEXT/HTML%')"""


def access_log(spark, sf):
    return spark.sql(LOG_SQL, events=source(spark, sf, "events"))


@query("c13_trackable_visits", f"SELECT event_id, path FROM {{log}} WHERE {TRACKABLE}", log=LOG_SQL)
def _(spark, sf):
    return visits.trackable(access_log(spark, sf)).select("event_id", "path")


@query(
    "c14_valid_token",
    "SELECT event_id, COALESCE(regexp_full_match(visitor_token, '[A-Za-z0-9_-]{32,128}'), FALSE) AS valid FROM {log}",
    log=LOG_SQL,
)
def _(spark, sf):
    return access_log(spark, sf).select("event_id", visits.valid_token(F.col("visitor_token")).alias("valid"))


@query("h20_token_hash", "SELECT event_id, {sha256}(CAST(user_id AS VARCHAR)) AS digest FROM {events}")
def _(spark, sf):
    return source(spark, sf, "events").select(
        "event_id", token_hash(F.col("user_id").cast("string")).alias("digest")
    )


@query(
    "a9_visit_upsert",
    f"""SELECT visitor_token_hash, CAST(visit_date AS VARCHAR) AS visit_date, route, CAST(sum(n) AS BIGINT) AS visit_count,
strftime(min(a), '%Y-%m-%d %H:%M:%S') AS first_visited_at, strftime(max(b), '%Y-%m-%d %H:%M:%S') AS last_visited_at FROM (
SELECT visitor_token_hash, visit_date, route, visit_count AS n, first_visited_at AS a, last_visited_at AS b FROM {{site_visit}}
UNION ALL SELECT sha256(CASE WHEN regexp_full_match(visitor_token, '[A-Za-z0-9_-]{{32,128}}') THEN visitor_token ELSE 'new-' || user_text END),
CAST(ts AS DATE), 'frontend', 1, ts, ts FROM {{log}} WHERE {TRACKABLE}) GROUP BY ALL""",
    log=LOG_SQL,
)
def _(spark, sf):
    # A replacement token that both engines can compute.
    fresh = F.concat(F.lit("new-"), F.col("user_text"))
    batch = visits.daily(visits.visits_of(access_log(spark, sf), fresh))
    out = visits.upsert_visits(view(spark, sf, "site_visit"), batch)
    return out.select(
        "visitor_token_hash",
        F.col("visit_date").cast("string"),
        "route",
        "visit_count",
        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_visited_at", "last_visited_at")],
    )


MEASURES = "CAST(COALESCE(sum(visit_count), 0) AS BIGINT) AS visits, count(DISTINCT visitor_token_hash) AS unique_visitors"


@query("e6_visit_totals", f"SELECT {MEASURES} FROM {{site_visit}}")
def _(spark, sf):
    return visits.visit_totals(view(spark, sf, "site_visit"))


@query("e6_visit_categories", f"SELECT route AS category, {MEASURES} FROM {{site_visit}} GROUP BY route")
def _(spark, sf):
    return visits.visit_categories(view(spark, sf, "site_visit"))


def _period_query(period: str, days: int) -> None:
    @query(
        f"e7_visits_by_{period}",
        f"""SELECT CAST(CAST(date_trunc('{period}', visit_date) AS DATE) AS VARCHAR) AS period, {MEASURES} FROM {{site_visit}}
WHERE visit_date >= DATE '2024-01-30' - {days} GROUP BY 1""",
    )
    def _(spark, sf):
        return visits.visits_by(view(spark, sf, "site_visit"), period, TODAY)


for _period, _days in (("day", 6), ("week", 77), ("month", 366)):
    _period_query(_period, _days)


# --- E9-E11, A8: logs drawn from orders and lines ----------------------------

CHANGES_SQL = """SELECT CASE l_linestatus WHEN 'O' THEN 'bulk' ELSE 'refresh' END AS phase,
  CASE l_returnflag WHEN 'A' THEN 'studio' WHEN 'R' THEN 'streaming_service' ELSE 'author' END AS entity,
  l_partkey AS item_id, l_orderkey % 3 AS created, l_orderkey % 2 AS removed, CAST(l_linenumber % 2 AS BIGINT) AS changed,
  CASE WHEN l_orderkey % 7 = 0 THEN l_partkey % 3 ELSE 0 END AS malformed FROM {lineitem}"""


@query(
    "e9_reconcile_stats",
    """SELECT entity, phase, count(*) AS processed, count(*) FILTER (WHERE created + removed + changed > 0) AS titles_updated,
CAST(sum(created) AS BIGINT) AS created, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(changed) AS BIGINT) AS changed,
CAST(sum(malformed) AS BIGINT) AS malformed, count(*) FILTER (WHERE malformed > 0) AS failures
FROM {changes} GROUP BY GROUPING SETS ((entity, phase), (entity))""",
    changes=CHANGES_SQL,
)
def _(spark, sf):
    return health.reconcile_stats(spark.sql(CHANGES_SQL, lineitem=source(spark, sf, "lineitem")))


OUTCOMES_SQL = """SELECT CASE o_orderstatus WHEN 'F' THEN 'season_backfill' WHEN 'O' THEN 'anime_refresh' ELSE 'print_refresh' END AS queue,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 < 8 THEN 'temporary' WHEN o_orderkey % 10 < 4 THEN 'updated' WHEN o_orderkey % 10 = 4 THEN 'removed_adult'
    WHEN o_orderkey % 10 = 5 THEN 'not_found' WHEN o_orderkey % 10 = 6 THEN 'invalid_payload' WHEN o_orderkey % 10 = 7 THEN 'removed_unsupported' WHEN o_orderkey % 10 = 8 THEN 'unexpected' ELSE 'missing_mal_id' END AS outcome
FROM {orders}"""


HEALTH_SQL = """SELECT *, (updated + removed_adult + removed_unsupported) / selected AS success_rate,
selected >= 100 AND (updated + removed_adult + removed_unsupported) / selected < 0.25 AS degraded FROM (SELECT queue, count(*) AS selected,
count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'removed_adult') AS removed_adult,
count(*) FILTER (WHERE outcome = 'removed_unsupported') AS removed_unsupported, count(*) FILTER (WHERE outcome = 'missing_mal_id') AS missing_mal_id,
count(*) FILTER (WHERE outcome = 'not_found') AS not_found, count(*) FILTER (WHERE outcome = 'temporary') AS temporary,
count(*) FILTER (WHERE outcome = 'invalid_payload') AS invalid_payload, count(*) FILTER (WHERE outcome = 'unexpected') AS unexpected FROM {outcomes} GROUP BY queue)"""


@query(
    "e10_refresh_health",
    HEALTH_SQL,
    outcomes=OUTCOMES_SQL,
)
def _(spark, sf):
    return health.refresh_health(spark.sql(OUTCOMES_SQL, orders=source(spark, sf, "orders")))


SCANS_SQL = """SELECT lower(c_mktsegment) AS provider_type, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 END AS pages_completed,
  CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS pages_failed, c_custkey % 5 AS inserted, c_custkey % 50 AS updated, c_custkey % 2 AS removed FROM {customer}"""


@query(
    "e11_scan_summary",
    """SELECT provider_type, CAST(sum(pages_completed) AS BIGINT) AS pages_completed, CAST(sum(pages_failed) AS BIGINT) AS pages_failed,
CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(updated) AS BIGINT) AS updated, CAST(sum(removed) AS BIGINT) AS removed
FROM {scans} GROUP BY GROUPING SETS ((provider_type), ())""",
    scans=SCANS_SQL,
)
def _(spark, sf):
    return health.scan_summary(spark.sql(SCANS_SQL, customer=source(spark, sf, "customer")))


STATE_SQL = """SELECT 'scan ' || CAST(s_suppkey AS VARCHAR(20)) AS key, CAST(1 + s_suppkey % 40 AS INT) AS next_page,
  TIMESTAMP '2020-01-01 00:00:00' AS last_attempt_at, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2019-01-01 00:00:00' END AS last_completed_at,
  CASE WHEN s_suppkey % 3 = 0 THEN 'old' END AS last_error, CAST(s_suppkey % 4 AS BIGINT) AS cycle,
  CASE WHEN s_suppkey % 4 > 0 THEN TIMESTAMP '1996-06-01 00:00:00' END AS closed_at, CASE WHEN s_suppkey % 4 > 0 THEN CAST(20 + s_suppkey % 30 AS INT) END AS closed_from FROM {supplier}"""
# One response for each order: some are refused, some pages have vanished (which is
# reported as page 1), some are the last of their scan.
RESULTS_SQL = """SELECT scan_key, CASE WHEN gone THEN 1 ELSE asked END AS page, more, more AS has_next_page, seen_at, CASE WHEN gone THEN 'HTTP 404' ELSE error END AS error,
  CASE WHEN gone THEN asked WHEN error IS NULL AND NOT more THEN asked + 1 END AS closes FROM (
SELECT 'scan ' || CAST(o_custkey % {scans} AS VARCHAR(20)) AS scan_key, CAST(o_orderkey % 40 AS INT) AS asked, o_orderkey % 5 <> 0 AS more,
  o_orderkey % 40 > 1 AND o_orderkey % 17 = 0 AS gone, CAST(o_orderdate AS TIMESTAMP) AS seen_at,
  CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 3 = 0 THEN repeat('e', 600) END AS error FROM {orders})"""
# Pages that earlier batches left refused, one for each customer: some land again in this batch.
OPEN_SQL = """SELECT 'scan ' || CAST(c_custkey % {scans} AS VARCHAR(20)) AS scan_key, CAST(c_custkey % 50 AS INT) AS page, 'earlier' AS reason,
  max(TIMESTAMP '1992-06-01 00:00:00' + INTERVAL 1 DAY * (c_custkey % 700)) AS seen_at FROM {customer} GROUP BY 1, 2"""
# Scans grow in number with the tables.
SCANS_OF_CUSTOMERS = "(SELECT 120 + count(*) DIV 50 FROM {customer})"
# The latest response of each page decides whether it is refused.
LATEST_SQL = """SELECT scan_key, page, max(CASE WHEN seen_at = top THEN error END) AS reason, max(seen_at) AS seen_at FROM (
  SELECT *, max(seen_at) OVER (PARTITION BY scan_key, page) AS top FROM (SELECT scan_key, page, error, seen_at FROM {results}
  UNION ALL SELECT scan_key, page, reason, seen_at FROM {open_pages})) GROUP BY scan_key, page"""
# A later end of the scan closes the pages it did not have.
REFUSED_SQL = """SELECT * FROM {latest} AS l WHERE reason IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (
  SELECT scan_key, seen_at, min(closes) AS closes FROM {results} WHERE closes IS NOT NULL GROUP BY scan_key, seen_at
  UNION ALL SELECT key, closed_at, closed_from FROM {state} WHERE closed_from IS NOT NULL) AS e
  WHERE e.scan_key = l.scan_key AND e.closes <= l.page AND e.seen_at > l.seen_at)"""
A8 = {
    "results": RESULTS_SQL.replace("{scans}", SCANS_OF_CUSTOMERS.replace("DIV", "//")),
    "open_pages": OPEN_SQL.replace("{scans}", SCANS_OF_CUSTOMERS.replace("DIV", "//")),
    "latest": LATEST_SQL,
    "state": STATE_SQL,
    "refused": REFUSED_SQL,
}


def _refused(spark, sf):
    tables = {t: source(spark, sf, t) for t in ("orders", "customer", "supplier")}
    scans = tables["customer"].select(F.lit(120) + F.expr("count(*) DIV 50")).first()[0]
    results = spark.sql(RESULTS_SQL.replace("{scans}", str(scans)), orders=tables["orders"])
    earlier = spark.sql(OPEN_SQL.replace("{scans}", str(scans)), customer=tables["customer"])
    state = spark.sql(STATE_SQL, supplier=tables["supplier"])
    return state, results, health.refused_pages(earlier, results, state)


@query(
    "a8_refused_pages",
    "SELECT scan_key, page, reason, strftime(seen_at, '%Y-%m-%d') AS seen_at FROM {refused}",
    **A8,
)
def _(spark, sf):
    _, _, refused = _refused(spark, sf)
    return refused.select("scan_key", "page", "reason", F.date_format("seen_at", "yyyy-MM-dd").alias("seen_at"))


@query(
    "a8_advance_state",
    """SELECT COALESCE(s.key, l.scan_key) AS key,
CASE WHEN l.scan_key IS NULL THEN s.next_page WHEN p.page IS NOT NULL THEN p.page WHEN l.has_next_page THEN l.page + 1 ELSE 1 END AS next_page,
strftime(COALESCE(l.seen_at, s.last_attempt_at), '%Y-%m-%d') AS last_attempt_at,
strftime(COALESCE(CASE WHEN p.page IS NULL THEN l.done END, s.last_completed_at), '%Y-%m-%d') AS last_completed_at,
CASE WHEN l.scan_key IS NULL THEN s.last_error ELSE left(p.reason, 500) END AS last_error,
COALESCE(s.cycle, 0) + COALESCE(e.ends, 0) AS cycle,
strftime(CASE WHEN s.closed_at IS NULL OR e.closed_at >= s.closed_at THEN e.closed_at ELSE s.closed_at END, '%Y-%m-%d') AS closed_at,
CAST(CASE WHEN s.closed_at IS NULL OR e.closed_at > s.closed_at THEN e.closed_from WHEN e.closed_at = s.closed_at THEN greatest(e.closed_from, s.closed_from) ELSE s.closed_from END AS INT) AS closed_from
FROM {state} AS s FULL JOIN (SELECT * FROM (SELECT *, max(CASE WHEN error IS NULL AND NOT has_next_page THEN seen_at END) OVER (PARTITION BY scan_key) AS done,
row_number() OVER (PARTITION BY scan_key ORDER BY seen_at DESC, page DESC, has_next_page DESC) AS rn FROM {results}) WHERE rn = 1) AS l ON l.scan_key = s.key
LEFT JOIN (SELECT scan_key, page, reason FROM {refused} AS r WHERE page = (SELECT min(page) FROM {refused} AS o WHERE o.scan_key = r.scan_key)) AS p ON p.scan_key = l.scan_key
LEFT JOIN (SELECT scan_key, count(*) AS ends, max(seen_at) AS closed_at, max(CASE WHEN seen_at = top THEN closes END) AS closed_from FROM (
  SELECT *, max(seen_at) OVER (PARTITION BY scan_key) AS top FROM {results} WHERE closes IS NOT NULL) GROUP BY scan_key) AS e ON e.scan_key = l.scan_key""",
    **A8,
)
def _(spark, sf):
    out = health.advance_state(*_refused(spark, sf))
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("last_attempt_at", "last_completed_at", "closed_at")]
    return out.select("key", "next_page", *days, "last_error", "cycle", "closed_from")
