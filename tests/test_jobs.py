"""Stored tables, streams and the scheduled run."""

from __future__ import annotations

import hashlib
import json
import re
import shutil
import uuid
from dataclasses import replace
from datetime import date

import pytest
from samples import SAMPLE
from pyspark.sql import functions as F

from reelshelf import CatalogueQuery
from reelshelf.functions.text import entity_key, entity_name, strip
from reelshelf.operators import ranking, visitors, visits
from reelshelf.plans.catalogue import Catalogue
from reelshelf.plans.scheduled import purge, run_scheduled
from reelshelf.schemas import schema
from reelshelf.session import broadcast_if_small, materialise, path_exists, scratch_dir
from reelshelf.sources.bindings import view
from reelshelf.sources.landing import landed_pages
from reelshelf.sources.store import Store, bucket_of
from reelshelf.streaming.pages import (
    SCANS,
    TV_SCAN,
    TYPE_SCAN,
    checked_pages,
    ingest_batch,
    ingest_pages_stream,
    page_results,
    scan_columns,
)
from reelshelf.streaming.visits import log_visit_stream, stored_visits


@pytest.fixture
def root(spark):
    return f"{scratch_dir(spark)}/test-{uuid.uuid4().hex}"


def land(spark, path, *pages):
    rows = [
        (key, number, body if isinstance(body, int) else 200, "2024-05-01 00:00:00", json.dumps(body))
        for key, number, body in pages
    ]
    columns = "scan_key string, page int, status_code int, fetched_at string, body string"
    df = spark.createDataFrame(rows, columns)
    df = df.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    df.write.mode("append").parquet(path)
    return df


def body(*objects, more=False):
    return {"data": list(objects), "pagination": {"has_next_page": more}}


def test_scan_keys(spark):
    keys = [TV_SCAN, TYPE_SCAN.format("tv_special"), TYPE_SCAN.format("manhwa"), "current:2024:spring", "current:2024:autumn", "upcoming:x:fall", "other", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
    found = rows.select("i", *[c.alias(n) for n, c in scan_columns(F.col("key")).items()]).orderBy("i").collect()
    scans = {s.order: s for s in SCANS}
    assert scans[found[0].scan].discover_missing is False
    assert (scans[found[1].scan].expected, scans[found[2].scan].expected) == ("SPECIAL", "MANHWA")
    assert (scans[found[3].scan].label, found[3].scan_year, found[3].scan_season) == ("current", 2024, "spring")
    assert [r.scan for r in found[4:]] == [None] * 4
    assert len(scans) == len(SCANS)


def test_raw_page_files_are_read_whole(spark, root):
    folder = f"{root}/raw/scan_key=bulk/page=3"
    text = json.dumps(body({"mal_id": 1}), indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    row = landed_pages(spark, root + "/raw", "text").first()
    assert (row.scan_key, row.page, json.loads(row.body)) == ("bulk", 3, json.loads(text))


def files_of(spark, path):
    return set(spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"])


def test_a_commit_rewrites_only_the_buckets_it_touches(spark, root):
    store = Store(spark, root, buckets=8)
    assert store.read("anime").count() == 0 and store.batch("x") == -1
    rows = spark.range(1, 101).select(F.col("id").alias("anime_id"), F.lit("old").alias("title"))
    rows = spark.createDataFrame([], schema("anime")).unionByName(rows, allowMissingColumns=True)
    store.write({"anime": rows})
    before = files_of(spark, root + "/anime")

    cat = store.catalogue().narrowed(spark.createDataFrame([(7,)], "anime_id bigint"), "anime")
    assert 0 < cat.anime.count() < 100
    new = cat.anime.withColumn("title", F.when(F.col("anime_id") == 7, "new").otherwise(F.col("title")))
    store.commit(replace(cat, anime=new))
    after = files_of(spark, root + "/anime")
    assert {r.title: r["count"] for r in store.read("anime").groupBy("title").count().collect()} == {"old": 99, "new": 1}
    replaced = before - after
    assert replaced and {f.split("bucket=")[1][0] for f in replaced} == {str(b) for b in store.buckets_of(spark.createDataFrame([(7,)], "id bigint"))}
    plan = store.find("anime", [7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(anime_id,7)" in plan

    # A bucket that loses its last row is empty afterwards; a catalogue that did not change writes nothing.
    store.commit(replace(cat, anime=cat.anime.limit(0)))
    assert store.read("anime").filter("anime_id = 7").count() == 0
    before = files_of(spark, root + "/anime")
    store.commit(store.catalogue())
    assert files_of(spark, root + "/anime") == before
    store.mark("x", 3)
    assert (store.batch("x"), store.batch("y")) == (3, -1)


def states(store):
    return {r.key: (r.next_page, r.last_error) for r in store.read("sync_state").collect()}


def test_page_stream_resumes_and_replays_once(spark, root):
    store = Store(spark, root + "/store")
    ova = TYPE_SCAN.format("ova")
    land(
        spark,
        root + "/pages",
        (ova, 1, body({"mal_id": 1, "title": "A"}, more=True)),
        (TV_SCAN, 1, body({"mal_id": 9, "title": "Unknown TV"})),
        (TYPE_SCAN.format("manga"), 1, body({"mal_id": 1, "title": "M"})),
        ("unknown", 1, body()),
    )
    run = lambda: ingest_pages_stream(spark, root + "/pages", store, root + "/check").awaitTermination()
    run()
    assert states(store) == {ova: (2, None), TV_SCAN: (1, None), TYPE_SCAN.format("manga"): (1, None)}
    assert [(r.anime_id, r.type) for r in store.read("anime").collect()] == [(-1, "OVA")]
    assert [r.manga_id for r in store.read("manga").collect()] == [1]
    assert [(r.scan_key, r.page) for r in store.read("refused_pages").collect()] == [("unknown", 1)]

    # A refused page stays current whatever comes after it, until it lands again.
    land(spark, root + "/pages", (ova, 2, {"data": None}), (ova, 3, body({"mal_id": 3, "title": "C"})))
    run()
    assert states(store)[ova] == (2, "data is not a list")
    assert store.read("anime").filter("mal_id = 3").count() == 1
    marked = store.batch("pages")
    run()
    assert store.batch("pages") == marked
    pages = land(spark, root + "/more", (ova, 2, body({"mal_id": 2, "title": "B"}, more=True)))
    ingest_batch(store, pages, marked)  # its mark is there already
    assert states(store)[ova][0] == 2
    ingest_batch(store, pages.withColumn("fetched_at", F.lit("2024-05-02").cast("timestamp")), 100)
    assert states(store)[ova] == (3, None)
    assert store.read("refused_pages").filter(F.col("scan_key") == ova).count() == 0
    assert {r.outcome for r in store.read_batches("scan_titles", ["pages-100"]).collect()} == {"inserted"}


def test_missing_pages_and_page_limits(spark, root):
    manga = TYPE_SCAN.format("manga")
    pages = land(spark, root, (TYPE_SCAN.format("ova"), 2, 404), (manga, 1000, body({}, more=True)))
    checked = checked_pages(pages)
    free = {r.scan_key: (r.page, r.error) for r in page_results(checked).collect()}
    assert free[TYPE_SCAN.format("ova")] == (1, "HTTP 404") and free[manga] == (1000, None)
    capped = {r.scan_key: (r.page, r.error) for r in page_results(checked, last_page=1000).collect()}
    assert capped[manga] == (1, "manga catalogue exceeds provider page limit 1000")


def test_no_scan_key_is_lost(spark, root):
    """More keys than any loop could hold: every season's page is applied and its cursor moved."""
    pages = spark.range(1200).select(
        F.concat(F.lit("current:"), F.col("id") + 1000, F.lit(":fall")).alias("scan_key"),
        F.lit(1).alias("page"),
        F.lit(200).alias("status_code"),
        F.lit("2024-05-01").cast("timestamp").alias("fetched_at"),
        F.concat(F.lit('{"data":[{"mal_id":'), F.col("id") + 1, F.lit(',"title":"T"}],"pagination":{"has_next_page":false}}')).alias("body"),
    )
    store = Store(spark, root)
    ingest_batch(store, pages, 0)
    assert store.read("sync_state").count() == 1200 and store.read("refused_pages").count() == 0
    anime = store.read("anime")
    assert anime.count() == 1200 and anime.filter("year = 1000 - anime_id - 1 AND season = 'fall'").count() == 1200


def test_log_stream_counts_each_visit_once(spark, root):
    token = "t" * 40
    log = spark.createDataFrame(
        [("GET", 200, "text/html", "/", "Mozilla/5.0", None, token, f"2024-01-0{d} 10:00:00") for d in (1, 1, 2)]
        + [("GET", 200, "text/html", "/", "Mozilla/5.0 bot", None, token, "2024-01-01 10:00:00")],
        "method string, status int, mime_type string, path string, user_agent string, accept string, visitor_token string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(root + "/log")
    store = Store(spark, root + "/store")
    for _ in range(2):
        log_visit_stream(spark, root + "/log", store, root + "/check").awaitTermination()
    # A batch that is written again replaces itself.
    store.write_batch("site_visit", store.read_batches("site_visit", ["visits-0"]), "visits-0", "visit_date")
    got = {str(r.visit_date): r.visit_count for r in stored_visits(store).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1}
    assert stored_visits(store).select("visitor_token_hash").distinct().count() == 1


def _visits(spark, *rows):
    return spark.createDataFrame([(t, d, r, n) for t, d, r, n in rows], "visitor_token_hash string, visit_date string, route string, visit_count long").withColumn(
        "visit_date", F.col("visit_date").cast("date")
    )


def test_stored_visitors_agree_with_the_plain_report_after_each_batch(spark, root):
    store, today = Store(spark, root, buckets=3), date(2024, 1, 10)
    batches = [
        [("a", "2024-01-09", "x", 2), ("b", "2024-01-09", "x", 1), (None, "2024-01-09", "x", 4)],
        [("a", "2024-01-09", "x", 1), ("a", "2023-12-31", "y", 1), ("c", "2024-01-01", None, 5), ("c", "2022-01-01", "y", 1)],
        [(f"v{i}", "2024-01-08", "y", 1) for i in range(40)] + [("b", "2024-01-08", "y", 1)],
        [],
    ]
    seen = []
    for i, batch in enumerate(batches):
        for _ in range(2):  # a batch that comes again is not counted again
            visitors.add_visits(store, _visits(spark, *batch), "visitors", i)
        seen += batch
        plain, bits = _visits(spark, *seen), visitors.stored_bitmaps(store)
        read = lambda df: sorted(map(tuple, df.collect()), key=str)
        assert read(visitors.report(bits, today)) == read(visits.report(plain, today))
        assert read(visitors.visitor_totals(bits)) == read(visits.visit_totals(plain))
        assert read(visitors.visitor_categories(bits)) == read(visits.visit_categories(plain))
        for period in ("day", "week", "month"):
            assert read(visitors.visitors_by(bits, period, today)) == read(visits.visits_by(plain, period, today))
    numbers = store.read("visitor_number").collect()
    assert len({r.visitor_token_hash for r in numbers}) == len({r.number for r in numbers}) == len(numbers) == 43
    with pytest.raises(ValueError, match="period"):
        visitors.visitors_by(bits, "year", today)


def test_visitors_survive_a_stop_between_plan_and_tables(spark, root, monkeypatch):
    store, rows = Store(spark, root), _visits(spark, ("a", "2024-01-09", "x", 2), ("b", "2024-01-09", "x", 1))
    written = []

    def stop(change):
        written.append(change.table)
        if len(written) == 2:
            raise RuntimeError("stopped")
        Store._overwrite(store, change)

    monkeypatch.setattr(store, "_overwrite", stop)
    with pytest.raises(RuntimeError, match="stopped"):
        visitors.add_visits(store, rows, "visitors", 0)
    again = Store(spark, root)
    visitors.add_visits(again, rows, "visitors", 0)
    assert tuple(visitors.visitor_totals(visitors.stored_bitmaps(again)).first()) == (3, 2)
    assert sorted(r.visitor_token_hash for r in again.read("visitor_number").collect()) == ["a", "b"]


def test_a_report_of_some_days_reads_only_their_bitmaps(spark, root):
    store = Store(spark, root)
    visitors.add_visits(store, _visits(spark, ("a", "2024-01-09", "x", 2), ("b", "2023-01-09", "x", 1)), "visitors", 0)
    rows = visitors.visitors_by(visitors.stored_bitmaps(store), "day", date(2024, 1, 10))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*visit_date", plan) and "visitor_token_hash" not in plan
    assert [tuple(r) for r in rows.collect()] == [("2024-01-09", 2, 1)]


def test_an_invalid_token_is_a_new_visitor(spark):
    rows = spark.createDataFrame([("a" * 31,), ("a" * 32,), ("ü" * 40,), ("a b" * 20,), ("a" * 32 + "\n",), (None,)], "t string")
    assert [r[0] for r in rows.select(visits.valid_token(F.col("t"))).collect()] == [False, True, True, False, False, False]


def test_visit_upsert_is_associative(spark):
    rows = view(spark, SAMPLE, "site_visit")
    half = F.xxhash64("visitor_token_hash", "visit_date", "route") % 2 == 0
    both = visits.upsert_visits(rows.filter(half), rows.filter(~half))
    assert both.select(*rows.columns).exceptAll(rows).count() == 0
    twice = visits.upsert_visits(rows, rows).agg(F.sum("visit_count")).first()[0]
    assert twice == 2 * rows.agg(F.sum("visit_count")).first()[0]


def test_scheduled_run(spark, root, cat):
    store = Store(spark, root + "/store")
    store.load({t: getattr(cat, t) for t in cat.tables()})
    flagged = cat.anime.filter("is_adult").count() + cat.manga.filter("is_adult").count()
    land(spark, root + "/pages", (TYPE_SCAN.format("ova"), 1, body({"mal_id": 100_001, "title": "Fresh OVA"})))
    details = [
        ("anime_refresh", 1, 200, json.dumps({"data": {"mal_id": 1, "title": "Refreshed"}})),
        ("anime_refresh", 2, 200, json.dumps({"data": {"mal_id": 2, "rating": "Rx - Hentai"}})),
        ("print_refresh", 1, 404, None),
    ]
    landed = spark.createDataFrame(details, "kind string, mal_id bigint, status_code int, body string")
    landed = landed.withColumn("fetched_at", F.lit("2024-06-01").cast("timestamp"))
    landed.select(*schema("landed_details").names).write.parquet(root + "/details")

    now = F.lit("2024-06-01").cast("timestamp")
    report = run_scheduled(spark, store, root + "/pages", root + "/check", root + "/details", now)
    anime = store.read("anime")
    assert anime.filter("is_adult").count() == 0 and report.removed_anime + report.removed_print > flagged
    assert anime.filter("mal_id = 1").first().title == "Refreshed"
    assert anime.filter("mal_id = 2").count() == 0
    assert anime.filter("mal_id = 100001").first().type == "OVA"
    health = {r.queue: r for r in report.health.collect()}
    assert (health["anime_refresh"].updated, health["anime_refresh"].removed_adult) == (1, 1)
    assert health["print_refresh"].not_found == health["print_refresh"].selected == 1
    scans = {r.provider_type: (r.pages_completed, r.inserted) for r in report.scans.collect()}
    assert scans == {"ova": (1, 1), None: (1, 1)}
    asked = {r.queue: r["count"] for r in report.requests.groupBy("queue").count().collect()}
    assert asked["print_refresh"] == min(1000, store.read("manga").filter("mal_id > 0").count())
    assert report.facets == store.read("catalogue_facet").count() > 0
    assert report.season_coverage.first().total_tv == anime.filter("upper(type) = 'TV'").count()
    assert report.metric_coverage.count() == 3


def test_helpers(spark):
    rows = spark.range(10)
    assert materialise(rows).count() == 10
    assert "broadcast" in broadcast_if_small(rows, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in broadcast_if_small(rows, 9)._jdf.queryExecution().analyzed().toString().lower()


def plan_nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_names_fold_like_unicode_says(spark):
    raw = [" Ａ  b　", "straße", "\x1c", "x" * 151, "ﬁlm"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    c = F.col("raw")
    rows = rows.select("i", strip(c).alias("s"), entity_name(c).alias("name"), entity_key(c).alias("key"))
    assert plan_nodes(rows, "ArrowEvalPython") == 1
    out = rows.orderBy("i").collect()
    assert [r.name for r in out] == ["A b", "straße", None, None, "film"]
    assert [r.key for r in out] == ["a b", "strasse", None, None, "film"]
    assert out[0].s == "Ａ  b" and out[2].s == ""


def test_a_vanished_page_ends_its_scan(spark, root):
    """A refused page that is then gone is forgotten; the scan starts over and completes."""
    ova = TYPE_SCAN.format("ova")
    store = Store(spark, root + "/store", buckets=2)
    moments = iter(range(1, 20))

    def ingest(*pages):
        day = next(moments)
        rows = land(spark, f"{root}/pages-{day}", *[(ova, n, what) for n, what in pages])
        ingest_batch(store, rows.withColumn("fetched_at", F.lit(f"2024-06-{day:02}").cast("timestamp")), day)
        state = store.read("sync_state").filter(F.col("key") == ova).first()
        return state.next_page, state.last_error, state.cycle, state.last_completed_at and state.last_completed_at.day

    more, last = body(more=True), body()
    assert ingest((4, more), (5, 503), (6, more)) == (5, "HTTP 503", 0, None)
    assert ingest((5, 404)) == (1, "HTTP 404", 1, None)
    assert ingest((1, more)) == (2, None, 1, None)
    assert ingest((2, last)) == (1, None, 2, 4)
    assert store.read("refused_pages").count() == 0
    # A shorter scan closes what lay behind its last page, and nothing before it.
    assert ingest((2, 503), (7, 503), (8, 503)) == (2, "HTTP 503", 2, 4)
    assert ingest((3, last)) == (2, "HTTP 503", 3, 4)
    assert [r.page for r in store.read("refused_pages").collect()] == [2]
    assert ingest((2, more)) == (3, None, 3, 4)
    assert ingest((3, last)) == (1, None, 4, 8)
    # A refusal from before the end that lands late belongs to a page the scan no longer has.
    late = land(spark, f"{root}/late", (ova, 9, 503)).withColumn("fetched_at", F.lit("2024-06-05").cast("timestamp"))
    ingest_batch(store, late, 100)
    assert store.read("refused_pages").count() == 0


def snapshot(store):
    tables = ("anime", "anime_genre", "anime_studio", "studio", "genre", "anime_directory", "manga", "manga_genre", "manga_directory")
    rows = {t: sorted(map(str, store.read(t).drop("last_sync").collect())) for t in tables}
    rows |= {t: sorted(map(str, store.read(t).collect())) for t in ("sync_state", "refused_pages")}
    logs = ("scan_titles", "scan_links", "scan_pages")
    return rows | {t: sorted(map(str, store.read_batches(t).collect())) for t in logs}


class Stop(Exception):
    pass


def test_a_batch_that_stops_anywhere_goes_on(spark, root, monkeypatch):
    """After a stop at any write of any commit, the batch run again ends in the same tables and log."""
    studio, genre = {"mal_id": 7, "name": "Made"}, {"name": "Drama"}
    old = [{"mal_id": i, "title": f"T{i}", "studios": [studio], "genres": [genre]} for i in range(1, 5)]
    ova, manga = TYPE_SCAN.format("ova"), TYPE_SCAN.format("manga")
    first = land(spark, root + "/first", (ova, 1, body(*old, more=True)), (manga, 1, body({"mal_id": 9, "title": "M", "genres": [genre]})))
    gone = {"mal_id": 2, "title": "T2", "rating": "Rx - Hentai"}
    second = land(
        spark, root + "/second", (ova, 2, body(gone, {"mal_id": 8, "title": "New", "studios": [studio]}, {"mal_id": 1, "title": "One"})),
        (manga, 2, body({"mal_id": 9, "title": "M2", "genres": [{"name": "Erotica"}]}, {"mal_id": 10, "title": "N"})), (ova, 3, 503),
    )
    now = F.lit("2024-06-01").cast("timestamp")

    base = Store(spark, root + "/base", buckets=2)
    ingest_batch(base, first, 0, now)

    def fresh(name):
        shutil.copytree(base.root, f"{root}/{name}")
        return Store(spark, f"{root}/{name}")

    whole = fresh("whole")
    ingest_batch(whole, second, 1, now)
    want = snapshot(whole)
    assert whole.read("anime_studio").count() == 4 and whole.read("anime").count() == 4
    assert whole.read("manga").count() == 1 and whole.read("manga_directory").first().mal_id == 10

    real, calls = Store._overwrite, {"left": None}

    def limited(self, change):
        if calls["left"] is not None:
            calls["left"] -= 1
            if calls["left"] < 0:
                raise Stop
        real(self, change)

    monkeypatch.setattr(Store, "_overwrite", limited)
    monkeypatch.setattr(Store, "_in_threads", lambda self, work, changes: [work(c) for c in changes])
    for allowed in (0, 4, 11):
        store = fresh(f"stop-{allowed}")
        calls["left"] = allowed
        with pytest.raises(Stop):
            ingest_batch(store, second, 1, now)
        calls["left"] = None
        again = Store(spark, store.root)
        ingest_batch(again, second, 1, now)
        assert snapshot(again) == want, allowed
        assert not path_exists(spark, store.root + "/journal")


def test_a_purge_that_stops_leaves_no_links(spark, root, cat, monkeypatch):
    store = Store(spark, root + "/store")
    store.load({t: getattr(cat, t) for t in cat.tables()})
    kept, gone = purge(store.catalogue(), "anime")
    assert gone.count() > 0
    real = Store._overwrite

    def titles_only(self, change):
        if change.table != "anime":
            raise Stop
        real(self, change)

    monkeypatch.setattr(Store, "_overwrite", titles_only)
    monkeypatch.setattr(Store, "_in_threads", lambda self, work, changes: [work(c) for c in sorted(changes, key=lambda c: c.table)])
    with pytest.raises(Stop):
        store.commit(kept)
    monkeypatch.undo()
    store.recover()
    for table in ("anime_genre", "anime_studio", "anime_streaming_service"):
        assert store.read(table).join(store.read("anime"), "anime_id", "left_anti").count() == 0
    ids = store.read("anime").filter("mal_id IS NOT NULL").select("mal_id", F.col("anime_id").alias("item_id"))
    assert ids.exceptAll(store.read("anime_directory")).count() == 0 and store.read("anime_directory").count() == ids.count()


def test_a_store_keeps_its_number_of_buckets(spark, root):
    rows = spark.createDataFrame([], schema("anime")).unionByName(
        spark.range(1, 41).select(F.col("id").alias("anime_id"), F.col("id").alias("mal_id")), allowMissingColumns=True
    )
    Store(spark, root, buckets=64).load({"anime": rows})
    assert Store(spark, root).find("anime", list(range(1, 8))).count() == 7
    with pytest.raises(ValueError, match="64 buckets"):
        Store(spark, root, buckets=16)


def test_ids_are_looked_up_in_few_buckets(spark, root, cat):
    store = Store(spark, root, buckets=32)
    store.load({t: getattr(cat, t) for t in cat.tables()})
    asked = spark.createDataFrame([(1,), (2,), (10**9,)], "mal_id bigint")
    stored = store.catalogue()
    found = stored.known("anime", asked)
    assert sorted(found.collect()) == sorted(cat.known("anime", asked).collect())
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan), plan


def test_a_random_pick_of_a_store_reads_a_few_buckets(spark, root, cat):
    """The pick against the smallest digests of all titles in those buckets, read without pruning."""
    store = Store(spark, root + "/store", buckets=50)
    store.load({t: getattr(cat, t) for t in Catalogue.tables()})
    stored, spec = store.catalogue(), CatalogueQuery()
    part, share = stored.sampled(0.2, 7)
    assert share == 1.0
    chosen = store.buckets_of(part.anime.select("anime_id")) | store.buckets_of(part.manga.select("manga_id"))
    assert 0 < len(chosen) <= 10 < len(store.buckets_of(cat.anime.select("anime_id")))
    pruned = part.identity_rows(spec)._jdf.queryExecution().executedPlan().toString()
    assert pruned.count("PartitionFilters: [isnotnull(bucket") == 2 or pruned.count("PartitionFilters: [bucket") == 2
    lot = bucket_of(F.col("record_id"), 50).isin(sorted(chosen))
    rows = stored.identity_rows(spec).filter(lot).collect()
    digest = lambda r: hashlib.sha256(f"{r.content_type}-{r.record_id}-7".encode()).hexdigest()
    want = [(r.content_type, r.record_id) for r in sorted(rows, key=digest)[:6]]
    got = ranking.random_sample(part.identity_rows(spec), 6, 7, share).collect()
    assert [(r.content_type, r.record_id) for r in got] == want and len(want) == 6
