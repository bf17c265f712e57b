"""The scheduled synchronisation, one batch job over stored tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import adult, apply, health, profile, ranking
from reelshelf.plans.catalogue import Catalogue
from reelshelf.schemas import LINKS, schema
from reelshelf.session import materialise
from reelshelf.sources.landing import classify_fetch
from reelshelf.sources.store import Store, StoredCatalogue, publish_facets
from reelshelf.streaming.pages import ingest_pages_stream

QUEUES = ("season_backfill", "anime_refresh", "streaming_backfill", "print_refresh")


@dataclass(frozen=True)
class RunReport:
    """What one run did, and which titles to request before the next one."""

    removed_anime: int
    removed_print: int
    facets: int
    health: DataFrame
    links: DataFrame
    scans: DataFrame
    requests: DataFrame
    season_coverage: DataFrame
    metric_coverage: DataFrame


def purge(cat: Catalogue, medium: str) -> tuple[Catalogue, DataFrame]:
    """A6 for one medium and its links; without restricted titles nothing changes."""
    names = apply.MANGA_BRIDGES if medium == "manga" else apply.ANIME_BRIDGES
    link = LINKS[names[0]]
    gone = adult.adult_ids(getattr(cat, medium), getattr(cat, names[0]), cat.genre, link)
    gone = materialise(gone, "gone")
    if gone.isEmpty():
        return cat, gone
    cat = cat.narrowed(gone, medium, *names)
    rows = {t: getattr(cat, t) for t in (medium, *names)}
    moves = rows[medium].join(gone, link.item, "left_semi").filter("mal_id IS NOT NULL")
    cat = cat.moved(medium, moves.select("mal_id", F.col(link.item).alias("item_id"), F.lit(True).alias("gone")))
    return replace(cat, **{t: adult.without(r, gone, link.item) for t, r in rows.items()}), gone


def select_queue(cat: Catalogue, queue: str, limit: int) -> DataFrame:
    """The titles of one queue to request next."""
    if queue == "print_refresh":
        return ranking.work_queue(cat.manga, "last_attempt", "manga_id", limit)
    if queue == "season_backfill":
        return ranking.season_queue(cat.anime, limit)
    if queue == "streaming_backfill":
        return ranking.streaming_queue(cat.anime, cat.anime_streaming_service, limit)
    return ranking.work_queue(cat.anime, "last_attempt", "anime_id", limit)


def answered(cat: Catalogue, medium: str, answers: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every stored title that has an answer, and the chosen ones that cannot be requested."""
    key = f"{medium}_id"
    asked = materialise(cat.known(medium, answers.select("mal_id").distinct()), "asked").select(F.col("item_id").alias(key))
    items = getattr(cat.narrowed(asked, medium), medium)
    known = items.join(asked.distinct(), key, "left_semi").select(items.columns)
    return known.unionByName(chosen.filter("mal_id IS NULL").select(items.columns))


def run_queue(cat: Catalogue, queue: str, details: DataFrame, limit: int, now: Column) -> apply.Applied:
    """Apply every response that landed for one refresh queue, whenever it was requested."""
    landed = details.filter(F.col("kind") == queue)
    kind = "manga" if queue == "print_refresh" else "anime"
    answers = materialise(apply.detail_entries(classify_fetch(landed, kind), kind), "answers")
    titles = answered(cat, kind, answers, select_queue(cat, queue, limit))
    work = {
        "print_refresh": apply.apply_print_refresh,
        "season_backfill": apply.apply_season_backfill,
        "streaming_backfill": apply.apply_streaming_backfill,
        "anime_refresh": apply.apply_refresh,
    }[queue]
    return work(cat, titles, answers, now)


def run_scheduled(
    spark: SparkSession,
    store: Store,
    pages: str,
    checkpoint: str,
    details: str,
    now: Column,
    limit: int = fv.REFRESH_LIMIT,
    streaming_limit: int = fv.STREAMING_LIMIT,
) -> RunReport:
    """Fixed order: purge, pages, refresh queues, facets, coverage.

    ``pages`` and ``details`` are landing folders; ``details`` holds this run's
    responses, and all of them are applied. The limits only say how many titles
    to request next. Every phase is one commit with the log of what it did, and starts
    from the tables the previous one stored. A run that stopped is called again with
    the same folders: it goes on after its last commit, and reports all of the run.
    """
    store.recover()
    number = store.batch("run") + 1
    batch, done = f"run-{number}", store.steps("run", number)
    before = store.since("run", number)
    if before is None:
        before = store.batch("pages")
        store.write({}, mark=store.marked("run", number, [], before))

    def committed(step: int, cat: StoredCatalogue, queue: str, medium: str, titles: DataFrame, links: DataFrame | None = None) -> None:
        nonlocal done
        done |= {step}
        rows = titles.select(F.lit(queue).alias("queue"), F.lit(medium).alias("medium"), "item_id", "outcome")
        logs = [store.batch_rows("run_titles", rows, batch, "queue")]
        if links is not None:
            logs.append(store.batch_rows("scan_links", links.withColumn("phase", F.lit(queue)), batch, "phase"))
        store.commit(cat, logs, store.marked("run", number, done, before))

    for step, medium in enumerate(("anime", "manga")):
        if step not in done:
            kept, gone = purge(store.catalogue(), medium)
            gone = gone.select(F.col(f"{medium}_id").alias("item_id"), F.lit("removed_adult").alias("outcome"))
            committed(step, kept, f"purge_{medium}", medium, gone)

    ingest_pages_stream(spark, pages, store, checkpoint).awaitTermination()
    batches = [f"pages-{i}" for i in range(before + 1, store.batch("pages") + 1)]
    scanned = store.read_batches("scan_titles", batches)

    landed = spark.read.schema(schema("landed_details")).parquet(details)
    for step, queue in enumerate(QUEUES, 2):
        if step not in done:
            applied = run_queue(store.catalogue(), queue, landed, limit, now)
            medium = "manga" if queue == "print_refresh" else "anime"
            committed(step, applied.catalogue, queue, medium, applied.titles, applied.links)

    did = store.read_batches("run_titles", [batch])
    gone = did.select("medium", "outcome").unionByName(scanned.select("medium", "outcome"))
    removed = {"anime": 0, "manga": 0}
    for row in gone.filter("outcome = 'removed_adult'").groupBy("medium").count().collect():
        removed[row["medium"]] += row["count"]

    cat = store.catalogue()
    sizes = {q: streaming_limit if q == "streaming_backfill" else limit for q in QUEUES}
    requests = [
        select_queue(cat, q, n).filter("mal_id > 0").select(F.lit(q).alias("queue"), "mal_id") for q, n in sizes.items()
    ]
    facets = publish_facets(store, cat)
    store.write({}, mark=store.marked("run", number))
    return RunReport(
        removed_anime=removed["anime"],
        removed_print=removed["manga"],
        facets=facets,
        health=health.refresh_health(did.filter(F.col("queue").isin(*QUEUES))),
        links=health.reconcile_stats(store.read_batches("scan_links", [*batches, batch])),
        scans=health.scan_summary(scan_results(store, batches)),
        requests=reduce(DataFrame.unionByName, requests),
        season_coverage=profile.season_coverage(cat.anime),
        metric_coverage=profile.metric_coverage(cat),
    )


def scan_results(store: Store, batches: list[str]) -> DataFrame:
    """E11 input: page and title counters of the scans in some batches."""
    titles = store.read_batches("scan_titles", batches)
    zero = F.lit(0).cast("long")
    counted = titles.select(
        "provider_type",
        zero.alias("pages_completed"),
        zero.alias("pages_failed"),
        *[(F.col("outcome") == o).cast("long").alias(n) for o, n in (("inserted", "inserted"), ("updated", "updated"), ("removed_adult", "removed"))],
    )
    pages = store.read_batches("scan_pages", batches)
    return counted.unionByName(pages.withColumns({n: zero for n in ("inserted", "updated", "removed")}))
