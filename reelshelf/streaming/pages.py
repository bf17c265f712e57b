"""Incremental ingestion of landed provider pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import apply, gate, health, parsing
from reelshelf.plans.catalogue import Catalogue
from reelshelf.plans.spec import type_value
from reelshelf.schemas import schema
from reelshelf.session import materialise
from reelshelf.sources.landing import check_pages, entries
from reelshelf.sources.store import Store

# --- Fixed values: scan keys --------------------------------------------------
TV_SCAN = "bulk:tv-catalogue-seasons:v2"
TYPE_SCAN = "bulk:catalogue:{}:v1"
SEASON_SCANS = ("current", "upcoming")


@dataclass(frozen=True)
class Scan:
    """What the pages of one kind of scan mean. Scans are applied in ``order``."""

    kind: str
    order: int
    label: str
    key: str | None = None
    discover_missing: bool = True
    expected: str | None = None


# Season scans have a key for each season, all others have one key.
SCANS = (
    *(Scan("season", i, name) for i, name in enumerate(SEASON_SCANS)),
    Scan("anime", 2, "tv", TV_SCAN, discover_missing=False, expected="TV"),
    *(
        Scan("anime", 3 + i, name, TYPE_SCAN.format(name), expected=type_value(name))
        for i, name in enumerate(fv.SUPPLEMENTAL_TYPES)
    ),
    *(
        Scan("manga", 10 + i, name, TYPE_SCAN.format(name), expected=content_type)
        for i, (name, content_type) in enumerate(fv.PRINT_TYPES.items())
    ),
)
UNKNOWN_SCAN = "unknown scan"


def scan_columns(key: Column) -> dict[str, Column]:
    """Meaning of a scan key: its ``scan`` (order; NULL for an unknown key), year and season."""
    parts = F.split(key, ":")
    seasonal = F.coalesce(
        (F.size(parts) == 3) & parts[1].rlike("^[0-9]{1,9}$") & parts[2].isin(*fv.SEASONS), F.lit(False)
    )
    order = F.lit(None).cast("int")
    for scan in SCANS:
        matches = (parts[0] == scan.label) & seasonal if scan.kind == "season" else key == scan.key
        order = F.when(matches, scan.order).otherwise(order)
    return {
        "scan": order,
        "scan_year": F.when(seasonal, parts[1].try_cast("int")),
        "scan_season": F.when(seasonal, parts[2]),
    }


def checked_pages(pages: DataFrame) -> DataFrame:
    """A1 for pages of every scan: verdict, parsed body and scan; each page is parsed once."""
    named = pages.withColumns(scan_columns(F.col("scan_key")))
    parts = []
    for kind in ("season", "anime", "manga"):
        orders = [s.order for s in SCANS if s.kind == kind]
        parts.append(check_pages(named.filter(F.col("scan").isin(orders)), kind))
    unknown = named.filter(F.col("scan").isNull())
    refused = unknown.select(
        "scan_key", "page", "status_code", "fetched_at", F.lit(UNKNOWN_SCAN).alias("reason")
    )
    out = reduce(DataFrame.unionByName, parts).unionByName(refused, allowMissingColumns=True)
    return out.withColumns(scan_columns(F.col("scan_key")))


def page_results(checked: DataFrame, last_page: int | None = None) -> DataFrame:
    """Cursor input of A8: one row per page of a known scan, with an error when it was refused.

    A page that no longer exists ends the scan: it is refused as page 1, which has to
    be there, and closes itself and all pages behind it. The last page closes those
    behind it. ``last_page`` is the last page of print scans that the provider serves,
    if it has such a limit: a scan that reaches it starts over.
    """
    vanished = F.col("reason").isNotNull() & (F.col("status_code") == 404) & (F.col("page") > 1)
    error, page = F.col("reason"), F.col("page")
    ended = error.isNull() & ~F.coalesce("has_next_page", F.lit(True))
    if last_page is not None:
        labels = F.create_map(*[F.lit(x) for s in SCANS for x in (s.order, s.label)])
        printed = F.col("scan").isin([s.order for s in SCANS if s.kind == "manga"])
        capped = printed & error.isNull() & F.col("has_next_page") & (page >= last_page)
        text = F.concat(labels[F.col("scan")], F.lit(f" catalogue exceeds provider page limit {last_page}"))
        error, page = F.when(capped, text).otherwise(error), F.when(capped, 1).otherwise(page)
        ended = ended | capped
    return checked.filter("scan IS NOT NULL").select(
        "scan_key",
        F.when(vanished, 1).otherwise(page).cast("int").alias("page"),
        F.coalesce("has_next_page", F.lit(True)).alias("has_next_page"),
        F.col("fetched_at").alias("seen_at"),
        error.alias("error"),
        F.when(vanished, F.col("page")).when(ended, F.col("page") + 1).cast("int").alias("closes"),
    )


def apply_scan(cat: Catalogue, checked: DataFrame, scan: Scan, now: Column) -> apply.Applied:
    """A4 for the accepted pages of one kind of scan.

    Pages of several seasons are applied together, ordered by key and page.
    """
    found = entries(checked)
    if scan.kind == "season":
        meaning = scan_columns(F.col("scan_key"))
        found = found.withColumn("page", F.struct("scan_key", "page")).withColumns(
            {"scan_year": meaning["scan_year"], "scan_season": meaning["scan_season"]}
        )
    clean = parsing.clean_manga if scan.kind == "manga" else parsing.clean_anime
    # Cleaned once; gate, counters and link parsing read the typed copy.
    rows = materialise(clean(found), "clean")
    if scan.kind == "manga":
        return apply.apply_manga_page(cat, rows, now, expected=scan.expected)
    gates = {}
    if scan.kind == "season":
        rows = gate.prepare_season(rows, F.col("scan_year"), F.col("scan_season")).drop("scan_year", "scan_season")
    else:
        gates = {"allowed_types": (scan.expected,), "default_type": scan.expected}
    return apply.apply_anime_page(cat, rows, now, discover_missing=scan.discover_missing, **gates)


def ingest_batch(
    store: Store, pages: DataFrame, batch_id: int, now: Column | None = None, last_page: int | None = None
) -> None:
    """Apply one batch of pages, one kind of scan after another, and move every cursor.

    Pages that are refused, those of an unknown scan among them, are kept in
    ``refused_pages`` until they land again and are accepted, or their scan ends before
    them. Each kind of scan is one commit, with the log of what it did and its mark; a
    batch that failed half-way goes on with the first scan that is not marked. The
    cursors and the mark of the batch are the last commit.
    """
    store.recover()
    if batch_id <= store.batch("pages"):
        return
    done = store.steps("pages", batch_id)
    now = F.current_timestamp() if now is None else now
    checked = materialise(checked_pages(pages), "checked")
    # At most one row for each kind of scan.
    present = {r[0] for r in checked.select("scan").distinct().collect()}
    batch = f"pages-{batch_id}"
    for scan in SCANS:
        if scan.order not in present or scan.order in done:
            continue
        applied = apply_scan(store.catalogue(), checked.filter(F.col("scan") == scan.order), scan, now)
        label = F.lit(scan.label)
        medium = F.lit("manga" if scan.kind == "manga" else "anime")
        titles = applied.titles.select(label.alias("provider_type"), medium.alias("medium"), "item_id", "outcome")
        logs = [
            store.batch_rows("scan_titles", titles, batch, "provider_type"),
            store.batch_rows("scan_links", applied.links.withColumn("phase", label), batch, "phase"),
        ]
        done |= {scan.order}
        store.commit(applied.catalogue, logs, store.marked("pages", batch_id, done))
    results = page_results(checked, last_page)
    unknown = checked.filter("scan IS NULL").select(
        "scan_key",
        "page",
        F.lit(True).alias("has_next_page"),
        F.col("fetched_at").alias("seen_at"),
        F.col("reason").alias("error"),
        F.lit(None).cast("int").alias("closes"),
    )
    state = store.read("sync_state")
    refused = health.refused_pages(store.read("refused_pages"), results.unionByName(unknown), state)
    refused = materialise(refused, "refused")
    labels = F.create_map(*[F.lit(x) for s in SCANS for x in (s.order, s.label)])
    counted = checked.groupBy(F.coalesce(labels[F.col("scan")], F.lit(UNKNOWN_SCAN)).alias("provider_type")).agg(
        F.count_if(F.col("reason").isNull()).alias("pages_completed"),
        F.count_if(F.col("reason").isNotNull()).alias("pages_failed"),
    )
    store.write(
        {"sync_state": health.advance_state(state, results, refused), "refused_pages": refused},
        logs=[store.batch_rows("scan_pages", counted, batch)],
        mark=store.marked("pages", batch_id),
    )


def ingest_pages_stream(
    spark: SparkSession, landing: str, store: Store, checkpoint: str, last_page: int | None = None
) -> StreamingQuery:
    """Ingest every page file that landed since the last run, then stop.

    The checkpoint remembers the files already read, so a run resumes where the
    last one ended; a refused page is retried when it lands again. A store takes
    the batches of one checkpoint.
    """
    pages = spark.readStream.schema(schema("landed_pages")).parquet(landing)
    return (
        pages.writeStream.foreachBatch(
            lambda batch, batch_id: ingest_batch(store, batch, batch_id, last_page=last_page)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
