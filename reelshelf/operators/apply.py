"""Provider batches applied to the catalogue.

Every function returns new lazy tables; a store writes them. A stored catalogue
looks title ids up in its directory, is then narrowed to the buckets of the batch's
titles, and only those are read, merged and written. The batch side is materialised, so its true size decides whether joins
broadcast it. A table the batch does not change is handed on as the same object,
so it is not stored again.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.operators import gate, identity, merge, parsing, reconcile
from reelshelf.plans.catalogue import Catalogue
from reelshelf.schemas import LINKS, Link
from reelshelf.session import materialise

ANIME_BRIDGES = ("anime_genre", "anime_studio", "anime_streaming_service")
MANGA_BRIDGES = ("manga_genre", "manga_author")


@dataclass(frozen=True)
class Applied:
    """Outcome of one batch.

    ``titles``: one row per affected title with ``outcome`` and
    ``season_assigned``. ``links``: change-log rows per title and entity kind.
    """

    catalogue: Catalogue
    titles: DataFrame
    links: DataFrame


# --- entry points ---------------------------------------------------------------


def apply_anime_page(
    cat: Catalogue, rows: DataFrame, now: Column, *, discover_missing: bool, **gates
) -> Applied:
    """A4: cleaned entries of anime pages; adult ids delete, known ids update."""
    return apply_anime(cat, gate.gate_anime(rows, **gates), now, discover_missing)


def import_season(
    cat: Catalogue, rows: DataFrame, now: Column, year: int, season: str, limit: int | None = None
) -> tuple[Applied, DataFrame]:
    """A5: a whole named season; also one row of (saved, skipped)."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    gated = materialise(gate.gate_anime(rows, year=year, season=season), "season")
    counts = gate.gate_counts(rows, gated)
    saved = F.col("kept") if limit is None else F.least(F.col("kept"), F.lit(limit))
    if limit is not None:
        chosen = gated.filter(~F.col("adult")).orderBy("first").limit(limit)
        gated = chosen.unionByName(gated.filter("adult"))
    return apply_anime(cat, gated, now, True), counts.select(saved.alias("saved"), "skipped")


def apply_anime(cat: Catalogue, gated: DataFrame, now: Column, discover_missing: bool) -> Applied:
    """A4 on gated entries: (mal_id, adult, e)."""
    gated = materialise(gated.select("mal_id", "adult", "e"), "gated")
    work = gated.join(cat.known("anime", gated), "mal_id", "left").withColumn("known", F.col("item_id").isNotNull())
    work = materialise(work if discover_missing else work.filter("known"), "known")
    cat = cat.narrowed(work.select(F.coalesce("item_id", -F.col("mal_id"))), "anime", *ANIME_BRIDGES)
    stored = cat.anime.select(F.col("anime_id").alias("item_id"), "type", "season")
    work = work.join(stored, "item_id", "left")
    outcome = F.when(F.col("adult") & F.col("known"), "removed_adult").when(
        ~F.col("adult"), F.when(F.col("known"), "updated").otherwise("inserted")
    )
    work = (
        work.withColumn("outcome", outcome)
        .filter("outcome IS NOT NULL")
        .withColumn("item_id", F.coalesce("item_id", -F.col("mal_id")))
        .withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))
    )
    return _apply_anime(cat, materialise(work, "work"), now)


def apply_refresh(cat: Catalogue, queue: DataFrame, details: DataFrame, now: Column) -> Applied:
    """I16: general anime refresh. Every selected title is marked attempted."""
    work = _fetched_anime(queue, details)
    cat = cat.narrowed(work.select("item_id"), "anime", *ANIME_BRIDGES)
    return _apply_anime(cat, work, now, ("last_attempt", "last_streaming_attempt"))


def apply_season_backfill(cat: Catalogue, queue: DataFrame, details: DataFrame, now: Column) -> Applied:
    """Refresh of TV titles that lack a season."""
    work = _fetched_anime(queue, details)
    cat = cat.narrowed(work.select("item_id"), "anime", *ANIME_BRIDGES)
    return _apply_anime(cat, work, now, ("last_season_attempt", "last_attempt"))


def apply_streaming_backfill(cat: Catalogue, queue: DataFrame, details: DataFrame, now: Column) -> Applied:
    """Streaming links and attempt time only; other columns stay.

    ``titles`` also has ``payload``: missing, empty or given. A title counts as
    updated only when one of its links changed, else as checked.
    """
    work = _fetched_anime(queue, details)
    cat = cat.narrowed(work.select("item_id"), "anime", *ANIME_BRIDGES)
    titles = _marked(cat.anime, work, "anime_id", now, ("last_streaming_attempt",))
    out = replace(_without(cat, work, ANIME_BRIDGES, "anime_id"), anime=titles.drop("e"))
    out = out.moved("anime", _moves(work))
    used = _usable(work)
    out, log = _apply_streaming(out, used)
    touched = log.filter(F.col("created") + F.col("removed") + F.col("changed") > 0)
    touched = touched.select("item_id", F.lit(True).alias("_touched"))
    payload = F.when(F.col("e").isNull(), None).when(~F.col("e.has_streaming"), "missing")
    payload = payload.when(F.size("e.streaming") == 0, "empty").otherwise("given")
    done = F.when((F.col("outcome") == "updated") & F.col("_touched").isNull(), "checked")
    titles = work.join(touched, "item_id", "left").select(
        "item_id",
        "mal_id",
        F.coalesce(done, "outcome").alias("outcome"),
        F.lit(False).alias("season_assigned"),
        payload.alias("payload"),
    )
    return Applied(out, titles, log)


def apply_manga_page(cat: Catalogue, rows: DataFrame, now: Column, *, expected: str) -> Applied:
    """A4: cleaned entries of print pages of one expected content type."""
    gated = materialise(gate.gate_manga(rows, expected).select("mal_id", "adult", "e"), "gated")
    work = gated.join(cat.known("manga", gated), "mal_id", "left").withColumn("known", F.col("item_id").isNotNull())
    work = materialise(work.filter("known OR NOT adult"), "work")
    fresh = work.filter(~F.col("known")).select("mal_id")
    fresh = identity.numbered(fresh, cat.manga.select("manga_id"), "mal_id", "manga_id")
    work = work.join(fresh, "mal_id", "left").withColumn("item_id", F.coalesce("item_id", "manga_id"))
    outcome = F.when(F.col("adult"), "removed_adult").otherwise(
        F.when(F.col("known"), "updated").otherwise("inserted")
    )
    work = work.withColumn("outcome", outcome).withColumn("expected", F.lit(expected))
    return _apply_manga(cat, materialise(work.drop("manga_id"), "work"), now)


def apply_print_refresh(cat: Catalogue, queue: DataFrame, details: DataFrame, now: Column) -> Applied:
    """Print refresh; titles of an unsupported type are deleted too."""
    queue = queue.select(F.col("manga_id").alias("item_id"), "mal_id", F.col("content_type").alias("expected"))
    work = _fetched(queue, details)
    return _apply_manga(cat, materialise(work, "work"), now, ("last_attempt",))


# --- shared steps -----------------------------------------------------------------


def _fetched(queue: DataFrame, details: DataFrame) -> DataFrame:
    """Selected titles with the outcome of their latest response.

    ``details`` has ``mal_id``, ``fetched_at``, ``outcome`` and cleaned ``e``.
    """
    latest = details.groupBy("mal_id").agg(
        F.max_by(F.struct("outcome", "e"), "fetched_at").alias("_r")
    )
    out = queue.join(latest, "mal_id", "left")
    adult = F.coalesce((F.col("_r.outcome") == "ok") & F.col("_r.e.is_adult"), F.lit(False))
    outcome = (
        F.when(F.col("mal_id").isNull(), "missing_mal_id")
        .when(F.col("_r").isNull(), "temporary")
        .when(adult, "removed_adult")
        .when(F.col("_r.outcome") == "ok", "updated")
        .when(F.col("_r.outcome") == "unsupported_type", "removed_unsupported")
        .otherwise(F.col("_r.outcome"))
    )
    out = out.withColumn("outcome", outcome)
    entry = F.when(F.col("outcome") == "updated", F.col("_r.e"))
    return out.withColumn("e", entry).withColumn("known", F.lit(True)).drop("_r")


def _fetched_anime(queue: DataFrame, details: DataFrame) -> DataFrame:
    queue = queue.select(F.col("anime_id").alias("item_id"), "mal_id", "type", "season")
    return materialise(_fetched(queue, details), "work")


def detail_entries(classified: DataFrame, kind: str) -> DataFrame:
    """Classified details with the cleaned entry in struct ``e``.

    Seasons, pages and positions do not exist here, so titles order by id.
    """
    clean = parsing.clean_anime if kind == "anime" else parsing.clean_manga
    keys = classified.select(F.col("mal_id").alias("asked"), "fetched_at", "outcome", "entry")
    rows = clean(keys)
    names = [c for c in rows.columns if c not in ("asked", "fetched_at", "outcome")]
    entry = F.struct(F.lit(1).alias("page"), F.lit(0).alias("pos"), *names)
    return rows.select(
        F.col("asked").alias("mal_id"),
        "fetched_at",
        "outcome",
        F.when(F.col("outcome") == "ok", entry).alias("e"),
    )


def _gone(work: DataFrame) -> DataFrame:
    return work.filter(F.col("outcome").startswith("removed"))


def _moves(work: DataFrame) -> DataFrame:
    """Titles that come or go: (mal_id, item_id, gone)."""
    gone = F.col("outcome").startswith("removed")
    moves = work.filter((gone | (F.col("outcome") == "inserted")) & F.col("mal_id").isNotNull())
    return moves.select("mal_id", "item_id", gone.alias("gone"))


def _usable(work: DataFrame) -> DataFrame:
    """Titles to merge, with the order in which the provider listed them."""
    seq = F.struct("e.page", "e.pos", "item_id")
    return work.filter("e IS NOT NULL").withColumn("seq", seq)


def _any(rows: DataFrame) -> bool:
    return not rows.isEmpty()


def _without(cat: Catalogue, work: DataFrame, bridges: tuple[str, ...], key: str) -> Catalogue:
    gone = _gone(work).select(F.col("item_id").alias(key))
    if not _any(gone):
        return cat
    kept = {b: getattr(cat, b) for b in bridges}
    return replace(
        cat, **{b: rows.join(gone, key, "left_anti").select(*rows.columns) for b, rows in kept.items()}
    )


def _marked(items: DataFrame, work: DataFrame, key: str, now: Column, marks) -> DataFrame:
    """Stored rows left after deletion, with entry ``e`` and attempt times."""
    extra = ["expected"] if "expected" in work.columns else []
    batch = work.filter("known").select(F.col("item_id").alias(key), "outcome", "e", *extra)
    out = items.join(batch, key, "left")
    out = out.filter(~F.coalesce(F.col("outcome").startswith("removed"), F.lit(False)))
    for mark in marks:
        out = out.withColumn(mark, F.when(F.col("outcome").isNotNull(), now).otherwise(F.col(mark)))
    return out.drop("outcome")


def _apply_anime(cat: Catalogue, work: DataFrame, now: Column, marks: tuple[str, ...] = ()) -> Applied:
    """``cat`` is narrowed to the titles of ``work``."""
    stored = merge.merge_anime(_marked(cat.anime, work, "anime_id", now, marks), now)
    fresh = work.filter("outcome = 'inserted'")
    added = merge.merge_anime(merge.new_anime(fresh), now)
    out = replace(_without(cat, work, ANIME_BRIDGES, "anime_id"), anime=stored.unionByName(added))
    out = out.moved("anime", _moves(work))

    used = _usable(work)
    out = _apply_genres(out, used.withColumn("has_genres", F.lit(True)), "anime_genre", False)
    out, studio_log = _apply_studios(out, used)
    out, streaming_log = _apply_streaming(out, used)
    assigned = F.col("season").isNull() & F.col("e").isNotNull() & merge.season_after().isNotNull()
    titles = work.select(
        "item_id", "mal_id", "outcome", assigned.alias("season_assigned")
    )
    return Applied(out, titles, studio_log.unionByName(streaming_log))


def _apply_manga(cat: Catalogue, work: DataFrame, now: Column, marks: tuple[str, ...] = ()) -> Applied:
    cat = cat.narrowed(work.select("item_id"), "manga", *MANGA_BRIDGES)
    stored = _marked(cat.manga, work, "manga_id", now, marks)
    stored = merge.merge_manga(stored, F.col("expected"), now)
    fresh = work.filter("outcome = 'inserted'").withColumn("manga_id", F.col("item_id"))
    blank = merge.new_manga(fresh, F.col("expected"))
    added = merge.merge_manga(blank, F.col("content_type"), now)
    out = replace(_without(cat, work, MANGA_BRIDGES, "manga_id"), manga=stored.unionByName(added))
    out = out.moved("manga", _moves(work))

    used = _usable(work)
    out = _apply_genres(out, used.withColumn("has_genres", F.col("e.has_genres")), "manga_genre", True)
    out, log = _apply_authors(out, used)
    titles = work.select("item_id", "mal_id", "outcome", F.lit(False).alias("season_assigned"))
    return Applied(out, titles, log)


def _apply_genres(cat: Catalogue, used: DataFrame, table: str, replace_empty: bool) -> Catalogue:
    """Genre links of the batch; unknown genres are added first."""
    link = LINKS[table]
    wanted = used.select("item_id", F.col("e.genres").alias("genres"), "has_genres")
    scope, named, unknown = reconcile.reconcile_genres(cat.genre, wanted, replace_empty, link)
    if not _any(scope):
        return cat
    unknown = materialise(unknown, "genres")
    if _any(unknown):
        fresh = identity.numbered(unknown, cat.genre, "name").select("id", "name")
        cat = replace(cat, genre=cat.genre.unionByName(fresh))
    incoming = named.join(cat.genre.withColumnRenamed("id", link.ref), "name")
    incoming = incoming.select(link.item, link.ref)
    links = getattr(cat, table)
    actions = materialise(reconcile.reconcile_links(links, incoming, scope, link), "actions")
    return _relinked(cat, table, actions, scope, link)


def _relinked(cat: Catalogue, table: str, actions: DataFrame, scope: DataFrame, link: Link) -> Catalogue:
    """Catalogue with the actions applied; without changes the table stays as it is."""
    if not _any(actions.filter(~F.col("action").isin("keep", "retain"))):
        return cat
    return replace(cat, **{table: reconcile.apply_actions(getattr(cat, table), actions, scope, link)})


def _no_log(used: DataFrame) -> DataFrame:
    return used.sparkSession.createDataFrame(
        [], "entity string, item_id bigint, created bigint, removed bigint, changed bigint, malformed bigint"
    )


def _scope(completeness: DataFrame, item: str) -> DataFrame:
    return completeness.filter("is_list").select(F.col("item_id").alias(item), "complete")


def _entries(used: DataFrame, field: str) -> DataFrame:
    return used.select(
        "item_id", "seq", F.col(f"e.has_{field}").alias(f"has_{field}"), F.col(f"e.{field}").alias(field)
    )


def _apply_studios(cat: Catalogue, used: DataFrame) -> tuple[Catalogue, DataFrame]:
    """Studios of the batch."""
    link = LINKS["studio"]
    if not _any(used.filter("e.has_studios")):
        return cat, _no_log(used)
    values, completeness = parsing.parse_studios(_entries(used, "studios"))
    values = materialise(values.withColumn("seq", F.struct("seq", "pos")), "studios")
    completeness = materialise(completeness, "complete")
    studio, resolved, remap = identity.resolve_studios(cat.studio, values)
    cat = replace(cat, studio=studio)
    if _any(remap):
        cat = cat.widened(link, remap.select(F.col("old_id").alias(link.ref)))
        links = identity.move_links(cat.anime_studio, remap, link.item, link.ref)
        cat = replace(cat, anime_studio=links)
    incoming = resolved.select(
        F.col("item_id").alias(link.item), F.col("ref_id").alias(link.ref)
    ).distinct()
    scope = _scope(completeness, link.item)
    actions = reconcile.reconcile_links(cat.anime_studio, incoming, scope, link)
    actions = materialise(actions, "actions")
    log = reconcile.link_changes(actions, completeness, link, "studio")
    return _relinked(cat, "anime_studio", actions, scope, link), log


def _apply_streaming(cat: Catalogue, used: DataFrame) -> tuple[Catalogue, DataFrame]:
    """Streaming services of the batch."""
    link = LINKS["streaming_service"]
    if not _any(used.filter("e.has_streaming")):
        return cat, _no_log(used)
    values, completeness = parsing.parse_streaming(_entries(used, "streaming"))
    values = materialise(values.withColumn("seq", F.struct("seq", "pos")), "streaming")
    completeness = materialise(completeness, "complete")
    incoming = values.select(
        F.col("item_id").alias(link.item), F.col("key").alias(link.ref), "url"
    )
    scope = _scope(completeness, link.item)
    links = cat.anime_streaming_service
    actions = materialise(reconcile.reconcile_links(links, incoming, scope, link, "url"), "actions")
    created = actions.filter("action = 'create'").select(
        F.col(link.item).alias("item_id"), F.col(link.ref).alias("key")
    )
    log = reconcile.link_changes(actions, completeness, link, "streaming_service")
    if _any(created):
        created = values.join(created, ["item_id", "key"], "left_semi")
        services = identity.resolve_services(cat.streaming_service, created)
        cat = replace(cat, streaming_service=services)
    return _relinked(cat, "anime_streaming_service", actions, scope, link), log


def _apply_authors(cat: Catalogue, used: DataFrame) -> tuple[Catalogue, DataFrame]:
    """Authors of the batch."""
    link = LINKS["author"]
    if not _any(used.filter("e.has_authors")):
        return cat, _no_log(used)
    values, completeness = parsing.parse_authors(_entries(used, "authors"))
    values = materialise(values.withColumn("seq", F.struct("seq", "pos")), "authors")
    completeness = materialise(completeness, "complete")
    author, resolved = identity.resolve_authors(cat.author, values)
    # Two names may mean one author; the later role then counts.
    incoming = resolved.groupBy(
        F.col("item_id").alias(link.item), F.col("ref_id").alias(link.ref)
    ).agg(F.max_by("role", "seq").alias("role"))
    scope = _scope(completeness, link.item)
    links = cat.manga_author
    actions = materialise(reconcile.reconcile_links(links, incoming, scope, link, "role"), "actions")
    log = reconcile.link_changes(actions, completeness, link, "author")
    return _relinked(replace(cat, author=author), "manga_author", actions, scope, link), log
