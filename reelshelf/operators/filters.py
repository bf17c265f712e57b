"""Row filters and semi/anti joins of a catalogue query (C, D)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.schemas import ANIME, LINKS, MANGA, Link, Medium
from reelshelf.session import broadcast_if_small


def public(items: DataFrame) -> DataFrame:
    """A3: titles that may be shown."""
    return items.filter(~F.col("is_adult"))


def scope(manga: DataFrame, content_types: frozenset[str]) -> DataFrame:
    """Print rows of the requested content types."""
    wanted = sorted(content_types & set(fv.PRINT_TYPES.values()))
    return manga.filter(F.col("content_type").isin(wanted))


def search(items: DataFrame, q: str) -> DataFrame:
    """Case-insensitive literal substring of either title."""
    if not q:
        return items
    needle = F.lower(F.lit(q))
    hit = F.contains(F.lower("title"), needle)
    other = F.contains(F.lower("alternative_title"), needle)
    return items.filter(hit | other)


def between(items: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range; NULL passes only when no bound is set."""
    if low is not None:
        items = items.filter(F.col(column) >= low)
    if high is not None:
        items = items.filter(F.col(column) <= high)
    return items


def one_of(items: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Membership in normalised values; no values means no filter."""
    return items.filter(F.col(column).isin(*values)) if values else items


def print_status(items: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Stored label compared without case or outer spaces."""
    if not values:
        return items
    return items.filter(F.lower(F.trim("status")).isin(*values))


def _matching_links(links: DataFrame, dim: DataFrame, link: Link, names) -> DataFrame:
    # The dimension shrinks to the requested names first. Its size is probed
    # before it is broadcast, so the link table normally needs no shuffle here
    # and an entity holding a third of all links stays spread over its splits.
    wanted = dim.filter(F.col(link.match).isin(*names)).select(
        F.col(link.dimension_key).alias(link.ref), F.col(link.match).alias("_name")
    )
    return links.select(link.item, link.ref).join(broadcast_if_small(wanted), link.ref)


def with_all(items, links, dim, link: Link, names: tuple[str, ...]) -> DataFrame:
    """Titles linked to every requested name."""
    if not names:
        return items
    matches = _matching_links(links, dim, link, names)
    if len(set(names)) > 1:
        # One flag per name: a single shuffle, combined to a row per title and task.
        hits = [F.bool_or(F.col("_name") == n).alias(f"_h{i}") for i, n in enumerate(names)]
        all_hit = reduce(and_, [F.col(f"_h{i}") for i in range(len(names))])
        matches = matches.groupBy(link.item).agg(*hits).filter(all_hit)
    return items.join(matches.select(link.item), link.item, "left_semi")


def with_any(items, links, dim, link: Link, names: tuple[str, ...]) -> DataFrame:
    """Titles linked to at least one requested name."""
    if not names:
        return items
    matches = _matching_links(links, dim, link, names).select(link.item)
    return items.join(matches, link.item, "left_semi")


def without(items, links, dim, link: Link, names: tuple[str, ...]) -> DataFrame:
    """Titles linked to none of the requested names."""
    if not names:
        return items
    matches = _matching_links(links, dim, link, names).select(link.item)
    return items.join(matches, link.item, "left_anti")


def with_tags(items: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """D3: tag array holds every requested tag."""
    return items.filter(reduce(and_, map(_has_tag, tags))) if tags else items


def without_tags(items: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Tag array holds none of the requested tags; a NULL array fails."""
    if not tags:
        return items
    return items.filter(reduce(and_, [~_has_tag(t) for t in tags]))


def _has_tag(tag: str) -> Column:
    # A NULL element would turn "not found" into NULL and lose the row.
    return F.array_contains(F.array_compact("genres_detailed"), tag)


def common(items: DataFrame, spec, cat, medium: Medium) -> DataFrame:
    """Filters that every medium shares."""
    links, dim = getattr(cat, medium.genre_links), cat.genre
    link = LINKS[medium.genre_links]
    out = search(items, spec.q)
    out = between(out, "score", spec.min_score)
    out = between(out, medium.year, spec.min_year, spec.max_year)
    out = with_tags(out, spec.tags)
    out = without_tags(out, spec.excluded_tags)
    out = with_all(out, links, dim, link, spec.genres)
    return without(out, links, dim, link, spec.excluded_genres)


def anime(cat, spec) -> DataFrame:
    """Public anime rows that satisfy ``spec``."""
    out = public(cat.anime)
    out = between(out, "episodes", spec.min_episodes, spec.max_episodes)
    out = one_of(out, "type", spec.types)
    out = one_of(out, "season", spec.seasons)
    if "ANIME" in spec.content_types:
        out = one_of(out, "status", spec.statuses)
    out = common(out, spec, cat, ANIME)
    out = with_any(out, cat.anime_studio, cat.studio, LINKS["studio"], spec.studios)
    return with_any(
        out,
        cat.anime_streaming_service,
        cat.streaming_service,
        LINKS["streaming_service"],
        spec.streaming_services,
    )


def manga(cat, spec) -> DataFrame:
    """Public print rows that satisfy ``spec``."""
    out = scope(public(cat.manga), spec.effective_scope)
    out = between(out, "chapters", spec.min_chapters, spec.max_chapters)
    out = between(out, "volumes", spec.min_volumes, spec.max_volumes)
    if "ANIME" not in spec.content_types:
        out = print_status(out, spec.statuses)
    out = common(out, spec, cat, MANGA)
    return with_any(out, cat.manga_author, cat.author, LINKS["author"], spec.authors)
