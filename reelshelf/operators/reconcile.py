"""Stored links against incoming links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.schemas import Link


def reconcile_links(
    current: DataFrame,
    incoming: DataFrame,
    scope: DataFrame,
    link: Link,
    attr: str | None = None,
) -> DataFrame:
    """One row per (title, entity) with an ``action``.

    ``scope`` lists the titles whose payload had the field as a list, with
    ``complete``. Titles outside it keep everything and are not read further.
    Actions: create, keep, update (the link attribute changed), remove, and
    retain (absent from an incomplete list, so it stays).
    """
    keys = [link.item, link.ref]
    stored = current.join(scope, link.item).withColumn("_stored", F.lit(True))
    wanted = incoming.withColumn("_wanted", F.lit(True))
    if attr:
        wanted = wanted.withColumnRenamed(attr, "_new")
    # (title, entity) pairs are unique on both sides, so no key is hot.
    both = stored.join(wanted, keys, "full_outer")
    action = F.when(F.col("_stored").isNull(), "create").when(
        F.col("_wanted").isNull(), F.when(F.col("complete"), "remove").otherwise("retain")
    )
    if attr:
        action = action.when(~F.col("_new").eqNullSafe(F.col(attr)), "update")
    out = both.withColumn("action", action.otherwise("keep"))
    if not attr:
        return out.select(*keys, "action")
    value = F.when(F.col("action").isin("create", "update"), F.col("_new")).otherwise(F.col(attr))
    return out.select(*keys, value.alias(attr), "action")


def apply_actions(current: DataFrame, actions: DataFrame, scope: DataFrame, link: Link) -> DataFrame:
    """The link table after ``actions``; titles outside ``scope`` pass through."""
    untouched = current.join(scope.select(link.item), link.item, "left_anti")
    kept = actions.filter(F.col("action") != "remove").select(*current.columns)
    return untouched.select(*current.columns).unionByName(kept)


def link_changes(actions: DataFrame, completeness: DataFrame, link: Link, entity: str) -> DataFrame:
    """Change-log rows of one entity kind, one per processed title."""
    counted = actions.groupBy(link.item).agg(
        F.count_if(F.col("action") == "create").alias("created"),
        F.count_if(F.col("action") == "remove").alias("removed"),
        F.count_if(F.col("action") == "update").alias("changed"),
    )
    out = completeness.withColumnRenamed("item_id", link.item).join(counted, link.item, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("created", "removed", "changed")]
    return out.select(
        F.lit(entity).alias("entity"), F.col(link.item).alias("item_id"), *zero, "malformed"
    )


def reconcile_genres(
    dim: DataFrame, wanted: DataFrame, replace_empty: bool, link: Link
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scope, named links, new genre names) of titles with genre lists.

    ``wanted`` has ``item_id``, ``genres`` and ``has_genres``. Anime keep their
    links when the list is empty; print titles are cleared by it.
    """
    applies = F.col("has_genres") if replace_empty else F.size("genres") > 0
    titles = wanted.filter(applies)
    scope = titles.select(F.col("item_id").alias(link.item), F.lit(True).alias("complete"))
    named = titles.select(
        F.col("item_id").alias(link.item), F.explode("genres").alias("name")
    )
    known = named.select("name").distinct().join(dim.select("name"), "name", "left_anti")
    return scope, named, known
