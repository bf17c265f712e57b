"""Which stored entity an incoming name means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelshelf.operators.ranking import global_rank
from reelshelf.session import materialise


def numbered(rows: DataFrame, dim: DataFrame, order: str, key: str = "id") -> DataFrame:
    """``rows`` with fresh ids above the largest id of ``dim``, in ``order``."""
    top = dim.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    ranked = global_rank(rows, [F.col(order).asc()])
    return ranked.withColumn(key, top + F.col("rank")).drop("rank")


def _latest(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    value = F.struct(*columns, "seq")
    return rows.groupBy(key).agg(F.max_by(value, "seq").alias("_v")).select(key, "_v.*")


# --- merge map ------------------------------------------------------------------


def canonical_ids(edges: DataFrame) -> DataFrame:
    """Final owner of every merged id: (old_id, new_id).

    ``edges`` says that row ``src`` is absorbed by row ``dst``. When owners are
    absorbed themselves, all connected rows end in the one that is absorbed by
    nothing, or in the smallest id when they form a ring.
    """
    edges = materialise(edges.distinct(), "edges")
    owners = edges.select(F.col("dst").alias("src"))
    chained = edges.join(owners, "src", "left_semi").limit(1).count()
    forked = edges.groupBy("src").count().filter("count > 1").limit(1).count()
    if not chained and not forked:
        return edges.select(F.col("src").alias("old_id"), F.col("dst").alias("new_id"))

    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    own = edges.select(F.col("src").alias("node"), F.lit(1).alias("absorbed")).unionByName(
        edges.select(F.col("dst").alias("node"), F.lit(0).alias("absorbed"))
    )
    own = own.groupBy("node").agg(F.max("absorbed").alias("absorbed"))
    labels = own.select("node", F.struct("absorbed", "node").alias("label"))
    labels = materialise(labels, "labels")
    while True:
        # Smallest label among the neighbours, then a jump to that label's label.
        near = (
            both.join(labels.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("_to"), F.col("label").alias("_there"))
        step = step.join(jump, F.col("label.node") == F.col("_to")).select(
            "node", F.least("label", "_there").alias("label"), "before"
        )
        step = materialise(step, "labels")
        labels = step.select("node", "label")
        if not step.filter("label <> before").limit(1).count():
            break
    return labels.filter("label.node <> node").select(
        F.col("node").alias("old_id"), F.col("label.node").alias("new_id")
    )


# --- studios ----------------------------------------------------------------------


def resolve_studios(dim: DataFrame, incoming: DataFrame):
    """Provider id first, then name; two rows for one studio merge.

    ``incoming`` has ``provider_id``, ``name``, ``key`` and an orderable
    ``seq``. Returns the new dimension, the same rows with ``ref_id``, and the
    map of merged ids. The batch rule: the last value of a provider id counts;
    it is matched against the stored rows by id, then by key.
    """
    with_id = _latest(incoming.filter("provider_id IS NOT NULL"), "provider_id", "name", "key")
    without_id = _latest(incoming.filter("provider_id IS NULL"), "key", "name")
    values = with_id.select("provider_id", "key", "name", "seq").unionByName(
        without_id.select(F.lit(None).cast("bigint").alias("provider_id"), "key", "name", "seq")
    )
    by_id = dim.filter("mal_id IS NOT NULL").select(
        F.col("mal_id").alias("provider_id"), F.col("id").alias("id_row")
    )
    by_name = dim.select(F.col("normalized_name").alias("key"), F.col("id").alias("name_row"))
    values = materialise(values.join(by_id, "provider_id", "left"), "values")

    keyed = values.groupBy("key").agg(
        F.max_by("id_row", F.when(F.col("id_row").isNotNull(), F.col("seq"))).alias("id_row"),
        F.min_by("provider_id", F.when(F.col("provider_id").isNotNull(), F.col("seq"))).alias(
            "first_provider"
        ),
        F.max_by("name", "seq").alias("last_name"),
    )
    keyed = keyed.join(by_name, "key", "left").withColumn("target", F.coalesce("id_row", "name_row"))
    keyed = materialise(keyed, "keys")

    other = values.filter("id_row IS NOT NULL").select("key", F.col("id_row").alias("src"))
    targets = keyed.filter("target IS NOT NULL").select("key", F.col("target").alias("dst"))
    edges = keyed.select(F.col("name_row").alias("src"), F.col("target").alias("dst")).unionByName(
        other.join(targets, "key").select("src", "dst")
    )
    remap = materialise(canonical_ids(edges.filter("src <> dst")), "remap")

    fresh = numbered(keyed.filter("target IS NULL").select("key", "first_provider", "last_name"), dim, "key")
    fresh = materialise(fresh, "fresh")
    owner = _remapped(keyed.filter("target IS NOT NULL"), remap, "target").select("key", "target")
    owner = owner.unionByName(fresh.select("key", F.col("id").alias("target")))

    # Name and id that each surviving row takes over; id-matched values win.
    strength = F.struct(F.col("provider_id").isNotNull(), "seq")
    adopted = (
        values.join(owner, "key")
        .groupBy(F.col("target").alias("id"))
        .agg(
            F.max_by(F.struct("name", "key"), strength).alias("_best"),
            F.min_by("provider_id", F.when(F.col("provider_id").isNotNull(), F.col("seq"))).alias(
                "_provider"
            ),
        )
    )
    survivors = dim.join(remap, dim["id"] == remap["old_id"], "left_anti").join(adopted, "id", "left")
    kept = survivors.select(
        "id",
        F.coalesce("mal_id", "_provider").alias("mal_id"),
        F.coalesce("_best.name", "name").alias("name"),
        F.coalesce("_best.key", "normalized_name").alias("normalized_name"),
    )
    added = fresh.join(adopted, "id").select(
        "id",
        F.col("first_provider").alias("mal_id"),
        F.col("_best.name").alias("name"),
        F.col("key").alias("normalized_name"),
    )
    # A provider id stands for its last key, also in titles that spelled it otherwise.
    owner_of_id = values.filter("provider_id IS NOT NULL").join(owner, "key").select(
        "provider_id", F.col("target").alias("ref_id")
    )
    resolved = (
        incoming.filter("provider_id IS NOT NULL")
        .join(owner_of_id, "provider_id")
        .unionByName(
            incoming.filter("provider_id IS NULL").join(
                owner.withColumnRenamed("target", "ref_id"), "key"
            )
        )
    )
    return kept.unionByName(added), resolved, remap


def _remapped(rows: DataFrame, remap: DataFrame, column: str) -> DataFrame:
    """``rows`` with merged ids of ``column`` replaced by their owner."""
    joined = rows.join(remap, F.col(column) == F.col("old_id"), "left")
    return joined.withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def move_links(links: DataFrame, remap: DataFrame, item: str, ref: str) -> DataFrame:
    """Links of merged entities moved to their owner, duplicates dropped.

    Only moved links are compared, so the bulk of the table is passed through.
    """
    merged = remap.select(F.col("old_id").alias(ref), "new_id")
    stay = links.join(merged.select(ref), ref, "left_anti").select(*links.columns)
    moved = links.join(merged, ref).select(item, F.col("new_id").alias(ref)).distinct()
    present = stay.join(moved, [item, ref], "left_semi").select(item, ref)
    return stay.unionByName(moved.join(present, [item, ref], "left_anti").select(*links.columns))


# --- services and authors -------------------------------------------------------------


def resolve_services(dim: DataFrame, created: DataFrame) -> DataFrame:
    """Services by key; the last name of a newly created link is shown.

    ``created`` has ``key``, ``name`` and ``seq`` of links that did not exist.
    """
    latest = _latest(created, "key", "name").select(
        F.col("key").alias("normalized_name"), F.col("name").alias("_name")
    )
    return dim.join(latest, "normalized_name", "full_outer").select(
        F.coalesce("_name", "name").alias("name"), "normalized_name"
    )


def resolve_authors(dim: DataFrame, incoming: DataFrame):
    """Name first, then provider id; rows are never merged.

    Returns the new dimension and ``incoming`` with ``ref_id``. A row found by
    id takes the new name only because no stored row owns it; a missing id is
    filled unless another row has it.
    """
    provider = F.min_by("provider_id", F.when(F.col("provider_id").isNotNull(), F.col("seq")))
    keyed = incoming.groupBy("key").agg(
        provider.alias("provider_id"), F.max_by("name", "seq").alias("name"), F.max("seq").alias("seq")
    )
    by_name = dim.select(F.col("normalized_name").alias("key"), F.col("id").alias("name_row"))
    by_id = dim.filter("mal_id IS NOT NULL").select(
        F.col("mal_id").alias("provider_id"), F.col("id").alias("id_row")
    )
    keyed = keyed.join(by_name, "key", "left").join(by_id, "provider_id", "left")
    keyed = materialise(keyed.withColumn("target", F.coalesce("name_row", "id_row")), "authors")

    # Unknown names of one provider id are one new author under its last name.
    group = F.coalesce(F.concat(F.lit("id:"), F.col("provider_id").cast("string")), F.concat(F.lit("key:"), F.col("key")))
    unknown = keyed.filter("target IS NULL").withColumn("_group", group)
    fresh = unknown.groupBy("_group").agg(
        F.max_by(F.struct("key", "name"), "seq").alias("_last"), F.max("provider_id").alias("first_provider")
    )
    fresh = fresh.select("_group", "_last.key", "_last.name", "first_provider")
    fresh = materialise(numbered(fresh, dim, "key"), "fresh")
    owner = keyed.filter("target IS NOT NULL").select("key", F.col("target").alias("ref_id")).unionByName(
        unknown.join(fresh.select("_group", "id"), "_group").select("key", F.col("id").alias("ref_id"))
    )

    adopted = keyed.filter("target IS NOT NULL").groupBy(F.col("target").alias("id")).agg(
        F.max_by(F.struct("name", "key"), "seq").alias("_best"),
        # Only ids that no stored row owns may fill a gap.
        F.min_by("provider_id", F.when(F.col("id_row").isNull() & F.col("provider_id").isNotNull(), F.col("seq"))).alias("_provider"),
    )
    kept = dim.join(adopted, "id", "left").select(
        "id",
        F.coalesce("mal_id", "_provider").alias("mal_id"),
        F.coalesce("_best.name", "name").alias("name"),
        F.coalesce("_best.key", "normalized_name").alias("normalized_name"),
    )
    added = fresh.select(
        "id", F.col("first_provider").alias("mal_id"), "name", F.col("key").alias("normalized_name")
    )
    return kept.unionByName(added), incoming.join(owner, "key")
