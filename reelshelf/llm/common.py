"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelshelf.session import materialise

# A key that holds more than one in this many rows is joined by broadcast.
HEAVY_SHARE = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str = "n_rows") -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per ``key``) that no hot key can slow.

    ``groups`` should be a stored table; its column ``size`` counts the rows of
    each key. At most ``HEAVY_SHARE`` keys can hold more than one in
    ``HEAVY_SHARE`` of all counted rows, so those are broadcast. Their rows then
    take part in the shuffle join under a key of their own that matches nothing,
    so they are dealt out evenly. Rows without a key match nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    values = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * HEAVY_SHARE > F.lit(total)).select(
        F.col(key).alias("_heavy_key"), F.struct(*values).alias("_heavy")
    )
    light = groups.where(F.col(size) * HEAVY_SHARE <= F.lit(total)).select(
        F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("salt")).alias("_join_key"),
        F.struct(*values).alias("_light"),
    )
    # Salts start at one, so a salted row can never meet a group.
    salt = F.monotonically_increasing_id() + 1
    marked = rows.join(F.broadcast(heavy), rows[key] == F.col("_heavy_key"), "left").withColumn(
        "_join_key",
        F.struct(
            F.col(key).alias("k"),
            F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(salt).alias("salt"),
        ),
    )
    joined = marked.join(light, "_join_key", "left")
    pick = [F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in values]
    return joined.select(*[rows[c] for c in rows.columns], *pick)


def running_total(df: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all earlier rows, within ``by`` if given.

    The rows are dealt by range of (by, order), summed inside each range, and the
    ranges are offset by the totals of those before them. No group meets in one
    task: only one total per range and group does.
    """
    spark, by = df.sparkSession, by or []
    keys = by + order
    dealt = materialise(
        df.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    sums = dealt.groupBy("_range", *by).agg(F.sum(value).alias("_sum"))
    ranges = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_range").alias("_r"),
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.coalesce(F.sum("_sum").over(ranges), F.lit(0).cast("long")).alias("_offset"),
    )
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    match = [local["_range"] == offsets["_r"]] + [local[c].eqNullSafe(offsets[f"_by_{c}"]) for c in by]
    return local.join(offsets, match).select(
        *[local[c] for c in df.columns], (F.col("_local") + F.col("_offset")).alias("before")
    )


def merge_labels(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Give linked positions the smallest label among them; ``labels[i]`` indexes a root."""
    parent = labels.copy()
    while True:
        while True:  # point every entry at its root
            deeper = parent[parent]
            if np.array_equal(deeper, parent):
                break
            parent = deeper
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])


def components(edges: DataFrame, smaller: str = "a", larger: str = "b") -> DataFrame:
    """Smallest vertex reachable from each linked vertex: rows (vertex, component_id).

    Alternating star contraction: large stars hang every larger neighbour of a
    vertex on the smallest one, small stars do so for the smaller neighbours. The
    edge list never grows, and the rounds are logarithmic in the longest chain.
    Hubs are joined through ``attach``. Each round is a stored table.
    """

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = materialise(df.distinct(), "links")
        mark = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return table, tuple(mark)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        pairs = down.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else down
        hubs = materialise(pairs.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n_rows")), "hubs")
        near = attach(pairs, hubs, "u").withColumn("low", F.least("u", "low"))
        if large:
            moved = near.where(F.col("v") > F.col("u")).select(F.col("low").alias("a"), F.col("v").alias("b"))
        else:
            moved = near.select(F.col("low").alias("a"), F.col("v").alias("b")).unionByName(
                hubs.select(F.col("low").alias("a"), F.col("u").alias("b"))
            )
        return moved.where(F.col("a") < F.col("b"))

    first = edges.select(F.least(smaller, larger).alias("a"), F.greatest(smaller, larger).alias("b"))
    table, mark = stored(first.where(F.col("a") < F.col("b")))
    while mark[0]:
        table, new = stored(star(stored(star(table, True))[0], False))
        if new == mark:
            break
        mark = new
    roots = table.select(F.col("a").alias("component_id")).distinct()
    return table.select(F.col("b").alias("vertex"), F.col("a").alias("component_id")).unionByName(
        roots.select(F.col("component_id").alias("vertex"), "component_id")
    )
