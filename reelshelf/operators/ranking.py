"""Sorts, paging, top-k and random selection (F)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.session import materialise

# Beyond this many leading rows a top-k heap per task is no longer cheap.
TOP_K_ROWS = 100_000
# Places drawn in each round of a selection; they are the only rows that reach the driver.
SELECT_SAMPLE = 1024


class Key(NamedTuple):
    """One key of an order. Descending keys are numbers or flags; NaN does not occur."""

    column: Column
    descending: bool = False
    nulls_first: bool = False

    @property
    def order(self) -> Column:
        if self.descending:
            return self.column.desc_nulls_first() if self.nulls_first else self.column.desc_nulls_last()
        return self.column.asc_nulls_first() if self.nulls_first else self.column.asc_nulls_last()

    @property
    def rising(self) -> list[Column]:
        """Columns whose plain ascending order is the order of this key."""
        empty = self.column.isNotNull() if self.nulls_first else self.column.isNull()
        return [empty, -self.column if self.descending else self.column]


def sort_keys(sort: str) -> list[Key]:
    """total order of identity rows; the last keys break every tie."""
    score = Key(F.col("score"), descending=True)
    title = [Key(F.lower("title")), Key(F.col("title"))]
    first = {
        "newest": Key(F.col("year"), descending=True),
        "oldest": Key(F.col("year")),
        "most_popular": Key(F.col("popularity")),
        "most_members": Key(F.col("members"), descending=True),
        "most_episodes": Key(F.col("length"), descending=True),
        "most_chapters": Key(F.col("length"), descending=True),
    }
    if sort == "title":
        head = [*title, score]
    elif sort in first:
        head = [first[sort], score, *title]
    else:
        head = [score, *title]
    return [*head, Key(F.col("content_type")), Key(F.col("mal_id")), Key(F.col("record_id"))]


def order_keys(sort: str) -> list[Column]:
    return [k.order for k in sort_keys(sort)]


def seasonal_keys(sort: str) -> list[Key]:
    """order of a seasonal list; the record id makes it total."""
    popularity = Key(F.col("popularity"))
    members = Key(F.col("members"), descending=True)
    score = Key(F.col("score"), descending=True)
    head = {
        "most_popular": [popularity, members, score],
        "most_members": [members, popularity, score],
        "top_rated": [score],
    }[sort]
    return [*head, Key(F.col("title")), Key(F.col("anime_id"))]


def slice_rows(rows: DataFrame, keys: list[Key], offset: int, limit: int, top_k: int = TOP_K_ROWS) -> DataFrame:
    """rows ``offset + 1`` to ``offset + limit`` with their global ``rank``.

    Shallow slices are a top-k: every task keeps only the leading rows. Deep
    slices, beyond ``top_k`` rows, are first narrowed to the part of the order
    that holds them by :func:`narrowed`, so the skipped rows are only counted.
    """
    before = 0
    if offset + limit > top_k:
        rows, before = narrowed(rows, keys, offset, offset + limit, top_k)
    order = [k.order for k in keys]
    page = rows.orderBy(*order).offset(offset - before).limit(limit)
    # At most ``limit`` rows are left, so one partition may number them.
    number = F.row_number().over(Window.orderBy(*order))
    return page.withColumn("rank", (number + offset).cast("bigint"))


def narrowed(
    rows: DataFrame, keys: list[Key], first: int, last: int, room: int, sample: int = SELECT_SAMPLE
) -> tuple[DataFrame, int]:
    """Part of the order that holds the rows behind the leading ``first`` up to ``last``.

    Also returns how many rows lie before that part. Each round draws about
    ``sample`` places of the part, picks two around the slice, and counts the
    rows up to either; a place that would cut into the slice is not used. Rounds
    end when at most ``room`` rows are left, or when equal rows leave no narrower
    part. Nothing is shuffled but counts and drawn places, and nothing is written;
    the bound on the leading key reaches the scan.
    """
    place = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(c for k in keys for c in k.rising)])
    slack = 2 * math.isqrt(sample) + 1
    low = high = None
    part, before, size, turn = rows, 0, rows.count(), 0
    while size > room:
        ticket = F.pmod(F.xxhash64("_place", F.lit(turn)), F.lit(1 << 40))
        drawn = part.select(place.alias("_place")).filter(ticket < int((1 << 40) * min(1.0, sample / size)))
        types = drawn.schema["_place"].dataType
        places = [r[0] for r in drawn.distinct().orderBy("_place").collect()]
        share = len(places) / size
        start = math.floor((first - before) * share) - slack
        end = math.ceil((last - before) * share) + slack
        lower = places[start] if 0 <= start < len(places) else low
        upper = places[end] if 0 <= end < len(places) else high
        up_to = [F.lit(False) if p is None else place <= _literal(p, types) for p in (lower, upper)]
        below, within = part.agg(*[F.count_if(c) for c in up_to]).first()
        if lower is low or below > first - before:
            lower, below = low, 0
        if upper is high or within < last - before:
            upper, within = high, size
        if within - below == size:
            break
        low, high, before, size, turn = lower, upper, before + below, within - below, turn + 1
        part = rows
        if low is not None:
            part = part.filter(_lead(keys[0], low[1], True)).filter(place > _literal(low, types))
        if high is not None:
            part = part.filter(_lead(keys[0], high[1], False)).filter(place <= _literal(high, types))
    return part, before


def _literal(row, types) -> Column:
    values = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, types.fields, strict=True)]
    return F.struct(*values)


def _lead(key: Key, value, above: bool) -> Column:
    """Implied by a bound on the whole order, in a form that the file scan can use."""
    if value is None:
        return F.lit(True)
    if key.descending:
        value = -value
    near = key.column >= value if above != key.descending else key.column <= value
    # Rows without the key lie before all others, or behind them.
    return near | key.column.isNull() if above != key.nulls_first else near


def global_rank(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Number every row of a total order without a single-partition window.

    Rows are range-partitioned by the full key, so equal leading values spread
    over many tasks. Each row's position inside its task is stored once; only
    one count per task is summed up and joined back.
    """
    slot = F.monotonically_increasing_id()
    placed = (
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_slot", slot)
    )
    placed = materialise(placed, "rank")
    task = F.shiftright("_slot", 33)
    # One row per task of the sort: bounded by the shuffle partition count.
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    starts = sizes.select("_task", before.alias("_before"))
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_task", task)
        .join(F.broadcast(starts), "_task")
        .withColumn("rank", F.col("_before") + within + 1)
        .drop("_task", "_slot", "_before")
    )


def after(rows: DataFrame, sort: str, last: dict, limit: int) -> DataFrame:
    """Keyset paging: the ``limit`` rows that follow identity row ``last``.

    Unlike an offset, the predicate lets the scan skip all earlier rows.
    """
    values = {
        "score": (F.col("score"), last["score"], True),
        "title": (F.col("title"), last["title"], False),
        "lower": (F.lower("title"), last["title"], False),
        "content_type": (F.col("content_type"), last["content_type"], False),
        "mal_id": (F.col("mal_id"), last["mal_id"], False),
        "record_id": (F.col("record_id"), last["record_id"], False),
    }
    lead = {
        "newest": ("year", True),
        "oldest": ("year", False),
        "most_popular": ("popularity", False),
        "most_members": ("members", True),
        "most_episodes": ("length", True),
        "most_chapters": ("length", True),
    }
    tail = ["content_type", "mal_id", "record_id"]
    if sort == "title":
        names = ["lower", "title", "score", *tail]
    else:
        names = ["score", "lower", "title", *tail]
    keys = [values[n] for n in names]
    if sort in lead:
        column, descending = lead[sort]
        keys.insert(0, (F.col(column), last[column], descending))
        names.insert(0, column)

    lead_column, lead_value, lead_descending = keys[0]
    if lead_value is not None and names[0] != "lower":
        # Implied by the test below, but in a form the file scan can use.
        near = lead_column <= lead_value if lead_descending else lead_column >= lead_value
        rows = rows.filter(near | lead_column.isNull())
    follows, tied = F.lit(False), F.lit(True)
    for name, (c, value, descending) in zip(names, keys):
        if value is None:
            # NULL sorts last: nothing follows it on this key.
            later, same = F.lit(False), c.isNull()
        else:
            bound = F.lower(F.lit(value)) if name == "lower" else F.lit(value)
            later = F.coalesce(c < bound if descending else c > bound, F.lit(True))
            same = F.coalesce(c == bound, F.lit(False))
        follows = follows | (tied & later)
        tied = tied & same
    return rows.filter(follows).orderBy(*order_keys(sort)).limit(limit)


def random_sample(
    rows: DataFrame, limit: int, seed: int, share: float = fv.RANDOM_SAMPLE_FRACTION
) -> DataFrame:
    """F8: small random pick from a sample of the rows, two percent by default.

    A digest of type, id and seed decides, so the pick is the same on any cluster.
    """
    number = F.col("record_id").cast("string")
    digest = F.sha2(F.concat_ws("-", "content_type", number, F.lit(str(seed))), 256)
    if share < 1:
        rows = rows.filter(digest < f"{int(share * 2**32):08x}")
    return rows.orderBy(digest).limit(limit)


def random_window(rows: DataFrame, pivot: int, limit: int) -> DataFrame:
    """ids from ``pivot`` upwards, then wrapping to the smallest ids."""
    keys = [Key(F.col("record_id")), Key(F.col("content_type"))]
    order = [k.order for k in keys]
    # Two seeks with a bound that the scan can use, each a top-k.
    ahead = rows.filter(F.col("record_id") >= pivot).orderBy(*order).limit(limit)
    wrapped = rows.filter(F.col("record_id") < pivot).orderBy(*order).limit(limit)
    return slice_rows(ahead.unionByName(wrapped), [Key(F.col("record_id") < pivot), *keys], 0, limit)


def id_bounds(rows: DataFrame) -> DataFrame:
    """candidate range for the random pivot."""
    return rows.agg(F.min("record_id").alias("min_id"), F.max("record_id").alias("max_id"))


def work_queue(items: DataFrame, attempt: str, key: str, limit: int) -> DataFrame:
    """rows never attempted first, then the oldest attempts."""
    keys = [Key(F.col(attempt), nulls_first=True), Key(F.col(key))]
    return slice_rows(items, keys, 0, limit)


def explicit_queue(items: DataFrame, mal_ids: list[int]) -> DataFrame:
    """the named titles, ordered by provider id."""
    chosen = items.filter(F.col("mal_id").isin(list(mal_ids)))
    return slice_rows(chosen, [Key(F.col("mal_id"))], 0, max(1, len(mal_ids)))


def season_queue(anime: DataFrame, limit: int) -> DataFrame:
    """TV titles that still need a season."""
    waiting = anime.filter(
        F.col("season").isNull() & (F.col("mal_id") > 0) & (F.upper("type") == "TV")
    )
    return work_queue(waiting, "last_season_attempt", "anime_id", limit)


def unlinked(items: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Titles without any link."""
    return items.join(links.select(key), key, "left_anti")


def streaming_queue(anime: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """public provider titles without a streaming link."""
    open_ids = anime.filter(~F.col("is_adult") & (F.col("mal_id") > 0))
    waiting = unlinked(open_ids, links, "anime_id")
    return work_queue(waiting, "last_streaming_attempt", "anime_id", limit)
