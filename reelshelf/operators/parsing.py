"""Provider objects to typed columns, and entity arrays to rows (H, I6-I8).

After this step no VARIANT is left, so the rows can be shuffled, aggregated
and stored cheaply. ``has_x`` columns remember whether a field was present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions import payload as p
from reelshelf.functions import text
from reelshelf.session import materialise


_COMMON = (
    "mal_id",
    "title",
    "title_english",
    "title_japanese",
    "synopsis",
    "type",
    "status",
    "score",
    "popularity",
    "members",
    "url",
    "images",
    "rating",
    *fv.TAG_FIELDS,
)
_ANIME = (*_COMMON, "season", "aired", "year", "episodes", "relations", "studios", "streaming")
_MANGA = (*_COMMON, "published", "chapters", "volumes", "authors")


def _fields(v: p.Fields) -> dict[str, Column]:
    return {
        "mal_id": p.provider_id(v),
        "_rated": p.adult_rating(v),
        "title": p.filled(v, "title"),
        "alternative_title": F.coalesce(p.filled(v, "title_english"), p.filled(v, "title_japanese")),
        "has_synopsis": p.has(v, "synopsis"),
        "synopsis": text.blank_to_null(p.string(v, "synopsis")),
        "has_type": p.has(v, "type"),
        "type_missing": ~p.given(v, "type"),
        "raw_type": p.string(v, "type"),
        "has_score": p.has(v, "score"),
        "score": p.score(v),
        "popularity": p.metric(v, "popularity"),
        "members": p.metric(v, "members"),
        "url": p.filled(v, "url"),
        "image_url": p.image_url(v),
        **{f"_{name}": p.names(v, name) for name in fv.TAG_FIELDS},
    }


def _bad_id(e: Column) -> Column:
    return p.given(e, "mal_id") & p.provider_id(e).isNull()


def _entity(e: Column, *extra: Column) -> Column:
    return F.struct(
        p.provider_id(e).alias("provider_id"),
        _bad_id(e).alias("bad_id"),
        p.string(e, "name").alias("name"),
        *extra,
    )


def clean_anime(rows: DataFrame, entry: str = "entry") -> DataFrame:
    """Typed columns of anime objects; the other columns pass through."""
    v = p.Fields(F.col(entry))
    fields = _fields(v) | {
        "status": text.anime_status(p.string(v, "status")),
        "season_named": text.season(p.string(v, "season")),
        "season_aired": p.air_season(v),
        "has_year": p.has(v, "year"),
        "year": p.raw_int(v, "year"),
        "has_episodes": p.has(v, "episodes"),
        "episodes": p.raw_int(v, "episodes"),
        "has_relations": p.has(v, "relations"),
        "sequel": p.has_sequel(v),
        "has_studios": p.has(v, "studios"),
        "studios": F.transform(p.array(v, "studios"), lambda e: _entity(e)),
        "has_streaming": p.has(v, "streaming"),
        "streaming": F.transform(
            p.array(v, "streaming"),
            lambda e: _entity(e, text.safe_url(p.string(e, "url")).alias("url")),
        ),
    }
    return _select(rows, entry, _ANIME, fields)


def clean_manga(rows: DataFrame, entry: str = "entry") -> DataFrame:
    """Typed columns of print objects; the other columns pass through."""
    v = p.Fields(F.col(entry))
    tagged = p.has(v, fv.TAG_FIELDS[0])
    for name in fv.TAG_FIELDS[1:]:
        tagged = tagged | p.has(v, name)
    fields = _fields(v) | {
        "has_published": p.has(v, "published"),
        "publication_year": p.publication_year(v),
        "has_status": p.has(v, "status"),
        "status": text.blank_to_null(p.string(v, "status")),
        "has_chapters": p.has(v, "chapters"),
        "chapters": p.raw_int(v, "chapters"),
        "has_volumes": p.has(v, "volumes"),
        "volumes": p.raw_int(v, "volumes"),
        "has_genres": p.has(v, "genres"),
        "has_tags": tagged,
        "has_authors": p.has(v, "authors"),
        "authors": F.transform(
            p.array(v, "authors"), lambda e: _entity(e, p.author_role(e).alias("role"))
        ),
    }
    return _select(rows, entry, _MANGA, fields)


def _select(rows: DataFrame, entry: str, names, fields: dict[str, Column]) -> DataFrame:
    kept = [c for c in rows.columns if c != entry and c not in fields]
    rows = rows.withColumn(entry, p.open_object(F.col(entry), names))
    rows = rows.select(*kept, *[c.alias(n) for n, c in fields.items()])
    # The name lists are shared, so they are built one step earlier.
    lists = [f"_{name}" for name in fv.TAG_FIELDS]
    rows = rows.withColumn("tags", p.detailed_tags(lists)).withColumnRenamed("_genres", "genres")
    rows = rows.withColumn("is_adult", p.is_adult(F.col("tags"), F.col("_rated")))
    return rows.drop("_rated", *lists)


# --- entity arrays ------------------------------------------------------------


def _named(rows: DataFrame, field: str, max_length: int, key_length: int | None) -> DataFrame:
    """One row per array element with display name, key and a defect count.

    ``rows`` needs ``item_id`` and ``seq``, the order of the titles.
    """
    out = rows.select("item_id", "seq", F.posexplode(field).alias("pos", "e"))
    out = out.select(
        "*",
        text.entity_name(F.col("e.name"), max_length).alias("name"),
        text.entity_key(F.col("e.name"), key_length).alias("key"),
    )
    # Read twice below, and the names may have gone through Python.
    return materialise(out, field)


def _first(rows: DataFrame, order: Column, *columns: str) -> DataFrame:
    entry = F.struct(*columns)
    best = rows.groupBy("item_id", "key").agg(F.min_by(entry, order).alias("_b"))
    return best.select("item_id", "key", "_b.*")


def _complete(rows: DataFrame, field: str, defects: DataFrame) -> DataFrame:
    """Per title with the field: whether it is a list, and how many defects."""
    listed = rows.filter(f"has_{field}").select("item_id", F.col(field).isNotNull().alias("is_list"))
    out = listed.join(defects, "item_id", "left")
    malformed = F.when(F.col("is_list"), F.coalesce("malformed", F.lit(0))).otherwise(1)
    return out.select(
        "item_id",
        "is_list",
        malformed.cast("bigint").alias("malformed"),
        (F.col("is_list") & (malformed == 0)).alias("complete"),
    )


def _defects(rows: DataFrame, usable: Column, bad_id: Column) -> DataFrame:
    count = F.count_if(~usable) + F.count_if(usable & bad_id)
    return rows.groupBy("item_id").agg(count.alias("malformed"))


def parse_studios(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Studios per title, first spelling of a key wins; and completeness."""
    named = _named(rows, "studios", fv.ENTITY_NAME_LENGTH, fv.ENTITY_NAME_LENGTH)
    usable = F.col("name").isNotNull() & F.col("key").isNotNull()
    named = named.withColumn("provider_id", F.col("e.provider_id"))
    values = _first(named.filter(usable), F.col("pos"), "seq", "pos", "provider_id", "name")
    return values, _complete(rows, "studios", _defects(named, usable, F.col("e.bad_id")))


def parse_streaming(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services per title; an entry needs a name and a safe URL."""
    named = _named(rows, "streaming", fv.ENTITY_NAME_LENGTH, fv.ENTITY_NAME_LENGTH)
    named = named.withColumn("url", F.col("e.url"))
    usable = F.col("name").isNotNull() & F.col("key").isNotNull() & F.col("url").isNotNull()
    values = _first(named.filter(usable), F.col("pos"), "seq", "pos", "name", "url")
    return values, _complete(rows, "streaming", _defects(named, usable, F.lit(False)))


def parse_authors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I8: authors per title; the first entry with a role wins, else the first."""
    named = _named(rows, "authors", fv.AUTHOR_NAME_LENGTH, None)
    usable = F.col("name").isNotNull() & F.col("key").isNotNull()
    named = named.withColumn("provider_id", F.col("e.provider_id")).withColumn("role", F.col("e.role"))
    order = F.struct(F.col("role").isNull(), F.col("pos"))
    values = _first(named.filter(usable), order, "seq", "pos", "provider_id", "name", "role")
    return values, _complete(rows, "authors", _defects(named, usable, F.col("e.bad_id")))


def distinct_names(rows: DataFrame) -> DataFrame:
    """Names per title without blanks; the first spelling of a name wins.

    ``rows`` has ``item_id``, ``pos`` and ``name``.
    """
    name = text.blank_to_null(F.col("name"))
    rows = rows.select("item_id", "pos", name.alias("name")).filter("name IS NOT NULL")
    best = rows.groupBy("item_id", F.lower("name").alias("key")).agg(
        F.min_by("name", "pos").alias("name"), F.min("pos").alias("pos")
    )
    return best.select("item_id", "pos", "name")
