"""Guarded reads of provider JSON held as VARIANT.

Absent, null and wrongly typed fields mean different things to the merge rules,
so every read checks the JSON type first: ``true``, ``"7"`` and ``1.5`` never
pass as integers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.functions import text
from reelshelf.functions.calendar import month_season


class Fields:
    """A JSON object opened once: one VARIANT column per expected field.

    Reading many fields through the struct visits the object a single time and
    keeps the generated code small. An absent field is NULL.
    """

    def __init__(self, struct: Column):
        self.struct = struct


def open_object(v: Column, names: Iterable[str]) -> Column:
    """Struct of the named fields of a JSON object; NULL for anything else."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def _v(v: Column | Fields, path: str) -> Column:
    if not isinstance(v, Fields):
        return F.try_variant_get(v, f"$.{path}", "variant")
    head, _, rest = path.partition(".")
    field = v.struct[head]
    return F.try_variant_get(field, f"$.{rest}", "variant") if rest else field


def _typed(v: Column | Fields, path: str, json_type: str, spark_type: str) -> Column:
    value = _v(v, path)
    return F.when(
        F.schema_of_variant(value) == json_type, F.try_variant_get(value, "$", spark_type)
    )


def has(v: Column | Fields, field: str) -> Column:
    """Whether the object has the field at all; an explicit null counts."""
    return _v(v, field).isNotNull()


def given(v: Column | Fields, path: str) -> Column:
    """Whether the field is there and not null."""
    value = _v(v, path)
    return value.isNotNull() & ~F.is_variant_null(value)


def string(v: Column | Fields, path: str) -> Column:
    """A JSON string, else NULL."""
    return _typed(v, path, "STRING", "string")


def integer(v: Column | Fields, path: str) -> Column:
    """A JSON integer, else NULL."""
    return _typed(v, path, "BIGINT", "bigint")


def boolean(v: Column | Fields, path: str) -> Column:
    """A JSON boolean, else NULL."""
    return _typed(v, path, "BOOLEAN", "boolean")


def array(v: Column | Fields, path: str) -> Column:
    """The elements of a JSON array, else NULL."""
    return F.try_variant_get(_v(v, path), "$", "array<variant>")


def is_object(v: Column) -> Column:
    """Whether the value is a JSON object."""
    # Any field will do: an object without it gives a struct of NULL.
    return F.try_variant_get(v, "$", "struct<mal_id:variant>").isNotNull()


def filled(v: Column | Fields, path: str) -> Column:
    """A non-empty JSON string, else NULL."""
    return F.nullif(string(v, path), F.lit(""))


def names(v: Column | Fields, field: str) -> Column:
    """H1: stripped, non-blank entity names in first-seen order; never NULL."""
    found = F.transform(array(v, field), lambda e: text.blank_to_null(string(e, "name")))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.array_compact(found)), empty)


def detailed_tags(lists: list[str]) -> Column:
    """H2: lower-case names of all four category lists, unique, in order."""
    return F.array_distinct(F.concat(*[F.transform(c, lambda t: F.lower(t)) for c in lists]))


def adult_rating(v: Column | Fields) -> Column:
    """H3: whether the age rating is the restricted one."""
    rated = F.contains(F.lower(string(v, "rating")), F.lit(fv.ADULT_RATING))
    return F.coalesce(rated, F.lit(False))


def is_adult(tags: Column, rated: Column) -> Column:
    """H3: restricted category name or restricted rating."""
    return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in fv.ADULT_NAMES])) | rated


def score(v: Column | Fields) -> Column:
    """H4: positive JSON number, else NULL."""
    kind = F.schema_of_variant(_v(v, "score"))
    number = F.try_variant_get(_v(v, "score"), "$", "double")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric & (number > 0), number)


def metric(v: Column | Fields, field: str) -> Column:
    """H5: JSON integer of at least zero, else NULL."""
    number = integer(v, field)
    return F.when(number >= 0, number)


def raw_int(v: Column | Fields, field: str) -> Column:
    """A count stored as delivered; the typed column needs a lenient cast."""
    return F.try_variant_get(_v(v, field), "$", "int")


def air_season(v: Column | Fields) -> Column:
    """H9: season of the premiere month, from the ISO date or its parts."""
    iso = F.regexp_extract(text.strip(string(v, "aired.from")), r"^\p{Nd}{4}-(\p{Nd}{2})", 1)
    month = F.coalesce(F.nullif(iso, F.lit("")).try_cast("int"), integer(v, "aired.prop.from.month"))
    return month_season(month)


def publication_year(v: Column | Fields) -> Column:
    """Positive year part, else the first four digits of the ISO date."""
    year = integer(v, "published.prop.from.year")
    iso = F.regexp_extract(text.strip(string(v, "published.from")), r"^(\p{Nd}{4})", 1)
    digits = F.nullif(iso, F.lit("")).try_cast("bigint")
    return F.coalesce(F.when(year > 0, year), digits).try_cast("int")


def image_url(v: Column | Fields) -> Column:
    """Large cover, else the normal one; NULL keeps the stored cover."""
    return F.coalesce(
        filled(v, "images.jpg.large_image_url"), filled(v, "images.jpg.image_url")
    )


def has_sequel(v: Column | Fields) -> Column:
    """Any relation entry named Sequel."""
    found = F.exists(array(v, "relations"), lambda e: string(e, "relation") == "Sequel")
    return F.coalesce(found, F.lit(False))


def author_role(e: Column) -> Column:
    """Role, else a type that does not merely say person."""
    role = text.blank_to_null(string(e, "role"))
    kind = text.blank_to_null(string(e, "type"))
    role = F.coalesce(role, F.when(~F.lower(kind).isin(*fv.PERSON_TYPES), kind))
    return F.when(F.length(role) <= fv.AUTHOR_ROLE_LENGTH, role)


def provider_id(v: Column | Fields) -> Column:
    """A positive JSON integer ``mal_id``, else NULL."""
    number = integer(v, "mal_id")
    return F.when(number > 0, number)
