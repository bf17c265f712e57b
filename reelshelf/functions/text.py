"""Text columns: trimming, canonical labels, entity names, URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelshelf.functions import fixed_values as fv

# Unicode white space, plus the four ASCII separators that Python also strips.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Remove white space (any Unicode kind) from both ends."""
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Strip and turn each inner run of white space into one space."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def anime_type(c: Column, fallback: Column | str = "UNKNOWN") -> Column:
    """H6: canonical upper-case anime type."""
    if isinstance(fallback, str):
        fallback = F.lit(fallback)
    label = F.upper(collapse(F.replace(c, F.lit("_"), F.lit(" "))))
    for alias, canonical in fv.ANIME_TYPE_ALIASES.items():
        label = F.when(label == alias, canonical).otherwise(label)
    return F.when(blank_to_null(c).isNotNull(), label).otherwise(fallback)


def anime_status(c: Column) -> Column:
    """H7: one of three canonical airing states, else NULL."""
    words = collapse(F.replace(c, F.lit("-"), F.lit(" ")))
    label = F.upper(F.replace(words, F.lit(" "), F.lit("_")))
    known = F.create_map(*[F.lit(x) for pair in fv.ANIME_STATUS_ALIASES.items() for x in pair])
    return F.try_element_at(known, label)


def season(c: Column) -> Column:
    """H8: one of four season names, else NULL."""
    label = F.lower(strip(c))
    return F.when(label.isin(*fv.SEASONS), label)


def content_type(c: Column, fallback: Column) -> Column:
    """MANGA or MANHWA; blank or NULL gives the fallback, others NULL."""
    label = F.lower(strip(c))
    out = F.when(c.isNull() | (label == ""), fallback)
    for name, canonical in fv.PRINT_TYPES.items():
        out = out.when(label == name, canonical)
    return out


_FOLDED = StructType([StructField("name", StringType()), StructField("key", StringType())])


@F.pandas_udf(_FOLDED)
def _fold(names: pd.Series) -> pd.DataFrame:
    name = names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")
    return pd.DataFrame({"name": name, "key": name.map(str.casefold, na_action="ignore")})


@F.pandas_udf(StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.map(str.casefold, na_action="ignore")


def casefold(c: Column) -> Column:
    """Full Unicode case folding."""
    return F.when(_is_ascii(c), F.lower(c)).otherwise(_casefold(F.when(~_is_ascii(c), c)))


def _is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def _within(c: Column, max_length: int | None) -> Column:
    """Collapsed text, NULL when blank or longer than allowed."""
    text = collapse(c)
    if max_length is not None:
        # One expression, so that the text is computed once per row.
        text = F.regexp_extract(text, f"(?s)^.{{1,{max_length}}}$", 0)
    return F.nullif(text, F.lit(""))


def entity_name(c: Column, max_length: int = fv.ENTITY_NAME_LENGTH) -> Column:
    """NFKC display name, NULL when blank or too long.

    ASCII text is already in NFKC form, so it never needs Python; the Arrow
    function sees NULL for those rows.
    """
    folded = _fold(F.when(~_is_ascii(c), c))
    return _within(F.when(_is_ascii(c), c).otherwise(folded["name"]), max_length)


def entity_key(c: Column, max_length: int | None = fv.ENTITY_NAME_LENGTH) -> Column:
    """Case-folded identity key of the same raw text, NULL when blank.

    Folding does not touch white space, so both results come from one call.
    """
    folded = _fold(F.when(~_is_ascii(c), c))
    return _within(F.when(_is_ascii(c), F.lower(c)).otherwise(folded["key"]), max_length)


def safe_url(c: Column) -> Column:
    """Stripped http(s) URL with a host, else NULL."""
    url = strip(c)
    return F.when(url.rlike(r"^(?i:https?)://[^/?#]+"), url)


def service_brand(name: Column, url: Column) -> Column:
    """First brand whose alias occurs in the name or URL."""
    text = F.lower(
        F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(url, F.lit("")))
    )
    out = None
    for brand, aliases in fv.SERVICE_BRANDS:
        hit = text.contains(aliases[0])
        for alias in aliases[1:]:
            hit = hit | text.contains(alias)
        out = F.when(hit, brand) if out is None else out.when(hit, brand)
    return out.otherwise(fv.BRAND_FALLBACK)


def token_hash(c: Column) -> Column:
    """Anonymous SHA-256 digest of a visitor token."""
    return F.sha2(c, 256)
