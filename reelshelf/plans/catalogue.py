"""The catalogue: its tables and the queries over them."""

from __future__ import annotations

from dataclasses import dataclass, fields
from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as fv
from reelshelf.operators import filters, profile, projection, ranking
from reelshelf.plans.spec import CatalogueQuery, QueryError
from reelshelf.schemas import ANIME, DDL, MANGA, Link, schema


@dataclass(frozen=True)
class Catalogue:
    """The eleven tables of a media catalogue."""

    anime: DataFrame
    manga: DataFrame
    genre: DataFrame
    anime_genre: DataFrame
    manga_genre: DataFrame
    studio: DataFrame
    anime_studio: DataFrame
    streaming_service: DataFrame
    anime_streaming_service: DataFrame
    author: DataFrame
    manga_author: DataFrame

    @classmethod
    def tables(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))

    def picked(self, anime_ids: list[int], print_ids: list[int]) -> Catalogue:
        """The same, of which only the rows of a few titles will be read."""
        return self

    def sampled(self, share: float, seed: int) -> tuple[Catalogue, float]:
        """A random part that is cheap to read, and the share to sample of it."""
        return self, share

    def narrowed(self, ids: DataFrame, *tables: str) -> Catalogue:
        """The same, where only rows of ``ids`` may change in ``tables``."""
        return self

    def widened(self, link: Link, refs: DataFrame) -> Catalogue:
        """The same, where titles linked to ``refs`` may change in the link's table too."""
        return self

    def known(self, medium: str, mal_ids: DataFrame) -> DataFrame:
        """Titles with one of some provider ids: (mal_id, item_id)."""
        rows = getattr(self, medium).select("mal_id", F.col(f"{medium}_id").alias("item_id"))
        return rows.join(mal_ids.select("mal_id"), "mal_id", "left_semi")

    def moved(self, medium: str, moves: DataFrame) -> Catalogue:
        """The same, where titles (mal_id, item_id, gone) have come or gone."""
        return self

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalogue:
        return cls(**{t: spark.createDataFrame([], schema(t)) for t in cls.tables()})

    # --- queries ------------------------------------------------------------

    def identity_rows(self, spec: CatalogueQuery) -> DataFrame:
        """Matching titles of every branch that ``spec`` can reach.

        Filters run before the union, so they reach each table's scan.
        """
        scope = spec.effective_scope
        branches = []
        if "ANIME" in scope:
            branches.append(projection.identity(filters.anime(self, spec), ANIME))
        if scope & set(fv.PRINT_TYPES.values()):
            branches.append(projection.identity(filters.manga(self, spec), MANGA))
        if not branches:
            return projection.identity(self.anime, ANIME).limit(0)
        return branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])

    def page(self, spec: CatalogueQuery) -> DataFrame:
        """one ordered page of identity rows with ``rank``."""
        keys = ranking.sort_keys(spec.sort)
        return ranking.slice_rows(self.identity_rows(spec), keys, spec.offset, spec.per_page)

    def listing(self, spec: CatalogueQuery, tier: str = "list") -> DataFrame:
        """One page of full rows."""
        return projection.hydrate(self.page(spec), self, tier)

    def total(self, spec: CatalogueQuery) -> DataFrame:
        """Result size of ``spec``."""
        return profile.total(self.identity_rows(spec), spec.per_page)

    def seasonal(
        self,
        year: int,
        season: str,
        spec: CatalogueQuery,
        sort: str = "most_popular",
        page: int = 1,
        limit: int = fv.RANDOM_DEFAULT,
    ) -> DataFrame:
        """ranked titles of one broadcast season."""
        if sort not in fv.SEASONAL_SORTS:
            raise QueryError("seasonal sort must be " + ", ".join(fv.SEASONAL_SORTS))
        if not 1 <= limit <= fv.RANDOM_MAX or page < 1:
            raise QueryError("limit must be 1 to 12 and page at least 1")
        rows = self.season_rows(year, season, spec, sort)
        keys = ranking.seasonal_keys(sort)
        return ranking.slice_rows(rows, keys, (page - 1) * limit, limit)

    def season_rows(self, year: int, season: str, spec: CatalogueQuery, sort: str) -> DataFrame:
        """every title of one season; its count is the total."""
        rows = filters.public(self.anime).filter(
            (F.col("year") == year) & (F.col("season") == season)
        )
        if sort == "top_rated":
            rows = rows.filter(F.col("score").isNotNull())
        return filters.common(rows, spec, self, ANIME)

    def random(self, spec: CatalogueQuery, limit: int = fv.RANDOM_DEFAULT, seed: int = 0):
        """A few random titles.

        Without filters a small sample is tried first. A short sample, or any
        filter, falls back to a window that starts at a random id.
        """
        if not 1 <= limit <= fv.RANDOM_MAX:
            raise QueryError("limit must be 1 to 12")
        rows = self.identity_rows(spec)
        if spec == CatalogueQuery(scope=spec.scope, sort=spec.sort):
            # At most twelve rows: kept, so that the scan runs only once.
            part, share = self.sampled(fv.RANDOM_SAMPLE_FRACTION, seed)
            picked = ranking.random_sample(part.identity_rows(spec), limit, seed, share).take(limit)
            if len(picked) == limit:
                return rows.sparkSession.createDataFrame(picked, rows.schema)
        low, high = ranking.id_bounds(rows).first()
        if low is None:
            return rows.limit(0)
        pivot = Random(seed).randint(low, high)
        return ranking.random_window(rows, pivot, limit).drop("rank")


assert set(Catalogue.tables()) <= set(DDL)
