"""What the physical plans must and must not contain, and hot keys."""

from __future__ import annotations

import pytest
from samples import SAMPLE
from pyspark.sql import functions as F

from reelshelf import CatalogueQuery
from reelshelf.operators import profile, ranking, reconcile, visits
from reelshelf.queries import QUERIES
from reelshelf.schemas import LINKS
from reelshelf.sources.bindings import VIEWS


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["d1_genre_include_all", "d2_genre_exclude", "d9_adult_ids", "e8_build_facets", "f6_facet_page", "i9_reconcile_studio_links", "b5_hydrated_page"],
)
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](spark, SAMPLE))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, cat):
    text = plan(cat.identity_rows(CatalogueQuery(scope="MANGA", min_volumes=3)).select("record_id"))
    assert "PushedFilters" in text
    read = text.split("ReadSchema:")[1]
    assert "c_custkey" in read and "c_name" not in read


def test_a_page_is_a_top_k(spark, cat):
    assert "TakeOrderedAndProject" in plan(cat.page(CatalogueQuery()))


def test_ascii_names_need_no_python_for_sorting_and_filters(spark, cat):
    assert "Python" not in plan(cat.listing(CatalogueQuery(studios="x")))


def skewed(spark, n=30_000):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("bigint").alias("hot"), "id"
    )


def test_hot_entity_keeps_every_link(spark):
    rows = skewed(spark)
    current = rows.select(F.col("id").alias("anime_id"), F.col("hot").alias("studio_id"))
    incoming = current.filter("anime_id % 2 = 0")
    scope = rows.select(F.col("id").alias("anime_id"), (F.col("id") % 5 > 0).alias("complete"))
    actions = reconcile.reconcile_links(current, incoming, scope, LINKS["studio"])
    got = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    assert got == {"keep": 15_000, "retain": 3_000, "remove": 12_000}


def test_hot_visitor_and_hot_sort_value(spark):
    rows = skewed(spark)
    log = rows.select(
        F.col("hot").cast("string").alias("visitor_token_hash"),
        F.lit("2024-01-01").cast("date").alias("visit_date"),
        F.lit("r").alias("route"),
        F.current_timestamp().alias("ts"),
    )
    totals = visits.visit_totals(visits.daily(log)).first()
    assert (totals.visits, totals.unique_visitors) == (30_000, 20_001)
    ranked = ranking.global_rank(rows, [F.col("hot").asc(), F.col("id").asc()])
    wrong = ranked.filter((F.col("hot") == 0) & (F.col("rank") != F.col("id") / 3 + 1)).count()
    assert wrong == 0 and ranked.agg(F.count_distinct("rank")).first()[0] == 30_000


def test_hot_genre_gives_one_facet(spark, cat):
    from dataclasses import replace

    links = cat.anime.select("anime_id", F.lit(0).cast("bigint").alias("genre_id"))
    facets = profile.build_facets(replace(cat, anime_genre=links))
    assert facets.filter("content_type = 'ANIME' AND facet_type = 'genre'").count() == 1


def test_every_view_is_plain_sql():
    assert all(text.lstrip().startswith("SELECT") for text in VIEWS.values())
