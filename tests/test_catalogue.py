"""Properties of catalogue queries that need no second engine."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from reelshelf import CatalogueQuery
from reelshelf.operators import filters, profile, projection, ranking
from reelshelf.session import materialise


def keys(rows):
    return [(r.content_type, r.record_id) for r in rows.orderBy("rank").collect()]


def test_pages_concatenate_to_the_full_order(cat):
    spec = CatalogueQuery(min_score=8, per_page=20)
    rows = cat.identity_rows(spec)
    whole = keys(ranking.global_rank(rows, ranking.order_keys("top_rated")))
    total = cat.total(spec).first()
    pages = [keys(cat.page(replace(spec, page=n))) for n in range(1, total.pages + 1)]
    assert total.total == len(whole)
    assert [k for page in pages for k in page] == whole


@pytest.mark.parametrize("sort", ["title", "newest"])
def test_deep_slice_equals_top_k_slice(cat, sort, monkeypatch):
    monkeypatch.setattr(ranking, "materialise", None)
    rows = materialise(cat.identity_rows(CatalogueQuery()).coalesce(2))
    order, total = ranking.sort_keys(sort), rows.count()
    for offset in (total // 2, total - 4, total + 9):
        shallow = ranking.slice_rows(rows, order, offset, 10).collect()
        deep = ranking.slice_rows(rows, order, offset, 10, top_k=5).collect()
        assert shallow == deep
        part, before = ranking.narrowed(rows, order, offset, offset + 10, 60, sample=64)
        assert before <= offset and (offset >= total or part.count() < total)


def test_selection_with_repeated_rows_nulls_and_no_rows(spark):
    """A third of all rows are one row; they can't be told apart, but are all counted."""
    rows = [(None if i % 7 == 0 else i % 50, i) for i in range(1000)] + [(25, 999)] * 500
    rows = materialise(spark.createDataFrame(rows, "score int, id int").coalesce(2))
    for down, first in ((False, False), (False, True), (True, False), (True, True)):
        order = [ranking.Key(F.col("score"), down, first), ranking.Key(F.col("id"))]
        for offset in (140, 900, 1495):
            shallow = ranking.slice_rows(rows, order, offset, 20).collect()
            part, before = ranking.narrowed(rows, order, offset, offset + 20, 50, sample=128)
            deep = ranking.slice_rows(part, order, offset - before, 20).collect()
            assert [(r.score, r.id) for r in shallow] == [(r.score, r.id) for r in deep]
    empty = rows.limit(0)
    assert ranking.slice_rows(empty, order, 9, 5, top_k=1).count() == 0


def test_selection_bounds_reach_the_scan(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("score"), "id").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    order = [ranking.Key(F.col("score"), descending=True), ranking.Key(F.col("id"))]
    page = ranking.slice_rows(rows, order, 4000, 5, top_k=100)
    assert [r.id for r in page.orderBy("rank").collect()] == [999, 998, 997, 996, 995]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(score" in plan and "GreaterThanOrEqual(score" in plan


@pytest.mark.parametrize("sort", ["top_rated", "newest", "oldest", "title", "most_popular", "most_members"])
def test_keyset_paging_visits_every_row_once(cat, sort):
    spec = CatalogueQuery(sort=sort)
    rows = cat.identity_rows(spec)
    order = ranking.order_keys(sort)
    whole = rows.orderBy(*order).collect()
    got = [r for r in whole[:90]]
    for _ in range(5):
        got += ranking.after(rows, sort, got[-1].asDict(), 60).collect()
    assert got == whole[: len(got)]


def test_including_and_excluding_a_genre_is_empty(cat):
    spec = CatalogueQuery(genres="NATION_1", excluded_genres="NATION_1")
    assert cat.identity_rows(spec).count() == 0


def test_conflicting_media_filters_keep_the_schema(cat):
    rows = cat.identity_rows(CatalogueQuery(min_episodes=1, min_volumes=1))
    assert rows.count() == 0 and tuple(rows.columns) == projection.IDENTITY


def test_search_treats_wildcards_as_text(spark):
    rows = spark.createDataFrame(
        [(1, "100% Pure", None), (2, "100 Pure", "a_b"), (3, "x", "A\\B")], "id int, title string, alternative_title string"
    )
    found = {q: [r.id for r in filters.search(rows, q).collect()] for q in ("0% p", "A_B", "\\", "")}
    assert found == {"0% p": [1], "A_B": [2], "\\": [3], "": [1, 2, 3]}


def test_null_elements_do_not_hide_a_title_from_tag_exclusion(spark):
    rows = spark.createDataFrame(
        [(1, ["a", None]), (2, ["b", None]), (3, None)], "id int, genres_detailed array<string>"
    )
    assert [r.id for r in filters.without_tags(rows, ("a",)).collect()] == [2]
    assert [r.id for r in filters.with_tags(rows, ("b",)).collect()] == [2]


def test_random_pick_is_distinct_public_and_within_the_filter(cat):
    spec = CatalogueQuery(min_score=9)
    allowed = {(r.content_type, r.record_id) for r in cat.identity_rows(spec).collect()}
    for seed in range(3):
        rows = [(r.content_type, r.record_id) for r in cat.random(spec, 12, seed).collect()]
        assert len(rows) == len(set(rows)) == min(12, len(allowed)) and set(rows) <= allowed
    assert cat.random(CatalogueQuery(), 6, 1).count() == 6
    assert cat.random(CatalogueQuery(scope="ANIME", q="no such title"), 6).count() == 0


def test_window_wraps_around_the_largest_id(spark):
    rows = spark.createDataFrame([("ANIME", i) for i in (1, 5, 9)], "content_type string, record_id bigint")
    picked = ranking.random_window(rows, 6, 3).orderBy("rank").collect()
    assert [r.record_id for r in picked] == [9, 1, 5]


def test_hydration_keeps_rank_and_rejects_oversized_pages(cat):
    page = cat.page(CatalogueQuery(per_page=30))
    full = projection.hydrate(page, cat, "detail").orderBy("rank").collect()
    assert [(r.content_type, r.id) for r in full] == keys(page)
    with pytest.raises(ValueError):
        projection.hydrate(ranking.global_rank(cat.identity_rows(CatalogueQuery()), ranking.order_keys("title")), cat)


def test_facet_pages_look_ahead(spark):
    facets = spark.createDataFrame(
        [("ANIME", "tag", t) for t in "abcde"] + [("MANGA", "tag", "a")],
        "content_type string, facet_type string, value string",
    )
    scope = frozenset({"ANIME", "MANGA"})
    first = profile.facet_page(facets, scope, "tag", "", 0, 3).orderBy("rank").collect()
    last = profile.facet_page(facets, scope, "tag", "", 3, 3).orderBy("rank").collect()
    assert [(r.value, r.rank, r.has_more) for r in first] == [("a", 1, True), ("b", 2, True), ("c", 3, True)]
    assert [(r.value, r.rank, r.has_more) for r in last] == [("d", 4, False), ("e", 5, False)]


def test_full_facet_list_folds_case_and_pages_do_not(spark):
    facets = spark.createDataFrame([("ANIME", "tag", "Straße")], "content_type string, facet_type string, value string")
    scope = frozenset({"ANIME"})
    assert profile.facet_values(facets, scope, "tag", "STRASSE").count() == 1
    assert profile.facet_page(facets, scope, "tag", "STRASSE", 0, 5).count() == 0


def test_coverage_of_an_empty_catalogue(spark):
    from reelshelf import Catalogue

    empty = Catalogue.empty(spark)
    assert profile.season_coverage(empty.anime).first().rate == 0.0
    assert profile.metric_coverage(empty).agg(F.sum("total")).first()[0] == 0
    assert profile.filter_ranges(empty, frozenset({"ANIME"})).first().min_year is None
    assert profile.freshness(empty, frozenset({"MANGA"})).first().updated_at is None
