"""Parameter rules, scope narrowing and presets."""

from __future__ import annotations

from datetime import date

import pytest

from reelshelf import CatalogueQuery, QueryError, preset
from reelshelf.plans.spec import split_list


def test_lists_are_split_trimmed_and_deduplicated_in_order():
    assert split_list(["b, a", "a,, c "]) == ("b", "a", "c")
    assert split_list("x") == ("x",)
    assert split_list(None) == ()


@pytest.mark.parametrize(
    "bad",
    [
        {"min_score": 11},
        {"min_score": "high"},
        {"min_score": float("nan")},
        {"min_year": 0},
        {"min_year": 2001, "max_year": 2000},
        {"min_episodes": 10_001},
        {"min_chapters": 5, "max_chapters": 4},
        {"max_volumes": 100_001},
        {"seasons": "autumn"},
        {"scope": "ANIME", "statuses": "unknown"},
        {"statuses": "finished"},
        {"sort": "most_episodes"},
        {"scope": "MANGA", "sort": "most_episodes"},
        {"scope": "BOOKS"},
        {"page": 0},
        {"per_page": 101},
    ],
)
def test_invalid_parameters_are_rejected(bad):
    with pytest.raises(QueryError):
        CatalogueQuery(**bad)


def test_values_are_normalised():
    spec = CatalogueQuery(
        scope=" anime ",
        types="tv_special",
        seasons="WINTER",
        statuses="not-yet airing",
        studios="Ｆull  Width",
        min_year="2001",
    )
    assert spec.scope == "ANIME"
    assert spec.types == ("SPECIAL",)
    assert spec.seasons == ("winter",)
    assert spec.statuses == ("NOT_YET_AIRED",)
    assert spec.studios == ("full width",)
    assert spec.min_year == 2001
    assert CatalogueQuery(scope="MANGA", statuses="ON_HIATUS").statuses == ("on hiatus",)


def test_media_specific_filters_narrow_the_scope():
    assert CatalogueQuery(min_episodes=1).effective_scope == {"ANIME"}
    assert CatalogueQuery(authors="x").effective_scope == {"MANGA", "MANHWA"}
    assert CatalogueQuery(min_episodes=1, min_volumes=1).effective_scope == frozenset()
    assert CatalogueQuery(scope="MANGA", studios="x").effective_scope == frozenset()


def test_preset_replaces_only_its_own_parameters():
    base = CatalogueQuery(scope="ANIME", q="x", max_episodes=50)
    spec = preset("short-series", base, date(2024, 5, 1))
    assert (spec.q, spec.types, spec.max_episodes) == ("x", ("TV",), 13)
    spec = preset("new-season", base, date(2024, 5, 1))
    assert (spec.seasons, spec.min_year, spec.max_year) == (("spring",), 2024, 2024)
    with pytest.raises(QueryError):
        preset("movies", CatalogueQuery(scope="MANGA"), date(2024, 5, 1))
