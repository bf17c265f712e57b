"""Payload rules, merges, reconciliation and identities on hand-written cases."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from reelshelf import Catalogue
from samples import SAMPLE

from reelshelf.operators import apply, gate, identity, parsing, reconcile
from reelshelf.queries import QUERIES
from reelshelf.schemas import LINKS, schema
from reelshelf.sources import landing

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def page(spark, *objects, number=1):
    rows = [("scan", number, i, json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "scan_key string, page int, pos int, body string")
    return df.select("scan_key", "page", "pos", F.try_parse_json("body").alias("entry"))


def anime(spark, *objects, number=1):
    return parsing.clean_anime(page(spark, *objects, number=number))


def table(spark, name, *rows):
    """Rows given as dicts; missing columns are NULL."""
    fields = schema(name)
    return spark.createDataFrame([tuple(r.get(f) for f in fields.names) for r in rows], fields)


def stored(spark, **tables):
    cat = Catalogue.empty(spark)
    from dataclasses import replace

    return replace(cat, **{n: table(spark, n, *rows) for n, rows in tables.items()})


ANIME_ROW = {
    "anime_id": 1, "mal_id": 1, "title": "Old", "type": "TV", "season": "summer", "status": "FINISHED_AIRING",
    "year": 2020, "score": 8.0, "popularity": 5, "members": 7, "episodes": 12, "is_adult": False, "mal_url": "u",
    "image_url": "i", "sequel": False, "genres": ["Old"], "genres_detailed": ["old"], "synopsis": "s",
}
MANGA_ROW = {
    "manga_id": 1, "mal_id": 1, "title": "Old", "content_type": "MANGA", "manga_type": "Manga", "status": "Publishing",
    "publication_year": 2020, "score": 7.0, "chapters": 1, "volumes": 1, "is_adult": False, "mal_url": "u",
    "image_url": "i", "genres": ["Old"], "genres_detailed": ["old"],
}


def update(spark, entry, **row):
    cat = stored(spark, anime=[{**ANIME_ROW, **row}])
    applied = apply.apply_anime_page(cat, anime(spark, {"mal_id": 1, **entry}), now(), discover_missing=True)
    return applied.catalogue.anime.first()


# --- anime fields ---------------------------------------------------------------


def test_absent_fields_keep_and_null_fields_clear(spark):
    kept = update(spark, {})
    assert (kept.title, kept.synopsis, kept.year, kept.score, kept.episodes) == ("Old", "s", 2020, 8.0, 12)
    cleared = update(spark, {"synopsis": None, "year": None, "score": 0, "episodes": None, "title": "", "popularity": -1})
    assert (cleared.synopsis, cleared.year, cleared.score, cleared.episodes) == (None, None, None, None)
    assert (cleared.title, cleared.popularity) == ("Old", 5)


def test_only_strict_json_numbers_count(spark):
    row = update(spark, {"score": True, "members": "9", "popularity": 1.0})
    assert (row.score, row.members, row.popularity) == (None, 7, 5)


def test_films_lose_their_season_and_sparse_tv_keeps_it(spark):
    assert update(spark, {"type": "Movie"}).season is None
    assert update(spark, {}).season == "summer"
    assert update(spark, {"aired": {"from": "2021-01-09T00:00:00+00:00"}}).season == "winter"
    assert update(spark, {"season": " FALL ", "type": "tv"}).season == "fall"
    assert update(spark, {"type": "TV Special"}).type == "SPECIAL"


def test_unknown_status_is_ignored_and_relations_set_the_sequel_flag(spark):
    assert update(spark, {"status": "cancelled"}).status == "FINISHED_AIRING"
    assert update(spark, {"status": "Currently Airing"}).status == "CURRENTLY_AIRING"
    assert update(spark, {"relations": [{"relation": "Sequel"}]}).sequel is True
    assert update(spark, {"relations": None}, sequel=True).sequel is False


def test_tags_add_up_and_empty_genre_lists_keep_the_old_ones(spark):
    row = update(spark, {"genres": [{"name": " Drama "}, {"name": "Drama"}], "themes": [{"name": "OLD"}]})
    assert (row.genres, row.genres_detailed) == (["Drama"], ["old", "drama"])
    assert update(spark, {"genres": []}).genres == ["Old"]


def test_new_anime_get_a_negative_id_and_fallbacks(spark):
    applied = apply.apply_anime_page(
        Catalogue.empty(spark), anime(spark, {"mal_id": 42, "type": None}), now(), discover_missing=True
    )
    row = applied.catalogue.anime.first()
    assert (row.anime_id, row.title, row.type, row.image_url) == (-42, "MAL anime 42", "UNKNOWN", "")
    assert row.mal_url.endswith("/anime/42") and row.genres == [] and row.sequel is False


# --- gates ----------------------------------------------------------------------


def test_adult_wins_inside_a_page_and_the_last_duplicate_counts(spark):
    rows = anime(
        spark,
        {"mal_id": 1, "rating": "Rx - Hentai"},
        {"mal_id": 1, "title": "clean"},
        {"mal_id": 2, "title": "first"},
        {"mal_id": 2, "title": "last"},
        {"mal_id": True},
        {"mal_id": "3"},
        {"mal_id": 0},
    )
    gated = {r.mal_id: r for r in gate.gate_anime(rows).collect()}
    assert set(gated) == {1, 2}
    assert gated[1].adult and gated[1].e is None
    assert not gated[2].adult and gated[2].e.title == "last"
    counts = gate.gate_counts(rows, gate.gate_anime(rows)).first()
    assert (counts.entries, counts.kept, counts.skipped) == (7, 1, 6)


@pytest.mark.parametrize(
    "entry, adult",
    [
        ({"genres": [{"name": "Hentai"}]}, True),
        ({"demographics": [{"name": " EROTICA "}]}, True),
        ({"rating": "Rx - Hentai"}, True),
        ({"genres": [{"name": "Ecchi"}], "themes": [{"name": "Adult Cast"}]}, False),
        ({}, False),
    ],
)
def test_adult_screen(spark, entry, adult):
    assert anime(spark, {"mal_id": 1, **entry}).first().is_adult is adult


def test_season_import_overrides_and_caps(spark):
    cat = stored(spark, anime=[{**ANIME_ROW, "anime_id": 9, "mal_id": 9}])
    rows = anime(
        spark,
        {"mal_id": 5, "type": "TV", "year": 1999},
        {"mal_id": 6, "type": "Movie"},
        {"mal_id": 7},
        {"mal_id": 9, "genres": [{"name": "Erotica"}]},
    )
    applied, counts = apply.import_season(cat, rows, now(), 2021, "spring", limit=2)
    assert tuple(counts.first()) == (2, 1)
    got = {r.mal_id: (r.year, r.season) for r in applied.catalogue.anime.collect()}
    assert got == {5: (2021, "spring"), 6: (2021, None)}


# --- print ----------------------------------------------------------------------


def test_print_page_outcomes_by_type_flag_and_stock(spark):
    """Every combination of provider type, restricted tag and stored title, 24 entries on one page."""
    cases = list(itertools.product((None, "manga", "MANHWA", "One-shot"), (False, True), (False, True), (0, 1)))
    cases = [c for c in cases if c[3] == 0 or c[0] == "manga"]
    entries, titles, expected = [], [], {}
    for number, (kind, restricted, known, _) in enumerate(cases, 500):
        entry = {"mal_id": number, "title": f"Title {number}"}
        entry |= {"type": kind} if kind else {}
        entry |= {"genres": [{"name": "Erotica"}]} if restricted else {}
        entries.append(entry)
        if known:
            titles.append({**MANGA_ROW, "manga_id": number - 400, "mal_id": number})
        if restricted and known:
            expected[number] = "removed_adult"
        elif not restricted and kind in (None, "manga"):
            expected[number] = "updated" if known else "inserted"
    rows = parsing.clean_manga(page(spark, *entries, {"mal_id": -7}, {"title": "No id"}))
    applied = apply.apply_manga_page(stored(spark, manga=titles), rows, now(), expected="MANGA")
    assert {r.mal_id: r.outcome for r in applied.titles.collect()} == expected
    kept = sum(o != "removed_adult" for o in expected.values())
    assert gate.gate_counts(rows, gate.gate_manga(rows, "MANGA")).first().skipped == len(cases) + 2 - kept
    got = {r.mal_id: r.title for r in applied.catalogue.manga.collect()}
    gone = {n for n, o in expected.items() if o == "removed_adult"}
    assert set(got) == ({t["mal_id"] for t in titles} | set(expected)) - gone
    assert all(got[n] == f"Title {n}" for n, o in expected.items() if o != "removed_adult")


def test_print_fields_overwrite_even_with_nothing(spark):
    cat = stored(spark, manga=[MANGA_ROW], genre=[{"id": 1, "name": "Old"}], manga_genre=[{"manga_id": 1, "genre_id": 1}])
    entry = {"mal_id": 1, "status": " ", "type": None, "genres": [], "published": {"from": "1998-02"}, "volumes": None}
    out = apply.apply_manga_page(cat, parsing.clean_manga(page(spark, entry)), now(), expected="MANGA").catalogue
    row = out.manga.first()
    assert (row.status, row.manga_type, row.genres, row.genres_detailed) == (None, None, [], [])
    assert (row.publication_year, row.volumes, row.chapters) == (1998, None, 1)
    assert out.manga_genre.count() == 0


def test_bad_authors_make_a_title_add_only(spark):
    rows = parsing.clean_manga(
        page(spark, {"mal_id": 1, "authors": [{"mal_id": 1, "name": "A"}, {"mal_id": -1, "name": "B"}, {"mal_id": 2}, "x"]})
    )
    rows = rows.withColumn("item_id", F.col("mal_id")).withColumn("seq", F.col("pos"))
    values, state = parsing.parse_authors(rows)
    assert {(r.name, r.provider_id) for r in values.collect()} == {("A", 1), ("B", None)}
    state = state.first()
    assert (state.is_list, state.malformed, state.complete) == (True, 3, False)


def test_author_duplicates_collapse_to_the_first_with_a_role(spark):
    authors = [{"name": "Same Name", "type": "People"}, {"name": " same  name ", "role": "Art"}, {"name": "SAME NAME", "role": "Story"}]
    rows = parsing.clean_manga(page(spark, {"mal_id": 1, "authors": authors}))
    rows = rows.withColumn("item_id", F.col("mal_id")).withColumn("seq", F.col("pos"))
    (row,) = parsing.parse_authors(rows)[0].collect()
    assert (row.key, row.name, row.role) == ("same name", "same name", "Art")


# --- envelopes and outcomes --------------------------------------------------------


@pytest.mark.parametrize(
    "kind, number, body, reason",
    [
        ("season", 1, {"data": None, "pagination": {"has_next_page": True}}, "data is not a list"),
        ("season", 1, {"data": {}, "pagination": {"has_next_page": True}}, "data is not a list"),
        ("season", 1, {"data": []}, "invalid pagination"),
        ("season", 1, {"data": [], "pagination": None}, "invalid pagination"),
        ("season", 1, {"data": [], "pagination": {"has_next_page": 0}}, "invalid pagination"),
        ("season", 1, {"data": [], "pagination": {"has_next_page": True, "last_visible_page": "x"}}, None),
        ("anime", 1, {"data": [], "pagination": {"has_next_page": True, "last_visible_page": True}}, "invalid pagination"),
        ("manga", 2, {"data": [{}], "pagination": {"has_next_page": True, "current_page": 1}}, "wrong page"),
        ("manga", 1, {"data": [], "pagination": {"has_next_page": True}}, "empty nonterminal page"),
        ("manga", 3, {"data": [{}], "pagination": {"has_next_page": True, "last_visible_page": 3}}, "inconsistent pagination"),
        ("manga", 2, {"data": [{}], "pagination": {"has_next_page": False, "last_visible_page": 3}}, "inconsistent terminal page"),
        ("manga", 3, {"data": [{}], "pagination": {"has_next_page": False, "last_visible_page": 3}}, None),
        ("manga", 9, {"data": [], "pagination": {"has_next_page": False, "last_visible_page": 3}}, None),
    ],
)
def test_envelopes(spark, kind, number, body, reason):
    rows = spark.createDataFrame([("s", number, json.dumps(body))], "scan_key string, page int, body string")
    rows = rows.withColumn("status_code", F.lit(200))
    valid, rejected = landing.read_pages(rows.withColumn("fetched_at", now()), kind)
    assert [r.reason for r in rejected.collect()] == ([reason] if reason else [])
    assert valid.count() == (0 if reason else 1)


def test_refresh_outcomes_by_status_and_body(spark):
    """Each status with each kind of body; only a readable answer about the title itself counts."""
    bodies = {
        "fresh": lambda i: {"mal_id": i, "title": "Fresh"},
        "restricted": lambda i: {"mal_id": i, "explicit_genres": [{"name": " erotica "}]},
        "other title": lambda i: {"mal_id": i + 1000},
        "unsupported": lambda i: {"mal_id": i, "type": "Light Novel"},
        "list": lambda i: [i],
        "nothing": lambda i: None,
    }
    by_body = {"fresh": "updated", "restricted": "removed_adult", "unsupported": "removed_unsupported"}
    by_status = {404: "not_found", 429: "temporary", 503: "temporary", None: "temporary", 410: "unexpected"}
    rows, titles, expected = [], [], {}
    for number, (status, (name, make)) in enumerate(itertools.product((200, 404, 429, 503, 410, None), bodies.items()), 30):
        rows.append(("print_refresh", number, status, json.dumps({"data": make(number)})))
        titles.append({**MANGA_ROW, "manga_id": number, "mal_id": number})
        expected[number] = by_status.get(status) or by_body.get(name, "invalid_payload")
    landed = spark.createDataFrame(rows, "kind string, mal_id bigint, status_code int, body string")
    answers = apply.detail_entries(landing.classify_fetch(landed.withColumn("fetched_at", now()), "manga"), "manga")
    cat = stored(spark, manga=titles)
    applied = apply.apply_print_refresh(cat, cat.manga, answers, now())
    assert {r.mal_id: r.outcome for r in applied.titles.collect()} == expected
    left = {r.mal_id: (r.title, str(r.last_attempt)) for r in applied.catalogue.manga.collect()}
    assert left == {
        n: ("Fresh" if o == "updated" else "Old", NOW) for n, o in expected.items() if not o.startswith("removed")
    }


# --- links and identities --------------------------------------------------------------


def links_after(spark, payload, **tables):
    cat = stored(spark, anime=[ANIME_ROW], **tables)
    applied = apply.apply_anime_page(cat, anime(spark, {"mal_id": 1, **payload}), now(), discover_missing=True)
    return applied


@pytest.mark.parametrize("bad", [0, 1, 3])
@pytest.mark.parametrize("good", [1, 2])
def test_lists_with_bad_items_add_and_never_remove(spark, good, bad):
    names = [f"Maker {k}" for k in range(good)]
    tables = {
        "studio": [{"id": 40, "name": "Elder", "normalized_name": "elder"}],
        "anime_studio": [{"anime_id": 1, "studio_id": 40}],
        "streaming_service": [{"name": "Elder", "normalized_name": "elder"}],
        "anime_streaming_service": [{"anime_id": 1, "service_key": "elder", "url": "https://elder.example"}],
    }
    payload = {
        "studios": ([17, "text", []] * 3)[:bad] + [{"name": n} for n in names],
        "streaming": [{"name": n, "url": f"https://{k}.example"} for k, n in enumerate(names)]
        + ([{"name": "No link"}, {"name": "Mail", "url": "mailto:a@b"}, 5] * 3)[:bad],
    }
    applied = links_after(spark, payload, **tables)
    out = applied.catalogue
    stays = {"elder"} if bad else set()
    keys = {n.lower() for n in names} | stays
    studios = out.anime_studio.join(out.studio.withColumnRenamed("id", "studio_id"), "studio_id")
    assert {r.normalized_name for r in studios.collect()} == keys
    assert {r.service_key for r in out.anime_streaming_service.collect()} == keys
    log = {r.entity: (r.created, r.removed, r.malformed) for r in applied.links.collect()}
    assert log == {e: (good, 0 if bad else 1, bad) for e in ("studio", "streaming_service")}


def test_absent_and_wrong_fields_keep_links_and_empty_lists_clear_them(spark):
    tables = {
        "studio": [{"id": 1, "name": "Kept", "normalized_name": "kept"}],
        "anime_studio": [{"anime_id": 1, "studio_id": 1}],
    }
    assert links_after(spark, {}, **tables).catalogue.anime_studio.count() == 1
    assert links_after(spark, {"studios": "x"}, **tables).catalogue.anime_studio.count() == 1
    assert links_after(spark, {"studios": []}, **tables).catalogue.anime_studio.count() == 0


def test_a_changed_url_is_an_update(spark):
    tables = {
        "streaming_service": [{"name": "Svc", "normalized_name": "svc"}],
        "anime_streaming_service": [{"anime_id": 1, "service_key": "svc", "url": "https://old"}],
    }
    applied = links_after(spark, {"streaming": [{"name": "SVC", "url": "https://new"}]}, **tables)
    assert applied.catalogue.anime_streaming_service.first().url == "https://new"
    # The shown name changes only when a link is created.
    assert applied.catalogue.streaming_service.first().name == "Svc"
    assert applied.links.filter("entity = 'streaming_service'").first().changed == 1


def test_colliding_studio_rows_merge_under_the_provider_id(spark):
    tables = {
        "studio": [
            {"id": 1, "mal_id": 20, "name": "Provider Studio", "normalized_name": "provider studio"},
            {"id": 2, "mal_id": 10, "name": "Renamed Studio", "normalized_name": "renamed studio"},
        ],
        "anime_studio": [{"anime_id": 1, "studio_id": 2}, {"anime_id": 8, "studio_id": 1}, {"anime_id": 9, "studio_id": 2}],
    }
    out = links_after(spark, {"studios": [{"mal_id": 20, "name": "Renamed Studio"}]}, **tables).catalogue
    assert [tuple(r) for r in out.studio.collect()] == [(1, 20, "Renamed Studio", "renamed studio")]
    assert {tuple(r) for r in out.anime_studio.collect()} == {(1, 1), (8, 1), (9, 1)}


def test_reconciling_twice_changes_nothing(spark):
    link = LINKS["studio"]
    current = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "anime_id bigint, studio_id bigint")
    incoming = spark.createDataFrame([(1, 2), (1, 3)], "anime_id bigint, studio_id bigint")
    scope = spark.createDataFrame([(1, True)], "anime_id bigint, complete boolean")
    actions = reconcile.reconcile_links(current, incoming, scope, link)
    once = reconcile.apply_actions(current, actions, scope, link)
    assert {tuple(r) for r in once.collect()} == {(1, 2), (1, 3), (2, 1)}
    again = reconcile.reconcile_links(once, incoming, scope, link)
    assert {r.action for r in again.collect()} == {"keep"}


def test_merge_chains_rings_and_forks_end_in_one_owner(spark):
    edges = [(2, 1), (3, 2), (4, 3), (11, 12), (12, 13), (13, 11), (22, 21), (22, 23), (31, 30)]
    out = identity.canonical_ids(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.old_id: r.new_id for r in out.collect()} == {2: 1, 3: 1, 4: 1, 12: 11, 13: 11, 22: 21, 23: 21, 31: 30}


def test_authors_match_by_name_then_id_and_never_merge(spark):
    dim = table(
        spark,
        "author",
        {"id": 1, "mal_id": 10, "name": "Old Name", "normalized_name": "old name"},
        {"id": 2, "name": "Known", "normalized_name": "known"},
    )
    incoming = spark.createDataFrame(
        [(1, 1, "known", "KNOWN", 20), (1, 2, "new name", "New Name", 10), (2, 3, "fresh", "Fresh", 30), (2, 4, "fresh", "Fresh", None)],
        "item_id bigint, seq int, key string, name string, provider_id bigint",
    )
    authors, resolved = identity.resolve_authors(dim, incoming)
    assert {tuple(r) for r in authors.collect()} == {
        (1, 10, "New Name", "new name"),
        (2, 20, "KNOWN", "known"),
        (3, 30, "Fresh", "fresh"),
    }
    assert {(r.seq, r.ref_id) for r in resolved.collect()} == {(1, 2), (2, 1), (3, 3), (4, 3)}


def test_genre_links_filter_on_stored_fields(spark):
    """A filter on cleaned fields, moved below the cleaning, would parse the payload once a field."""
    plan = QUERIES["i5_reconcile_genres"](spark, SAMPLE)._jdf.queryExecution().optimizedPlan().toString()
    assert "anime_id" in plan and "parse_json" not in plan and "variant_get" not in plan
