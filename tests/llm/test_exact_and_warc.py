"""Exact deduplication on a persistent index, and WARC archives."""

from __future__ import annotations

import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from reelshelf.llm import warc
from reelshelf.llm.exact_dedup import DigestIndex, digests, drop_duplicates, exact_duplicates

ROWS = [(5, "a  b"), (3, "a b"), (9, "a\t\n b"), (4, "A b"), (7, None), (6, ""), (8, " "), (3, "a b"), (None, "a b"), (None, "only")]


def test_groups_and_edge_cases(documents):
    got = [tuple(r)[:4] for r in exact_duplicates(documents(ROWS)).collect()]
    want = [
        (3, 3, 5, True), (3, 3, 5, True), (5, 3, 5, False), (9, 3, 5, False), (None, 3, 5, False),
        (4, 4, 1, True), (6, 6, 2, True), (7, 6, 2, False), (8, 8, 1, True), (None, None, 1, False),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    digest = exact_duplicates(documents([(1, "x \n y")])).first().text_sha256
    assert digest == hashlib.sha256(b"x y").hexdigest()
    assert exact_duplicates(documents([(1, "x")]).limit(0)).count() == 0


def test_dropping_keeps_columns_and_one_row_each(documents):
    docs = documents(ROWS)
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 8]


def test_stage_keeps_one_row_of_each_text(spark, documents):
    import corpus_pipeline

    docs = documents([(5, "a"), (3, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (None, "a"), (None, "d"), (2, "d"), (5, "b")])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, None).collect()]
    assert sorted(got, key=str) == sorted([(3, "a"), (5, "b"), (None, "c"), (2, "d")], key=str)
    assert sorted(r.doc_id for r in drop_duplicates(docs).collect()) == [2, 3, 5]


def test_index_outlives_the_session_and_batches(spark, documents, folder):
    first = DigestIndex(spark, folder, buckets=4)
    first.add(digests(documents([(10, "a"), (11, "b"), (12, "a")])))
    first.close()
    again = DigestIndex(spark, folder, buckets=99)  # the layout on disk counts
    assert again.buckets == 4
    got = {r.doc_id: (r.keep_id, r.n_rows) for r in again.add(digests(documents([(1, "a"), (2, "c"), (3, "c")]))).collect()}
    assert got == {1: (10, 1), 2: (2, 2), 3: (2, 2)}
    assert again.read().count() == 3
    # A batch that is added once more finds itself, and appends nothing.
    again.add(digests(documents([(2, "c"), (3, "c")])))
    assert again.read().count() == 3
    plan = again.read().join(again.read().withColumnRenamed("keep_id", "k"), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" not in plan


def test_one_hot_group(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    got = exact_duplicates(docs)
    assert got.filter("keep_id = 0 AND group_size = 1334").count() == 1334
    assert got.filter("kept").count() == 4000 - 1333


PAGES = [
    (2, "http://a.example/ü x\r\nX: y", "p" * 100), (1, None, "p" * 100), (3, "http://a", "p" * 99), (4, "http://b", "p" * 99),
    (5, "", None), (6, "http://c", ""), (2, "http://d", "p" * 100), (None, "http://e", "é" * 60), (7, "http://f", "é" * 60),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, shard int, kind string")


def test_archive_round_trip(spark, pages, folder):
    manifest = warc.write_archive(pages, folder, shard_bytes=200, roll_bytes=600)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES) and manifest.count() > 2
    got = sorted(map(tuple, warc.read_archive(spark, folder).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for page_id, _, html in PAGES:
        size = len((html or "").encode())
        first = {"p" * 100: 1, "é" * 60: 7}.get(html)
        again = size >= 100 and page_id is not None and page_id > first
        want.append((page_id, size, sha(html), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)


def test_archives_are_the_same_each_time_and_readable_by_gzip(spark, pages, folder):
    names = []
    for part in ("/one", "/two"):
        warc.write_archive(pages.repartition(3), folder + part, shard_bytes=200, roll_bytes=600)
        rows = spark.read.parquet(f"{folder}{part}/_manifest").orderBy("name").collect()
        names.append([(r.name, r.sha256) for r in rows])
        for row in rows:
            files, base = warc.filesystem(folder + part)
            data = files.open_input_stream(f"{base}/{row.name}", compression=None).read()
            assert hashlib.sha256(data).hexdigest() == row.sha256
            heads = re.findall(rb"WARC/1.1\r\nWARC-Type: (\w+)", gzip.decompress(data))
            assert heads[0] == b"warcinfo" and len(heads) == row.records + 1
    assert names[0] == names[1]


def test_damage_is_found_and_empty_tables_work(spark, pages, folder):
    record = warc.page_record(1, 1, "http://a", b"x" * 200, None)
    plain = gzip.decompress(record).replace(b"x" * 200, b"y" * 200)
    with pytest.raises(ValueError, match="damaged"):
        warc.page_row(plain)
    warc.write_archive(pages.limit(0), folder)
    assert warc.read_archive(spark, folder).count() == 0
