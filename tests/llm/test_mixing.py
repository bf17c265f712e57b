"""Source mixing against its contract and against plain resharing."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from reelshelf.llm import source_mixing as sm


def plain_targets(sizes):
    """Targets by source, the excess reshared round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        units = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / units > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * left / units for s in names}
        full |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, rows):
    """The contract of the query, for (doc_id, text, source) documents with ids of their own."""
    size = {i: words(t) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    sums = defaultdict(int)
    for i, s in source.items():
        sums[s] += size[i]
    want, got, largest = plain_targets(sums), defaultdict(int), defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sums[s])
        assert r.target == pytest.approx(want[s], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        got[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in want:
        assert abs(got[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    return got, want, largest


def query(docs):
    rows = sm.mix(docs, ["doc_id"])
    return rows.selectExpr("row.doc_id AS doc_id", "size", "source_size", "target", "copies * size AS taken").collect()


DOCS = "doc_id long, text string, source string, size string, _source int, row int, _chance double"


def test_word_count(spark):
    texts = ["", " ", None, "a", " a  b\t\n c ", "a\x0bb\x0cc d", " ", "x " * 200_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = dict(rows.select("i", sm.word_count(rows.text)).collect())
    assert [got[i] for i in range(len(texts))] == [words(t) for t in texts]


def test_contract_on_skewed_sources(spark, monkeypatch):
    """A hot source, single documents, sources without words, a null source, clashing columns."""
    monkeypatch.setattr(sm, "BLOCK_ROWS", 100)
    rng = random.Random(3)
    docs = []
    for i in range(4000):
        source = rng.choice(["hot"] * 6 + ["b", "é", "z", None, f"s{rng.randint(0, 40)}", "empty"])
        n = 0 if source == "empty" else min(int(rng.paretovariate(1.1) * 3), 3000)
        docs.append((i, "w " * n if rng.random() < 0.95 else None, source))
    docs += [(4000, "one two three", "single"), (4001, "w " * 50_000, "long"), (4002, "", "zero")]
    table = spark.createDataFrame([(*d, "x", 1, 2, 0.5) for d in docs], DOCS)
    rows = query(table)
    got, want, largest = check(docs, rows)
    # Where there are small documents, the words of the large ones are made up for.
    assert abs(got["hot"] - want["hot"]) <= want["hot"] / 200 < largest["hot"] / 20
    again = query(table.repartition(37))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (None, None, None), (2, None, "s")]
    table = spark.createDataFrame([(*d, "x", 1, 2, 0.5) for d in rows], DOCS)
    out = query(table)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in out) == [(False, 1, 3), (False, 1, 3), (False, 2, 0), (True, 0, 0), (True, 0, 2)]
    assert query(table.limit(0)) == []
    taken = sm.mixed(table)
    assert taken.columns == table.columns
    assert taken.count() == sum(r.taken // r.size for r in out if r.size) + taken.where("coalesce(text, '') = ''").count()


def test_flight_keeps_expectations():
    """Over many draws a document is taken as often as its probability says, and sums stay."""
    chances, sizes, runs = [0.2, 0.5, 0.7, 0.4, 0.9, 0.3], [10, 8, 8, 5, 3, 2], 4000
    taken = [0] * 6
    for run in range(runs):
        flight, out = sm.Flight(f"{run}"), {}
        for i, (c, s) in enumerate(zip(chances, sizes)):
            out.update(flight.add(c, s, i))
        left = {u[2]: u[0] for u in flight.units}
        assert len(left) <= 2 and set(out) | set(left) == set(range(6))
        total = sum(s * (out | left)[i] for i, s in enumerate(sizes))
        assert total == pytest.approx(sum(c * s for c, s in zip(chances, sizes)), abs=1e-6)
        assert sum((out | left).values()) == pytest.approx(sum(chances), abs=1e-6)
        for i, c in (out | left).items():
            taken[i] += c
    assert [t / runs for t in taken] == pytest.approx(chances, abs=0.04)


def test_landing_is_the_closest_outcome():
    flight = sm.Flight("x")
    flight.units = [[0.6, 10, "a"], [0.3, 4, "b"]]
    assert dict(flight.land()) == {"a": 1, "b": 0}  # 7.2 words wanted: 10 is closer than 4
    assert sm.Flight("y").land() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_sample(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()
    check([tuple(d) for d in docs], sm.op12_source_mix(spark, folder).collect())
