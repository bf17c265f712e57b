"""Dual-tree search against all scores, and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from reelshelf.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def all_scores(docs, items, top=50):
    """Every pair scored: sorted (item_id, rank, doc_id, score)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, bag in bags:
            base = 50 + 50 * bag.total() * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * base))
                for t in set(terms(text))
                if bag[t]
            )
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        for rank, (score, known, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, i if known else None, -score))
    return out


def ranked(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


DOCS = "doc_id long, text string, n string, terms int, base string, item_id long"


@pytest.fixture
def corpus(spark):
    def make(docs, items):
        return (
            spark.createDataFrame([(*d, "x", 1, "y", 9) for d in docs], DOCS),
            spark.createDataFrame([(*i, 5, 6) for i in items], "item_id long, text string, doc_id long, score long"),
        )

    return make


def words(rng, n, vocabulary=300):
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}" for _ in range(n))


def test_against_all_scores(corpus):
    """Skewed words, groups of equal texts whose ties the id decides, many Arrow batches."""
    rng = random.Random(7)
    docs = [(i, words(rng, rng.randint(0, 60))) for i in range(900)]
    docs += [(i, "W1 w2, w290") for i in range(2000, 1000, -1)]  # ties, larger ids first
    docs += [(None, "w2 w290 w1"), (None, None), (5000, ""), (5001, "é-É Éé 3x")]
    items = [(k, words(rng, rng.randint(1, 12))) for k in range(30)] + [(40, "w1"), (41, "w290 w2"), (42, "unseen"), (43, ""), (44, None), (45, "éé É É"), (45, "éé É É")]
    table, wanted = corpus(docs, items)
    spark = table.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert ranked(ls.search(table.repartition(3), wanted)) == all_scores(docs, items)
        assert ranked(ls.search(table.coalesce(1), wanted, top=3)) == all_scores(docs, items, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_items_and_slices_of_texts(corpus, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_BYTES", 2500)
    rng = random.Random(8)
    docs = [(i, words(rng, 40)) for i in range(100)] + [(500, "long " * 50_000 + "w3 end")]
    items = [(k, words(rng, 5)) for k in range(7)] + [(9, "end long")]
    assert ranked(ls.search(*corpus(docs, items))) == all_scores(docs, items)
    text = ("Ab,c\x00é1 " * 1000).encode()
    monkeypatch.setattr(ls, "SLICE_BYTES", 100)
    assert [t.decode() for part in ls.slices(text) for t in part] == terms(text.decode())
    assert list(ls.slices(b"x" * 1000)) == [[b"x" * 1000]]


def test_empty_tables(corpus):
    table, items = corpus([(1, "a b")], [(1, "a")])
    assert ls.search(table.limit(0), items).count() == 0
    assert ls.search(table, items.limit(0)).count() == 0
    assert ls.search(table, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    """No node product is below a pair under it; most pairs of two unlike groups are left out."""
    rng = np.random.default_rng(1)
    width = 400
    weights = rng.integers(1, 5000, width)
    items = [np.sort(rng.choice(np.arange(200) + 200 * (i % 2), 12, replace=False)) for i in range(40)]
    tree = ls.ItemTree(items, weights)
    sizes = np.full(3000, 20)
    docs = [np.sort(rng.choice(np.arange(200) + 200 * (i % 2), 20, replace=False)) for i in range(3000)]
    worth = rng.integers(1, 1_000_000, 3000 * 20)
    ids = np.arange(3000)
    found = ls.DocumentTree(ids, ids >= 0, sizes, np.concatenate(docs), worth, tree, weights)
    for level in range(1, len(found.levels)):
        starts, terms_, worth_ = found.levels[level]
        below = found.levels[level - 1]
        for node in range(len(starts) - 1):
            top = dict(zip(terms_[starts[node] : starts[node + 1]], worth_[starts[node] : starts[node + 1]]))
            for child in found.children(level, node):
                a, b = below[0][child], below[0][child + 1]
                assert all(top[t] >= w for t, w in zip(below[1][a:b], below[2][a:b]))
    search = ls.Search(tree, weights, 10)
    search.add(found)
    assert search.visited["pairs"] < 0.45 * 3000 * 40
    dense = np.zeros((3000, width), dtype=np.int64)
    for d in range(3000):
        dense[d, docs[d]] = worth[d * 20 : d * 20 + 20]
    for place, item in enumerate(tree.order):
        scores = dense[:, items[item]] @ weights[items[item]]
        want = sorted(((-s, d) for d, s in enumerate(scores) if s > 0))[:10]
        assert sorted((-s, -k[1]) for s, k in search.lists.best[place]) == [(s, d) for s, d in want]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    from oracle import connect

    folder = f"/root/testdata/{sf}"
    df = ls.op13_lexical_search(spark, folder)
    rel = connect(folder).sql(ls.OP13_SQL).select("item_id", "rank", "doc_id", "score")
    assert ranked(df) == sorted(rel.fetchall())
