"""Near-duplicate texts and vectors against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from reelshelf.llm import embedding_dedup, simhash
from reelshelf.llm.common import attach, components, running_total
from reelshelf.session import materialise


def smallest(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_documents(documents):
    base = " ".join(f"w{i * i % 997}" for i in range(400))
    texts = [base, base.upper(), base.replace("w4 ", "v4 "), base + " tail", "", None, " \n", "one", "ONE two", "É é", "x " * 5000]
    pairs = [*enumerate(texts, 10), (3, base), (3, base), (None, base), (None, "alone")]
    got = sorted(map(tuple, simhash.near_duplicates(documents(pairs)).collect()), key=str)
    prints = [(i, plain_fingerprint(t)) for i, t in pairs]
    known = [(i, f) for i, f in prints if i is not None]
    find = smallest([i for i, _ in known], [(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 2])
    owner = {f: find[i] for i, f in known}
    assert got == sorted(((i, f"{f:016x}", find.get(i, owner.get(f))) for i, f in prints), key=str)
    assert simhash.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("group", [4096, 32])
def test_index_finds_every_link(spark, group):
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 12, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << random.integers(0, 64, n).astype(np.uint64)
    codes = np.unique(np.concatenate([base, *(base[random.integers(0, 12, 250)] ^ flip(250) ^ flip(250) for _ in range(3))]))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 2
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    order = np.argsort(rank)
    pairs = {(a, b) for x, y in simhash.linked(codes[order]) for a, b in zip(order[x].tolist(), order[y].tolist(), strict=True)}
    assert {(min(p), max(p)) for p in pairs} == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if a < b}

    vertices = spark.createDataFrame([(int(c), i) for i, c in enumerate(codes.view(np.int64))], "fp long, id long")
    links = materialise(simhash.near_links(materialise(vertices), group=group))
    assert links.count() <= 3 ** (4 if group < 4096 else 1) * len(codes)  # stars, not pairs
    found = dict(map(tuple, components(links).collect()))
    want = smallest(range(len(codes)), zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1))), strict=True))
    assert {i: found.get(i, i) for i in want} == want


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(9, 9), (8, 7), (7, 8)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {k: v for k, v in smallest({x for p in links for x in p}, links).items() if k != 9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_and_running_totals(spark):
    rows = spark.createDataFrame([(i, "h" if i % 2 else f"k{i}" if i % 4 else None) for i in range(3000)], "id long, key string")
    groups = materialise(rows.where("key IS NOT NULL AND key <> 'k2'").groupBy("key").count().withColumnRenamed("count", "n_rows"))
    got = {r.id: r.n_rows for r in attach(rows, groups, "key").collect()}
    assert got == {i: 1500 if i % 2 else (None if i % 4 == 0 or i == 2 else 1) for i in range(3000)}
    totals = running_total(rows.withColumn("v", rows["id"] % 5), "v", ["id"], ["key"]).where("key = 'h'").orderBy("id").collect()
    assert [r.before for r in totals] == np.cumsum([0, *(r.v for r in totals)])[:-1].tolist()


def brute_vectors(rows):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    count, links = {i: 0 for i, _ in rows}, []
    for dim in {len(v) for _, v in good}:
        same = [(i, v) for i, v in good if len(v) == dim]
        x = embedding_dedup.units(np.array([v for _, v in same], dtype=np.float32))
        for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
            if a != b:
                count[same[a][0]] += 1
                links.append((same[a][0], same[b][0]))
    find = smallest([i for i, _ in rows if i is not None], links)
    return {(i, count[i], find.get(i), i is not None and find[i] == i) for i, _ in rows}


@pytest.mark.parametrize(("residents", "visitors"), [(4096, 16_384), (40, 60)])
def test_vectors(spark, monkeypatch, residents, visitors):
    monkeypatch.setattr(embedding_dedup, "RESIDENTS", residents)
    monkeypatch.setattr(embedding_dedup, "VISITORS", visitors)
    random = np.random.default_rng(0)
    centres = random.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * random.standard_normal(16)).tolist()) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [float("nan")] * 16)]
    rows += [(2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (2007, [-0.0, 1.0]), (2008, [0.0, 2.0]), (2009, [3.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, b"k") for r in rows], "vec_id long, embedding array<float>, label int, key binary")
    assert {tuple(r) for r in embedding_dedup.near_vectors(df).collect()} == brute_vectors(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_sample_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(2000)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute_vectors(rows)
    got = {tuple(r) for r in embedding_dedup.near_vectors(df).collect()}
    assert sum(n for _, n, _, _ in got) >= 0.99 * sum(n for _, n, _, _ in want)


def test_near_stage_finds_every_pair_by_brute_force(spark):
    import corpus_pipeline
    from reelshelf.llm import shingle_dedup

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: set(zip(*(r.text.encode().lower().split()[k:] for k in range(5)), strict=False)) or r.text.lower() for r in docs.collect()}
    sizes = {i: len(s) for i, s in sets.items()}
    pairs = [
        (a, b)
        for a, x in sets.items()
        for b, y in sets.items()
        if a < b and type(x) is type(y) and 4 * max(sizes[a], sizes[b]) <= 5 * min(sizes[a], sizes[b])
        and (x == y if isinstance(x, str) else 5 * len(x & y) >= 4 * len(x | y))
    ]
    assert sum(sets[a] != sets[b] for a, b in pairs) >= 10
    find = smallest(sets, pairs)
    got = [r.doc_id for r in corpus_pipeline.near(spark, docs, None).collect()]
    assert sorted(got) == sorted(set(find.values()))
    assert shingle_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_stage_links_members_that_are_far_from_the_first(spark, documents):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join("v" + str(k) if k in at else w for k, w in enumerate(words))
    # Neighbours are similar, the ends of the chain are not; ids and nulls that repeat.
    pairs = [(9, edit()), (7, edit(50)), (8, edit(50, 100)), (6, edit(50, 100, 150)), (5, edit(50, 100, 150, 20, 120))]
    pairs += [(1, "x y"), (1, "z"), (None, "z"), (None, "other"), (2, "X  y")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, documents(pairs), None).collect()), key=str)
    assert got == sorted([(5, pairs[4][1]), (1, "x y"), (1, "z"), (None, "other")], key=str)


def test_near_stage_on_template_pages(spark, documents):
    """Pages that share most of their words, none a duplicate: few pairs bring their texts along."""
    from reelshelf.llm import shingle_dedup as sd

    rng = random.Random(4)
    frame = [f"t{i}" for i in range(100)]
    texts = [" ".join(frame + [f"u{rng.randint(0, 10**9)}" for _ in range(35)]) for _ in range(400)]
    texts.append(texts[0].replace("t50", "x50"))
    docs = documents(list(enumerate(texts)))
    given = docs.selectExpr("struct(doc_id) AS row", "CAST(text AS BINARY) AS text")
    rows = given.mapInArrow(sd._sketches, "row struct<doc_id:bigint>, vertex binary, size int, bands array<bigint>, marks binary")
    keys = rows.selectExpr("explode(bands) AS key", "vertex")
    pairs = keys.alias("l").join(keys.alias("r"), "key").where("l.vertex < r.vertex").selectExpr("l.vertex a", "r.vertex b").distinct()
    marks = rows.select("vertex", "marks")
    both = pairs.join(marks.toDF("a", "marks_a"), "a").join(marks.toDF("b", "marks_b"), "b").select("a", "b", "marks_a", "marks_b")
    hopeful = both.mapInArrow(sd._hopeful, "a binary, b binary").count()
    assert 1 <= hopeful < pairs.count() / 3
    assert sorted(r.doc_id for r in sd.drop_near_duplicates(docs).collect()) == list(range(400))


def test_near_stage_hands_on_columns_of_any_name(spark):
    from reelshelf.llm import shingle_dedup as sd

    names = ["vertex", "bands", "marks", "size", "row", "digest", "id", "key", "_vertex", "_digest", "_key", "_id", "unnamed", "first", "kept", "linked", "a", "b"]
    rows = [(i, f"one two three four five six {'x' if i < 2 else i}", *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = sd.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]


def test_near_stage_searches_the_index_and_stores_texts_of_pairs_only(spark, documents, monkeypatch):
    from reelshelf.llm import shingle_dedup as sd

    keep, kept = sd.materialise, {}

    def stored(df, label):
        kept.setdefault(label, []).append(keep(df, label))
        return kept[label][-1]

    monkeypatch.setattr(sd, "materialise", stored)
    rng = random.Random(6)
    pages = [[f"w{rng.randint(0, 10**6)}" for _ in range(600)] for _ in range(40)]
    pages += [["v", *p[1:]] for p in pages[:5]]
    texts = [" ".join(p) for p in pages]
    assert sorted(r.doc_id for r in sd.drop_near_duplicates(documents(list(enumerate(texts)))).collect()) == list(range(40))

    prints = [sd.simhash.fingerprint(t.encode(), 5) for t in texts]
    near = [(i, j) for j in range(45) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= sd.DISTANCE]
    assert near
    vertices = kept["vertices"][0]
    own = {r.vertex: r.first for r in vertices.collect()}
    found = [(own[r.a], own[r.b]) for r in sd._alike(vertices).collect()]
    assert smallest(range(45), found) == smallest(range(45), near)
    # All other tables hold digests and sketches.
    wide = {label for label, tables in kept.items() for t in tables if {"text", "row", "text_a", "text_b"} & set(t.columns)}
    assert wide == {"texts"} and sum(t.count() for t in kept["texts"]) <= 10


def test_near_stage_sends_no_pairs_of_texts_to_python(spark, documents, monkeypatch):
    """Pairs of sets are compared where they are joined, exactly and one by one; a batch of them has no bound in bytes."""
    from reelshelf.llm import shingle_dedup as sd

    keep, plans = sd.materialise, []

    def stored(df, label):
        if label == "verified":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(sd, "materialise", stored)
    page = [f"w{i}" for i in range(3000)]
    texts = [" ".join(page[:k] + ["v"] + page[k + 1 :]) for k in range(0, 3000, 100)]
    assert [r.doc_id for r in sd.drop_near_duplicates(documents(list(enumerate(texts)))).collect()] == [0]
    assert plans and all("Join" in p.partition("MapInArrow")[0] for p in plans)

    batch = pa.RecordBatch.from_pydict({"vertex": [b"%d" % i for i in range(200)], "text": [t.encode() for t in (texts * 7)[:199]] + [None]})
    parts = list(sd._sets(iter([batch])))
    assert max(p.num_rows for p in parts) <= sd.SPLIT and sum(p.num_rows for p in parts) == 200
    assert parts[-1].column("hashes")[-1].as_py() == [] and len(parts[0].column("hashes")[0]) == len(sd.shingles(texts[0].encode()))

    rng = random.Random(8)
    sets = [[]] + [rng.sample(range(-(2**63), -(2**63) + n + 3), n) for n in (1, 4, 5, 8, 9, 10, 20) for _ in range(6)]
    pairs = [(x, y, 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})) for x in sets for y in sets]
    assert 0 < sum(p[2] for p in pairs) < len(pairs)
    rows = spark.createDataFrame(pairs, "x array<bigint>, y array<bigint>, want boolean")
    assert rows.where(sd._similar("x", "y") != rows["want"]).count() == 0


def test_near_stage_lets_go_of_the_encoder(monkeypatch):
    from reelshelf.llm import encoder
    from reelshelf.llm import shingle_dedup as sd

    monkeypatch.setattr(encoder.Encoder, "__init__", lambda self, path: None)
    encoder.encoder("left by an earlier stage")
    batch = pa.RecordBatch.from_pydict({"row": [1], "text": [b"a b"]})
    assert sum(b.num_rows for b in sd._marked(iter([batch]))) == 1
    assert encoder.encoder.cache_info().currsize == 0
