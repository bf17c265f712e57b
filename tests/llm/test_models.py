"""Trained operators: held-out accuracy, edge cases, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelshelf.llm import language_id, quality, toxicity
from reelshelf.llm.features import labelled_sample, segments

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"
EDGE = [(1, ""), (2, None), (3, "..."), (4, "word"), (4, "word"), (None, "no id"), (5, "the " * 50_000), (6, "x" * 60_000)]


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, documents, module):
    docs = documents([*EDGE, *((100 + i, f"good text {i}" if i % 2 else "BAD idiot $$$ idiot") for i in range(60))])
    labels = spark.createDataFrame([(100 + i, i % 2, 1 - i % 2) for i in range(60)] + [(1, None, None), (None, 1, 1), (999, 1, 0)], LABELS)
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    # Without labels of both classes there are scores all the same.
    assert module.classify(docs, labels.where("quality = 1")).count() == len(got)
    assert module.classify(docs, labels.limit(0)).count() == len(got)
    assert module.classify(documents([]), labels).count() == 0


def test_held_out_labels_are_not_read(spark, documents):
    docs = documents([(i, "fine words" if i % 2 else "idiot scum") for i in range(400)])
    labels = [(i, 1, 1 - i % 2) for i in range(400)]
    turned = [(i, 1, (i % 2) if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, _, t in labels]
    score = lambda rows: {r.doc_id: r.score for r in toxicity.classify(docs, spark.createDataFrame(rows, LABELS)).collect()}
    assert score(labels) == score(turned)


def test_quality_on_held_out_rows(spark):
    got = quality.classify(read(spark, "documents"), read(spark, "labels")).where("held_out")
    rows = got.join(read(spark, "labels"), "doc_id").select("predicted", "quality").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02


def _plain_features(text):
    """Buckets of one text, counted letter by letter."""
    mask, spread = 0xFFFFFFFF, 0x9E3779B1
    places = [((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) >> 31 & mask) | 1 for k in range(64)]
    gap = lambda c: c in " \t\n\r\x0b\x0c"
    padded, found = f" {text} ", []
    for n in quality.GRAMS:
        for i in range(len(padded) - n + 1):
            window = padded[i : i + n]
            if any(gap(c) for c in window[1:-1]):
                continue
            value = 0
            for c in window:
                value = value * 0x01000193 + (32 if gap(c) else ord(c)) & mask
            found.append((value + n) * spread & mask)
    words = []
    for word in re.split("[ \t\n\r\x0b\x0c]+", text):
        value = sum((b + 1) * places[k % 64] for k, b in enumerate(word.encode())) & mask
        words += [(value ^ value >> 15) * spread & mask] if word else []
    found += words
    found += [0 if a == b else (a * 0x85EBCA6B + b) * spread & mask for a, b in itertools.pairwise(words)]
    return [f >> 32 - quality.BITS for f in found]


def test_quality_scores_against_features_counted_letter_by_letter():
    texts = ["", " ", "a", "two words", "twice twice Twice", "größe  über\tалфавит 漢字文 🙂🙂 é", "x" * 200, "\n\nend ", "漢" * 90]
    table = np.random.default_rng(5).normal(size=1 << quality.BITS)
    want = [1 / (1 + np.exp(-(table[f].mean() if (f := _plain_features(t)) else 0.0))) for t in texts]
    got = quality.text_scores([t.encode() for t in texts], table)
    assert np.allclose(got, want, atol=1e-9)
    assert quality.text_scores([b"bad \xff byte"], table) == quality.text_scores(["bad \ufffd byte".encode()], table)
    # A text has the same score by itself as among others.
    assert np.allclose(got, [quality.text_scores([t.encode()], table)[0] for t in texts], atol=1e-12)


def test_runs_longer_than_a_segment_are_cut_between_letters():
    text = "漢字" * 200_000 + " end"
    parts = [b[1:-1].decode() for _, b, _ in segments([text.encode()])]
    assert "".join(parts) == text and len(parts) > 1
    assert 0 < quality.text_scores([text.encode()], np.ones(1 << quality.BITS))[0] < 1


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.classify(read(spark, "documents"), read(spark, "labels")).where("held_out")
    rows = got.join(read(spark, "labels"), "doc_id").select("predicted", "toxic").collect()
    # This sample has about 320 toxic rows to learn from, few of them in each language.
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.8
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.01


def test_folding():
    fold = toxicity.fold
    assert fold("1D10T") == fold("idiot") == fold("іdіоt") == fold("ｉｄｉｏｔ") == fold("ídïot") == "idiot"
    assert fold("l0ser") == fold("loser") and fold("$tup!d") == fold("stupid")
    assert fold("idiot$$$ 2015") == "idiot$$$ 2015"


DISGUISED = re.compile(r"(?<![^\W_])(?=[\d@$!|]*[^\W\d_])[^\W_]*(?:[\d@$!|]+[^\W_]+|\d+)+")


@given(st.text(alphabet="ab1٣7$!|_ .ß²", max_size=14))
@settings(max_examples=3000, deadline=None)
def test_stand_ins_against_a_pattern_that_tries_every_place(text):
    plain = DISGUISED.sub(lambda m: m[0].translate(toxicity._SIGNS), text)
    assert toxicity._undisguised(text) == plain


def plain_weight(lexicon, text):
    """Every entry and phrase tried at every place of the folded text."""
    folded = toxicity.fold(text)
    alnum = lambda i: 0 <= i < len(folded) and folded[i].isalnum()
    starts = [i for i in range(len(folded)) if not alnum(i - 1)]
    spared = [(i, i + len(p)) for p in lexicon.exceptions for i in starts if folded.startswith(p, i) and not alnum(i + len(p))]
    total = 0.0
    for i in starts:
        if any(a <= i < b for a, b in spared):
            continue
        own = [w for e, w in lexicon.stems.items() if folded.startswith(e, i)]
        own += [w for e, w in lexicon.whole.items() if folded.startswith(e, i) and not alnum(i + len(e))]
        total += max(own, default=0.0)
    return total


PARTS = ["bad", "b4d", "badge", "not", "ape", "@pe", "a", "dog", " ", " ", " ", ".", "!", "\n", "é"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=1500, deadline=None)
def test_weights_against_every_entry_at_every_place(text):
    lexicon = toxicity.Lexicon({"bad": 3.0, "ape": 2.0, "dog": 0.5}, {"bad": 1.0, "ap": 1.5, "do": 1.0}, ["not bad", "bad dog", "ape a", "a bad"])
    assert lexicon.weight(text)[0] == pytest.approx(plain_weight(lexicon, text))


@pytest.mark.parametrize("text", ["!", "|", "1", "$a", "a!", "@ ", "bad dog ", "not bad bad ", "a1"])
def test_a_megabyte_of_one_sign_or_phrase_takes_seconds(text):
    lexicon = toxicity.Lexicon({"bad": 3.0}, {"do": 1.0}, ["not bad", "bad dog"])
    began = time.monotonic()
    lexicon.weight(text * (1_000_000 // len(text)))
    assert time.monotonic() - began < 20


def test_one_row_for_each_labelled_id(spark, documents):
    docs = documents([(1, "b"), (1, "a"), (1, None), (3, None), *[(4, "hot")] * 500, (None, "x")])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (1, 3, 4)] + [(4, 0, 0)], LABELS)
    got = sorted((r.doc_id, r.text, r.label) for r in labelled_sample(docs, labels, "toxic", 10).collect())
    first = min(("a", "b", ""), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    held = {i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert got == [r for r in [(1, first, 1), (3, "", 1), (4, "hot", 0)] if r[0] not in held]


def test_lexicon():
    lexicon = toxicity.Lexicon({"trash": 3.0}, {"moro": 2.0}, ["trash can"])
    assert lexicon.weight("Trash!")[0] == 3 and lexicon.weight("trashy xtrash")[0] == 0
    assert lexicon.weight("moronic oromoro")[0] == 2 and lexicon.weight("the tr4sh can, trash")[0] == 3
    assert lexicon.score("") == 0 and lexicon.score("clean") == 0
    assert lexicon.score("trash here") > lexicon.score("trash here" + " and more" * 50)
    texts = ["idiot day"] * 30 + ["an idiot day"] * 30
    assert toxicity.learn(texts, [1] * 30 + [0] * 30).whole == {} == toxicity.learn(texts, [1] * 60).whole
    learned = toxicity.learn(["you idiot"] * 300 + ["idiot proof plan"] * 4 + ["nice day"] * 300, [1] * 300 + [0] * 304)
    assert "idiot" in learned.whole and "idiot proof" in learned.exceptions
    assert learned.score("idiot proof plan") == 0 < learned.score("what an idiot")


def test_words_of_a_rare_language_enter_the_lexicon():
    """A language with a hundredth of the toxic documents keeps its words, and chance words stay out."""
    random = np.random.default_rng(5)
    filler = lambda: " ".join(f"w{k}" for k in random.integers(0, 4000, 30))
    toxic = [filler() + " idiot" for _ in range(1000)] + [filler() + " bocoos" for _ in range(12)]
    clean = [filler() for _ in range(1000)]
    learned = toxicity.learn(toxic + clean, [1] * len(toxic) + [0] * len(clean))
    assert {"idiot", "bocoos"} == {w.replace("l", "i") for w in learned.whole}
    assert learned.score(filler() + " bocoos") >= toxicity.THRESHOLD > learned.score(filler())


def test_toxicity_on_held_out_rows_of_each_language(spark):
    docs = read(spark, "documents")
    got = toxicity.classify(docs, read(spark, "labels")).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.join(read(spark, "labels").where("toxic = 1"), "doc_id").groupBy("lang").agg(F.avg("predicted").alias("found"))
    assert all(r.found > 0.8 for r in rows.collect())


def test_languages_on_held_out_rows(spark):
    docs = read(spark, "documents")
    got = language_id.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_language_mixtures_and_edge_cases(spark, documents):
    english = "the other thing with them that they think is there"
    german = "schlecht ich auch sich nicht wirklich durch eine sache"
    docs = documents([(i, english) for i in range(20)]).unionByName(documents([(50 + i, german) for i in range(20)], lang="de"))
    docs = docs.unionByName(documents([(90, english + " " + german + " " + german), (91, "12 ... !"), (92, None), (93, "日本"), (94, ""), (None, english), (95, (english + "\n") * 30_000)], lang=None))
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[90].lang_pred == "de" and 0.55 < got[90].score < 0.8
    assert got[0].lang_pred == got[95].lang_pred == got[None].lang_pred == "en" and got[0].score == got[95].score == 1
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (91, 92, 94)) and got[93].lang_pred in ("de", "en")
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language_id.identify(documents([])).count() == 0


def test_language_stage_rejects_gibberish_and_mixtures(spark):
    import corpus_pipeline

    random = np.random.default_rng(1)
    docs = read(spark, "documents").where("length(text) > 200")
    part = {r.lang: r.text for r in docs.orderBy(F.length("text").desc(), "doc_id").limit(2000).collect()}
    equal = " ".join(" ".join(t.split()[k : k + 10]) for k in range(0, 400, 10) for t in part.values())
    words = " ".join("".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(80))
    bad = {-1: words, -2: "это совсем другой язык и слова его не известны", -3: part["en"].encode("utf-16-le").decode("cp1252", "replace"), -4: equal}
    good = {-5: part["en"], -6: part["de"] + " " + part["de"] + " " + " ".join(part["fr"].split()[:20])}
    rows = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in (bad | good).items()], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_filter(spark, docs.unionByName(rows), SF).select("doc_id").collect()}
    assert kept & {*bad, *good} == {*good}
    clean = docs.join(read(spark, "labels").where("quality = 1"), "doc_id").select("doc_id").collect()
    assert np.mean([r.doc_id in kept for r in clean]) > 0.999


def test_sets_of_more_than_three_languages():
    logs = np.where(np.eye(5, dtype=bool), 0.0, -30.0)[np.arange(500) % 5]
    main, score = language_id.choose(logs, np.ones(500), np.array([0]))
    assert len(main) == 1 and abs(score[0] - 0.2) < 0.01


def test_segments_hold_whole_texts():
    texts = [b"aa bb cc", b"", b"x" * 25, b"d e"]
    parts = [b""] * len(texts)
    for numbers, buffer, starts in segments(texts, size=10):
        ends = [*starts[1:], len(buffer) - 1]
        for number, a, b in zip(numbers, starts, ends, strict=True):
            parts[number] += buffer[a + 1 : b]
    assert parts == texts


def test_pipeline_against_a_plain_version(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "language", "exact dedup", "near dedup", "packing"]
    kept, names = docs, docs.columns
    for _, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == names
    ids = {r.doc_id for r in kept.select("doc_id").collect()}

    table = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = sorted((r.doc_id, r.text or "", r.lang) for r in docs.collect())
    rows = [r for r, s in zip(rows, quality.text_scores([t.encode() for _, t, _ in rows], table), strict=True) if s >= quality.THRESHOLD]
    good = docs.where(docs["doc_id"].isin([i for i, _, _ in rows]))
    langs, likely = language_id.fit(good)
    least = language_id.least_fit(good, langs, likely)
    judged = zip(*language_id.judge_texts([t.encode() for _, t, _ in rows], langs, likely), strict=True)
    rows = [r for r, (lang, s, fit) in zip(rows, judged, strict=True) if lang != "und" and s >= 1 / 3 and fit >= least]
    first = {}
    for i, t, _ in rows:
        first.setdefault(" ".join(t.split()), (i, t))
    sets = {}
    for i, t in first.values():
        words = t.encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    owner = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((owner[i], owner[j]))
                owner = {k: low if o == high else o for k, o in owner.items()}
    want = {i for i, o in owner.items() if o == i}
    assert ids == want
    pieces = pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == ids
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
