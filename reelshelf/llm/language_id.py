"""Language proportions of documents by expectation-maximisation.

Each language has a distribution over the byte trigrams of words, counted over all
training documents. The likelihood of a word in a language is that of its trigrams.
For a document, expectation-maximisation over its words gives the proportions of a
mixture of languages. Sets of one language and more (those with the highest
proportions) are then compared by their likelihood, less a penalty for each further
language, until no larger set can pay for it. The best set gives the answer: its main
language, and that one's proportion as the score.

The filter also asks whether a document is in any language at all: its trigrams, each
word taken in its best language, must be likely against a background in which all
buckets are equal. The margin lies halfway between the background and what nearly all
training documents reach (``least_fit``).

Letters are lower-cased if ASCII; digits, signs and white space separate words.
Word likelihoods are relative to the best language, rounded to an eighth and
bounded below, so equal words can be counted together and the memory for a
document does not grow with its length.

Defined results: a text that is null or has no letter is ``und`` with score zero,
and so is every text if no document has a language. Ties go to the language that
comes first in the alphabet. Rows that repeat are each returned. Only id, text and,
for training, language are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import held_out, read_table
from reelshelf.llm.features import gram_hashes, segments, word_bounds

UNKNOWN = "und"
BITS = 16  # of a trigram's bucket
SMOOTH = 0.05  # added to each count
ROUNDS = 8  # of expectation-maximisation
PENALTY = 3.0  # times the logarithm of the words, for each further language
FLOOR = -40.0
BACKGROUND = -BITS * float(np.log(2))  # log-likelihood of a trigram if all buckets are equal
FIT_ROWS = 20_000  # training documents from which the margin of the filter is learned
FIT_SHARE = 0.01  # of them that may be less likely than its upper end
_LETTER = re.compile(r"[^\W\d_]")

# Lower case for ASCII letters, a space for all other ASCII, the rest as it is.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def trigrams(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word, one after another, and the words' starts and ends."""
    data = _FOLD[np.frombuffer(buffer, dtype=np.uint8)]
    gaps = data == 32
    starts, ends = word_bounds(gaps)
    for hashes, whole in gram_hashes(data, gaps, (3,)):
        # A window with a gap in its middle belongs to no word.
        return np.where(whole, hashes >> np.uint32(32 - BITS), 0), starts, ends
    return np.zeros(0, dtype=np.uint32), starts, ends


def _windows(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of the trigrams of all words; a word of n bytes has n, from the gap before it."""
    size = ends - starts
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(starts - 1, size) + within


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            texts = [t.as_py() for t, own in zip(batch.column("text"), langs, strict=True) if own == lang]
            held = totals.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            for _, buffer, _ in segments(texts):
                buckets, starts, ends = trigrams(buffer)
                held += np.bincount(buckets[_windows(starts, ends)], minlength=1 << BITS)
    for lang, held in totals.items():
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(found)), pa.array(found.astype(np.int32)), pa.array(held[found])],
            ["lang", "bucket", "n"],
        )


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and (bucket, language) log-probabilities.

    What reaches the driver is one count for each language and bucket at most.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(
        "lang", F.col("text").cast("binary").alias("text")
    )
    counted = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.full((1 << BITS, len(langs)), SMOOTH)
    place = {lang: k for k, lang in enumerate(langs)}
    owner = np.array([place[x] for x in table.column("lang").to_pylist()], dtype=np.int64)
    np.add.at(counts, (table.column("bucket").to_numpy(), owner), table.column("n").to_numpy())
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def word_likelihoods(buffer: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, log-likelihood relative to the best language, that of the best one, trigrams) of each word."""
    buckets, starts, ends = trigrams(buffer)
    if not len(starts):
        return starts, np.zeros((0, table.shape[1])), np.zeros(0), np.zeros(0, dtype=np.int64)
    size = ends - starts
    windows = table[buckets[_windows(starts, ends)]]
    sums = np.add.reduceat(windows, np.cumsum(size) - size, axis=0, dtype=np.float64)
    best = sums.max(axis=1)
    return starts, np.maximum(np.round((sums - best[:, None]) * 8) / 8, FLOOR), best, size


def _mixture(likely: np.ndarray, weight: np.ndarray, first: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; its words begin at ``first``."""
    sizes = np.diff(np.r_[first, len(likely)])
    total = np.add.reduceat(weight, first)[:, None]
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        part = likely * np.repeat(share, sizes, axis=0)
        part *= (weight / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total
    fit = np.log(np.maximum((likely * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-300)) * weight
    return share, np.add.reduceat(fit, first)


def choose(logs: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Main language and its proportion for each document."""
    likely, langs = np.exp(logs), logs.shape[1]
    share, whole = _mixture(likely, weight, first, np.ones((len(first), langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    sizes = np.diff(np.r_[first, len(logs)])
    single = np.take_along_axis(logs, np.repeat(order[:, :1], sizes, axis=0), 1)[:, 0]
    best = np.add.reduceat(single * weight, first)
    main, score = order[:, 0].copy(), np.ones(len(first))
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(weight, first), 2))
    # No set fits better than all languages together, so most need not be tried.
    tried = np.flatnonzero(whole - cost > best)
    for size in range(2, langs + 1):
        tried = tried[whole[tried] - cost[tried] * (size - 1) > best[tried]]
        if not len(tried):
            break
        picked = np.zeros((len(tried), langs))
        np.put_along_axis(picked, order[tried, :size], 1.0, 1)
        rows = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in tried])
        begins = np.cumsum(np.r_[0, sizes[tried]])[:-1]
        part, fitted = _mixture(likely[rows], weight[rows], begins, picked)
        fitted -= cost[tried] * (size - 1)
        better = fitted > best[tried]
        at = tried[better]
        best[at], main[at], score[at] = fitted[better], part[better].argmax(axis=1), part[better].max(axis=1)
    return main, score


def predict_texts(texts: list[bytes | None], langs: list[str], table: np.ndarray) -> tuple[list[str], list[float]]:
    """Main language and its proportion for each text."""
    return judge_texts(texts, langs, table)[:2]


def judge_texts(
    texts: list[bytes | None], langs: list[str], table: np.ndarray
) -> tuple[list[str], list[float], list[float]]:
    """Main language, its proportion, and the mean log-likelihood of a trigram for each text."""
    found, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    fits, counts = np.zeros(len(texts)), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if t and langs and _LETTER.search(t.decode("utf-8", "replace"))]
    owners, logs, weights = [], [], []
    for numbers, buffer, starts in segments([texts[k] for k in known]):
        first, rows, best, sizes = word_likelihoods(buffer, table)
        owner = numbers[np.searchsorted(starts, first, side="right") - 1]
        fits += np.bincount(owner, best, minlength=len(texts))
        counts += np.bincount(owner, sizes, minlength=len(texts))
        weight = np.ones(len(rows))
        if len(numbers) == 1 and len(rows) > 10_000:  # a part of a long text
            rows, weight = np.unique(rows, axis=0, return_counts=True)
            owner, weight = np.full(len(rows), numbers[0]), weight.astype(np.float64)
        owners.append(owner), logs.append(rows), weights.append(weight)
    means = np.full(len(texts), -np.inf)
    means[np.array(known, dtype=np.int64)] = (fits / np.maximum(counts, 1))[: len(known)]
    if not owners:
        return found, scores, means.tolist()
    owner, logs, weight = np.concatenate(owners), np.concatenate(logs), np.concatenate(weights)
    if not len(owner):
        return found, scores, means.tolist()
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    main, score = choose(logs, weight, first)
    for k, lang, value in zip(owner[first], main, score, strict=True):
        found[known[k]], scores[known[k]] = langs[lang], float(min(1.0, value))
    return found, scores, means.tolist()


def _predict(langs: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found, scores = predict_texts(part.column("text").to_pylist(), langs, table)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _predict(langs, table), "doc_id long, lang_pred string, score double"
    )


def least_fit(docs: DataFrame, langs: list[str], table: np.ndarray) -> float:
    """Least mean log-likelihood of a trigram in a document that is in a language.

    Learned from about ``FIT_ROWS`` of the training documents, those with the smallest
    hash of their id. Without any it is the background.
    """
    named = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    known = docs.where(named & ~held_out())
    bound = int((1 << 40) * min(1.0, FIT_ROWS / max(1, known.count())))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < bound).select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                fits = judge_texts(batch.slice(k, 256).column("text").to_pylist(), langs, table)[2]
                yield pa.RecordBatch.from_arrays([pa.array([f for f in fits if np.isfinite(f)], pa.float64())], ["fit"])

    low = some.mapInArrow(run, "fit double").agg(F.percentile("fit", FIT_SHARE)).first()[0]
    return BACKGROUND if low is None else BACKGROUND + max(0.0, low - BACKGROUND) / 2


def keep(docs: DataFrame, langs: list[str], table: np.ndarray, least: float, fit: float = -np.inf) -> DataFrame:
    """Documents whose main language has a share of ``least`` or more, with all their columns, in one pass.

    Their trigrams must have a mean log-likelihood of ``fit`` or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = judge_texts([(t.as_py() or "").encode() for t in part.column("text")], langs, table)
                good = [lang != UNKNOWN and s >= least and f >= fit for lang, s, f in zip(*rows, strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return predict(docs, *fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
