"""Quality scores by supervised subword embeddings.

Words, pairs of adjacent words and character n-grams of words are hashed to vectors
(all pairs of equal words to one); a document is the average of its vectors, and a
softmax layer gives the score. Characters are code points, so a letter counts the same
in any script. Vectors and layer are trained by stochastic gradient descent in numpy,
on at most ``PER_CLASS`` labelled documents of each class, in one task. The step of a
vector is the gradient of the averaged vector over the square root of its share, since
the plain gradient hardly moves the vectors of a long text. As the layer is linear,
each vector is reduced to its own difference of class scores afterwards, so scoring a
document takes one number for each of its features.

Defined results: null and empty texts have no features and score one half; without
labelled rows of both classes every text does. Rows that repeat are each scored.
Only the id and text of a document are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import held_out, read_table
from reelshelf.llm.features import gram_hashes, labelled_sample, segments, spaces, word_bounds, word_hashes

PER_CLASS = 1500  # labelled documents of each class that the model is trained on
THRESHOLD = 0.7
BITS = 17  # of a bucket
SIZE = 12  # numbers of a vector
STEPS = 12_000  # of gradient descent, over the sample again and again
RATE = 1.0
GRAMS = (3, 4, 5)


def features(buffer: bytes, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, part, in use) of each kind of feature in a block of parts of texts."""
    data = np.frombuffer(buffer, dtype=np.uint8)
    gaps, shift = spaces(data), np.uint32(32 - BITS)
    # Parts begin and end between letters, so the buffer is valid as a whole.
    chars, heads = np.frombuffer(buffer.decode().encode("utf-32-le"), dtype="<u4"), np.flatnonzero((data & 0xC0) != 0x80)
    owner = np.searchsorted(starts, heads, side="right") - 1
    for hashes, whole in gram_hashes(chars, gaps[heads], GRAMS):
        yield hashes >> shift, owner[: len(hashes)], whole
    first, last = word_bounds(gaps)
    words = word_hashes(data, first, last)
    part = np.searchsorted(starts, first, side="right") - 1
    yield words >> shift, part, np.ones(len(words), dtype=bool)
    pairs = (words[:-1] * np.uint32(0x85EBCA6B) + words[1:]) * np.uint32(0x9E3779B1)
    pairs[words[:-1] == words[1:]] = 0  # a word said twice, whichever it is
    yield pairs >> shift, part[:-1], part[:-1] == part[1:]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> np.ndarray:
    """Difference of class scores of each bucket."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE)).astype(np.float32)
    layer = random.uniform(-1, 1, (2, SIZE)).astype(np.float32)
    rows = []
    for text in texts:
        counts = np.zeros(1 << BITS, dtype=np.float32)
        for _, buffer, starts in segments([text]):
            for bucket, _, used in features(buffer, starts):
                counts += np.bincount(bucket[used], minlength=1 << BITS)
        held = np.flatnonzero(counts)
        rows.append((held, counts[held] / max(1.0, float(counts.sum()))))
    rounds = -(-STEPS // len(rows))
    steps, step = rounds * len(rows), 0
    for _ in range(rounds):
        for k in random.permutation(len(rows)):
            rate, step = RATE * (1 - step / steps), step + 1
            held, share = rows[k]
            if not len(held):
                continue
            average = share @ vectors[held]
            scores = layer @ average
            odds = np.exp(scores - scores.max())
            error = odds / odds.sum()
            error[labels[k]] -= 1
            pull = layer.T @ error
            layer -= rate * np.outer(error, average)
            vectors[held] -= (rate * np.sqrt(share))[:, None] * pull[None]
    return vectors @ (layer[1] - layer[0])


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    rows = pd.concat(parts).sort_values("doc_id")
    if rows["label"].nunique() == 2:
        table = train([(t or "").encode() for t in rows["text"]], rows["label"].to_numpy())
        yield pd.DataFrame({"model": [table.astype("<f4").tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> np.ndarray:
    """Trained differences of class scores; zeros without rows of both classes."""
    sample = labelled_sample(docs, labels, label, per_class).repartition(1)
    found = sample.mapInPandas(_train, "model binary").collect()
    return np.frombuffer(found[0].model, dtype="<f4") if found else np.zeros(1 << BITS, dtype=np.float32)


def valid(texts: list[bytes]) -> list[bytes]:
    """The same texts, with a replacement character for bytes that are not UTF-8."""
    try:
        b" ".join(texts).decode()
    except UnicodeDecodeError:
        return [t.decode(errors="replace").encode() for t in texts]
    return texts


def text_scores(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    texts = valid(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for numbers, buffer, starts in segments(texts):
        for bucket, part, used in features(buffer, starts):
            owner = numbers[part]
            total += np.bincount(owner, np.where(used, table[bucket], 0), minlength=len(texts))
            count += np.bincount(owner, used, minlength=len(texts))
    return 1 / (1 + np.exp(-total / np.maximum(count, 1)))


def _score(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t.as_py() or b"" for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(text_scores(texts, table))], ["doc_id", "score"]
                )

    return run


def scores(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _score(table), "doc_id long, score double"
    )


def keep(docs: DataFrame, table: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score ``threshold`` or more, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [(t.as_py() or "").encode() for t in part.column("text")]
                yield part.filter(pa.array(text_scores(texts, table) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
