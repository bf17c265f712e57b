"""Hashed n-grams of words, for whole batches of texts at once, and labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelshelf.llm.common import held_out

SEGMENT = 1 << 20  # bytes looked at together; a longer text is cut at white space
_SPACES = b" \t\n\r\x0b\x0c"
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
# One odd factor for each place in a word; longer words start again.
_PLACES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)


def segments(texts: list[bytes], size: int = SEGMENT) -> Iterator[tuple[np.ndarray, bytes, np.ndarray]]:
    """(text numbers, buffer, starts): parts of texts, each behind one space, up to ``size`` bytes in all.

    A run of more than ``size`` bytes without white space is cut at the last letter that ends
    before.
    """
    numbers, parts, total = [], [], 0

    def block():
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])]) if parts else np.zeros(0, dtype=np.int64)
        return np.array(numbers, dtype=np.int64), b" " + b" ".join(parts) + b" ", starts

    for number, text in enumerate(texts):
        start = 0
        while start < len(text) or not start:
            end = min(len(text), start + size)
            if end < len(text):
                space = max(text.rfind(c, start, end) for c in (b" ", b"\n"))
                end = space + 1 if space > start else end
                while end > start + 4 and text[end] & 0xC0 == 0x80:
                    end -= 1
            if parts and total + end - start > size:
                yield block()
                numbers, parts, total = [], [], 0
            numbers.append(number)
            parts.append(text[start:end])
            total += end - start
            start = end
            if not len(text):
                break
    if parts:
        yield block()


def spaces(data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    known = np.zeros(256, dtype=bool)
    known[list(_SPACES)] = True
    return known[data]


def gram_hashes(data: np.ndarray, gaps: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of all windows, and whether a window holds no gap inside.

    ``data`` holds bytes or code points. A gap at either end stands for the start or end
    of a word, and is hashed as a space.
    """
    plain = np.where(gaps, np.uint32(32), data).astype(np.uint32)
    before = np.concatenate([[0], np.cumsum(gaps, dtype=np.int32)])
    chain = plain
    for n in range(2, max(sizes) + 1):
        chain = chain[: len(data) - n + 1] * _STEP + plain[n - 1 :]
        if n in sizes and len(chain):
            inner = before[n - 1 : len(data)] - before[1 : len(data) - n + 2]
            yield (chain + np.uint32(n)) * _SPREAD, inner == 0


def word_bounds(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the buffer begins and ends with a gap."""
    edge = np.diff(gaps.astype(np.int8))
    return np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    lengths = ends - starts
    total = int(lengths.sum())
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + place
    value = (data[at].astype(np.uint32) + np.uint32(1)) * _PLACES[place & 63]
    sums = np.add.reduceat(value, np.cumsum(lengths) - lengths, dtype=np.uint32)
    return (sums ^ (sums >> np.uint32(15))) * _SPREAD


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows (doc_id, text, label) of at most ``per_class`` documents of each of the classes 0 and 1.

    Held-out rows never take part. The rows with the smallest hash of their id are
    taken, so the sample does not depend on the cluster. Rows far above the expected
    bound are left out where they lie; only about twice the sample is ordered. Of rows
    that repeat an id, the one whose text has the smallest digest is taken.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    known = known.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    near = F.lit(False)
    for label_value, rows in known.groupBy("label").count().collect():
        bound = int((1 << 40) * min(1.0, (2 * per_class + 100) / rows))
        near = near | ((F.col("label") == label_value) & (F.col("_hash") < bound))
    place = F.row_number().over(Window.partitionBy("label").orderBy("_hash", "doc_id"))
    chosen = known.where(near).withColumn("_place", place).where(F.col("_place") <= per_class).drop("_place", "_hash")
    # At most two times ``per_class`` rows.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    text = F.coalesce("text", F.lit(""))
    return rows.groupBy("doc_id", "label").agg(F.min_by(text, F.sha2(text, 256)).alias("text")).select("doc_id", "text", "label")
