"""Mixture-controlled packing of documents into fixed training sequences.

Every source is a queue of documents. A window of ``WINDOW`` sequences is dealt in
``TURNS`` rounds. Each round credits each queue with its share of the round's tokens;
a document leaves its queue in the first round at which the credits gathered so far,
less what was served, cover it, and what is left over is carried to the next round,
across the ends of windows too. As credits grow evenly, that round has a closed form:
the running tokens of the queue over its credit for a round. So deficits carry across
windows and partitions without a loop, and only running totals are needed. The rounds'
documents, one after another and in turn by source, form one stream, cut at every
``SEQUENCE`` tokens; only the last sequence is padded.

Target shares come from ``mixture``, or else from the tokens of each queue to the power
``TEMPER``: below one, small sources are met more often than they occur. A queue that is
served at a share above its own runs dry early, and the later windows are shorter; the
targets hold among the queues that are left.

Defined results: a null text is empty, and any document ends with one extra id.
Null sources share one queue. Rows without id or with a repeated one are packed
like any other. No documents give no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import read_table, running_total
from reelshelf.llm.encoder import encoder
from reelshelf.session import materialise

SEQUENCE = 2048
WINDOW = 64  # sequences of a window
TURNS = 16  # rounds in which a window is dealt
TEMPER = 0.7  # power of a source's tokens that is its target; 1 takes sources as they are
END_ID = 1
SLICE = 500  # documents that a worker encodes before it hands them on


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), zstandard.ZstdCompressor(level=1)
        end = own.pack([END_ID])
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids = [own.packed(t.as_py() or "") + end for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("source"),
                        pa.array([len(i) // own.width for i in ids], pa.int64()),
                        pa.array([packer.compress(i) for i in ids], pa.binary()),
                    ],
                    ["row", "doc_id", "source", "doc_tokens", "ids"],
                )

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Stored table (row, doc_id, source, doc_tokens, ids); ids are packed and compressed."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("source", F.lit("")).alias("source"), "text"
    )
    encoded = rows.mapInArrow(_encode(path), "row long, doc_id long, source string, doc_tokens long, ids binary")
    return materialise(encoded, "encoded")


def assign_windows(
    docs: DataFrame,
    mixture: dict[str, float] | None = None,
    window_tokens: int = WINDOW * SEQUENCE,
    temper: float = 1.0,
    turns: int = TURNS,
) -> DataFrame:
    """Add ``window``, ``turn`` (the round inside it) and ``queue_before`` to rows (row, doc_id, source, doc_tokens).

    ``mixture`` gives the share of each source. A source it leaves out, and every source
    without a mixture, weighs its tokens to the power ``temper``, scaled to all tokens.
    """
    queues = docs.groupBy("source").agg(F.sum("doc_tokens").cast("double").alias("tokens"))
    queues = materialise(queues.withColumn("weight", F.pow("tokens", F.lit(temper))), "queues")
    tokens, weights = queues.agg(F.sum("tokens"), F.sum("weight")).first()
    # Weights of all sources by the rule add up to their tokens, so that given shares mix with them.
    scaled = F.col("weight") * F.lit((tokens or 0.0) / (weights or 1.0))
    if mixture:
        given = F.create_map(*[F.lit(x) for s, w in mixture.items() for x in (s, w * (tokens or 0.0))])
        scaled = F.coalesce(given[F.col("source")], scaled)
    queues = materialise(queues.select("source", scaled.alias("weight")), "queues")
    total = queues.agg(F.sum("weight")).first()[0] or 1.0
    credit = queues.select("source", (F.col("weight") / total * (window_tokens / turns)).alias("credit"))
    queued = running_total(docs, "doc_tokens", ["doc_id", "row"], by=["source"]).withColumnRenamed("before", "queue_before")
    served = F.ceil((F.col("queue_before") + F.col("doc_tokens")) / F.col("credit")).cast("long") - 1
    # A queue without weight is served after all others.
    place = F.when(F.col("credit") > 0, served).otherwise(F.lit(2**62))
    return (
        queued.join(credit, "source")
        .withColumn("window", F.floor(place / turns).cast("long"))
        .withColumn("turn", F.pmod(place, F.lit(turns)).cast("int"))
        .drop("credit")
    )


def _pieces(width: int, sequence: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, at, size, packed in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "before", "doc_tokens", "ids")), strict=True
            ):
                ids = np.frombuffer(unpacker.decompress(packed), dtype=f"<u{width}").astype("<u4")
                start = 0
                while start < size:
                    place = at + start
                    length = min(size - start, sequence - place % sequence)
                    crc = zlib.crc32(ids[start : start + length])
                    rows.append((doc_id, start, length, crc, size, place // sequence, place % sequence))
                    start += length
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack(
    docs: DataFrame,
    path: str,
    mixture: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window: int = WINDOW,
    temper: float = TEMPER,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence.

    Every document is packed, whatever the targets.
    """
    encoded = encode_documents(docs, path)
    small = encoded.select("row", "doc_id", "source", "doc_tokens")
    windows = assign_windows(small, mixture, window * sequence, temper)
    placed = running_total(
        windows.select("row", "source", "doc_tokens", "window", "turn", "queue_before"),
        "doc_tokens",
        ["window", "turn", "source", "queue_before"],
    ).select("row", "before")
    return encoded.join(placed, "row").select("doc_id", "before", "doc_tokens", "ids").mapInArrow(
        _pieces(encoder(path).width, sequence),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
