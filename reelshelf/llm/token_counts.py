"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``CHUNK`` characters is encoded as it is. A longer one is cut into
chunks that overlap, dealt over the cluster and encoded with offsets. In the
overlap of two chunks a position is a stable boundary if a unit of the pattern
starts there in both encodings, ``MARGIN`` characters from either edge or more:
the pattern looks back at nothing and ahead by one character, and no special
string can reach over the margin, so from there both encodings go on alike. The
counts are spliced at such a boundary. Texts for which an overlap holds none are
cut again with overlaps ``WIDEN`` times as wide, until a chunk holds the text.

Defined results: a null text counts as empty, with no bytes and no tokens. Rows
that repeat are counted each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelshelf.llm.common import read_table, shuffle_partitions
from reelshelf.llm.encoder import encoder
from reelshelf.session import materialise

LIMIT = 512
CHUNK = 1 << 15  # characters of a chunk
OVERLAP = 256
WIDEN = 4
MARGIN = 32  # more than any special string has


def _spans(length: int, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    start = 0
    while True:
        end = min(length, start + chunk)
        yield start, end
        if end == length:
            return
        start = end - overlap


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                spans = list(_spans(len(text), chunk, overlap))
                for k in range(0, len(spans), 16):
                    part = spans[k : k + 16]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(part), pa.int64()),
                            pa.array(range(k, k + len(part)), pa.int32()),
                            pa.array([a for a, _ in part], pa.int64()),
                            pa.array([b == len(text) for _, b in part]),
                            pa.array([text[a:b] for a, b in part]),
                        ],
                        ["row", "idx", "start", "last", "text"],
                    )

    return run


def boundaries(encoding, start: int) -> list[tuple[int, int]]:
    """Where each unit of an encoded chunk begins: (position in the text, tokens before)."""
    words, offsets = encoding.word_ids, encoding.offsets
    return [
        (start + offsets[k][0], k) for k in range(len(words)) if k == 0 or words[k] is None or words[k] != words[k - 1]
    ]


def _encode(path: str, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path).tokenizer
        for batch in batches:
            for row in batch.to_pylist():
                encoding = tokenizer.encode(row["text"], add_special_tokens=False)
                start, end = row["start"], row["start"] + len(row["text"])
                known = boundaries(encoding, start)
                head = [(p, k) for p, k in known if start + MARGIN <= p <= start + overlap - MARGIN]
                tail = [(p, k) for p, k in known if end - overlap + MARGIN <= p <= end - MARGIN]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "row": row["row"], "idx": row["idx"], "last": row["last"], "n_tokens": len(encoding.ids),
                            "head_at": [p for p, _ in head], "head_before": [k for _, k in head],
                            "tail_at": [p for p, _ in tail], "tail_before": [k for _, k in tail],
                        }
                    ],
                    schema=_ENCODED,
                )

    return run


_ENCODED = pa.schema(
    [("row", pa.int64()), ("idx", pa.int32()), ("last", pa.bool_()), ("n_tokens", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("head_at", "head_before", "tail_at", "tail_before")]
)


def spliced_counts(huge: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (row, n_tokens) for rows (row, text), which must be stored and have unique keys."""
    spark, done, pending = huge.sparkSession, [], huge
    n = shuffle_partitions(spark)
    while True:
        chunks = pending.mapInArrow(
            _cut(max(chunk, 4 * overlap), overlap), "row long, idx int, start long, last boolean, text string"
        ).repartition(n, "row", "idx")
        encoded = chunks.mapInArrow(
            _encode(path, overlap),
            "row long, idx int, last boolean, n_tokens long, head_at array<long>, head_before array<long>, "
            "tail_at array<long>, tail_before array<long>",
        )
        order = Window.partitionBy("row").orderBy("idx")
        joined = encoded.withColumn(
            "joint", F.array_min(F.array_intersect(F.lag("tail_at").over(order), "head_at"))
        ).withColumn("next_joint", F.lead("joint").over(order))
        begins = F.when(F.col("idx") == 0, F.lit(0).cast("long")).otherwise(
            F.element_at("head_before", F.array_position("head_at", F.col("joint")).cast("int"))
        )
        ends = F.when(F.col("last"), F.col("n_tokens")).otherwise(
            F.element_at("tail_before", F.array_position("tail_at", F.col("next_joint")).cast("int"))
        )
        result = materialise(
            joined.groupBy("row").agg(
                F.sum(ends - begins).alias("n_tokens"), F.bool_and((ends - begins).isNotNull()).alias("whole")
            ),
            "spliced",
        )
        done.append(result.where("whole").select("row", "n_tokens"))
        failed = result.where("NOT whole").select("row")
        if failed.isEmpty():
            break
        pending, overlap = materialise(pending.join(failed, "row", "left_semi"), "misaligned"), overlap * WIDEN
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _count(path: str, limit: int):
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            counts = [len(own.packed(t.as_py() or "")) // own.width for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                names,
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.char_length(text).alias("_chars")
    )
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    short = sized.where(F.col("_chars") <= chunk).drop("_chars").mapInArrow(_count(path, limit), schema)
    huge = materialise(
        sized.where(F.col("_chars") > chunk).drop("_chars").withColumn("row", F.monotonically_increasing_id()), "huge"
    )
    counts = spliced_counts(huge.select("row", "text"), path, chunk, overlap)
    long = huge.join(counts, "row").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
    return short.unionByName(long)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
