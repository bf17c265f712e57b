"""SimHash near-deduplication with a Gray-order hierarchical index.

Two fingerprints within ``distance`` bits agree on at least one of ``distance`` + 1
runs of bits. For each run the bits are rotated so that it leads, and fingerprints
with the same leading run form a group. A group is sorted by Gray rank, in which
neighbours share most bits; the bits that a stretch of neighbours has in common
are factored into an upper node, and those of several nodes into a node above. A
search adds up the differences from the root down, and leaves out every node at
which they pass the bound. Bits that a parent has factored out are not compared
again.

A group that holds more than ``GROUP`` fingerprints is split by the same argument
over the bits that are still free, as often as needed; at 12 free bits no group of
distinct fingerprints can pass the bound. Tasks emit a star for each set of linked
fingerprints of a group, never all pairs; components are found over the stars.

Defined results: a null text is empty. Texts without words have fingerprint zero,
and are linked like any other. Equal fingerprints are one vertex. A row without id
takes the component of its fingerprint and adds no link of its own (null if no row
has an id). Rows that repeat are each returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import attach, components, merge_labels, read_table, shuffle_partitions
from reelshelf.session import materialise

SHINGLE = 3
DISTANCE = 2
GROUP = 4096  # fingerprints searched together in one task
FAN = 8  # children of an index node
BLOCK = 64  # queries searched at a time: at most BLOCK times GROUP nodes are looked at together


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles; a bit is set if it is in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    size = max(1, len(words) - shingle + 1)
    totals = np.zeros(64, dtype=np.int64)
    for start in range(0, size, 1 << 18):
        part = words[start : start + (1 << 18) + shingle - 1]
        if len(part) < shingle:
            runs = [b" ".join(part)]
        else:
            runs = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, runs, repeat(42)), dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(totals * 2 > size, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _fingerprints(shingle), "doc_id long, fp long"
    )


def _runs(free: int, parts: int) -> list[int]:
    return [free // parts + (k < free % parts) for k in range(parts)]


def _lead(code: F.Column, free: int, shift: int) -> F.Column:
    """Rotate the lowest ``free`` bits of ``code`` left by ``shift``."""
    if not shift:
        return code
    if free == 64:
        return F.shiftleft(code, shift).bitwiseOR(F.shiftrightunsigned(code, free - shift))
    mask = (1 << free) - 1
    low = code.bitwiseAND(F.lit(mask))
    turned = F.shiftleft(low, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftrightunsigned(low, free - shift))
    return code.bitwiseAND(F.lit(~mask)).bitwiseOR(turned)


def _split(rows: DataFrame, free: int, parts: int) -> list[tuple[DataFrame, int]]:
    """Rows (path, code, id) under each choice of the leading run among the free bits."""
    found, shift = [], 0
    for k, width in enumerate(_runs(free, parts)):
        left = free - width
        code = _lead(F.col("code"), free, shift)
        found.append(
            (
                rows.select(
                    (F.col("path") * (parts + 1) + k + 1).alias("path"),
                    F.lit(left).alias("free"),
                    code.alias("code"),
                    F.shiftrightunsigned(code, left).alias("lead"),
                    "id",
                ),
                left,
            )
        )
        shift += width
    return found


def _groups(vertices: DataFrame, parts: int, group: int) -> DataFrame:
    """Rows (path, free, code, lead, id) whose groups (path, lead) are within the bound."""
    start = vertices.select(F.lit(0).cast("long").alias("path"), F.col("fp").alias("code"), "id")
    pending, settled = _split(start, 64, parts), []
    while pending:
        split = []
        for rows, free in pending:
            if (1 << free) <= group:
                settled.append(rows)
                continue
            large = materialise(rows.groupBy("lead").count().where(F.col("count") > group).select("lead"), "large")
            if large.isEmpty():
                settled.append(rows)
                continue
            settled.append(rows.join(large, "lead", "left_anti").select(rows.columns))
            inner = rows.join(large, "lead", "left_semi").select("path", "code", "id")
            split += _split(materialise(inner, "split"), free, parts)
        pending = split
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    return found


def gray_rank(code: F.Column) -> F.Column:
    """Place of a code in Gray order: the XOR of all its right shifts."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code


def build_index(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (pattern, mask) from the leaves up; a mask marks the bits its node adds."""
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    low, high = codes, codes
    levels = [(codes, np.full(len(codes), every))]
    while len(low) > FAN:
        at = np.arange(0, len(low), FAN)
        low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
        common = ~(low ^ high)
        pattern, mask = levels[-1]
        # What the node holds is taken out of its children.
        levels[-1] = (pattern, mask & ~np.repeat(common, FAN)[: len(mask)])
        levels.append((low, common))
    return levels


def linked(codes: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions, first below second, of codes within ``distance`` bits."""
    levels = build_index(codes)
    spans = [FAN**k for k in range(len(levels))]
    for start in range(0, len(codes), BLOCK):
        queries = np.arange(start, min(start + BLOCK, len(codes)), dtype=np.int32)
        top = len(levels[-1][0])
        query, node = np.repeat(queries, top), np.tile(np.arange(top, dtype=np.int32), len(queries))
        added = np.zeros(len(query), dtype=np.uint8)
        for level in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[level]
            # Only nodes that end behind the query can hold its partners.
            ahead = (node + 1) * spans[level] - 1 > query if level else node > query
            query, node, added = query[ahead], node[ahead], added[ahead]
            added = added + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node])
            near = added <= distance
            query, node, added = query[near], node[near], added[near]
            if level:
                below = len(levels[level - 1][0])
                child = (node[:, None] * FAN + np.arange(FAN, dtype=np.int32)).ravel()
                inside = child < below
                query, added = np.repeat(query, FAN)[inside], np.repeat(added, FAN)[inside]
                node = child[inside]
        if len(query):
            yield query, node


def stars(codes: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (centre id, id) that join each set of linked codes."""
    labels = np.arange(len(codes))
    for left, right in linked(codes, distance):
        labels = merge_labels(labels, left, right)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return ids[labels[moved]], ids[moved]


def _search(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def emit(path, lead, code, ids):
            starts = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (lead[1:] != lead[:-1])])
            ends = np.r_[starts[1:], len(path)]
            several = np.flatnonzero(ends - starts > 1)
            found = [stars(code[a:b], ids[a:b], distance) for a, b in zip(starts[several], ends[several], strict=True)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "lead", "code", "id")]
            now[2] = now[2].view(np.uint64)
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            # The last group may go on in the next batch.
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(last) - int(last.sum())
            yield from emit(*(x[:cut] for x in now)) if cut else ()
            kept = [x[cut:] for x in now]
        if kept is not None:
            yield from emit(*kept)

    return run


def near_links(vertices: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) that connect the ids of fingerprints within ``distance`` bits.

    ``vertices`` holds distinct rows (fp, id), and should be stored.
    """
    rows = _groups(vertices, distance + 1, group)
    dealt = rows.repartition(shuffle_partitions(vertices.sparkSession), "path", "lead").sortWithinPartitions(
        "path", "lead", gray_rank(F.col("code"))
    )
    return dealt.select("path", "lead", "code", "id").mapInArrow(_search(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    groups = materialise(
        rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_rows")), "fingerprint-groups"
    )
    links = near_links(groups.where("id IS NOT NULL").select("fp", "id"), distance, group)
    found = components(materialise(links, "near-links"))
    classes = groups.join(found, groups["id"] == found["vertex"], "left").select(
        "fp", "n_rows", F.coalesce("component_id", "id").alias("component_id")
    )
    return attach(rows, materialise(classes, "classes"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
