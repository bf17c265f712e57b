"""Near-duplicate vectors by an inverted multi-index.

Each half of the vector space has a codebook of its own; the product of the two is
a grid of cells. A vector resides in one cell, and visits the cells nearest to it
in multi-sequence order. How many it visits is calibrated on made pairs whose
cosine is exactly the threshold, the hardest ones, until ``RECALL`` of them meet in
either direction. All pairs that meet are verified by their cosine in double
precision, in blocks of a cell; only link counts and stars of linked vectors leave
a task. Codebooks are fitted on a bounded sample; every vector is indexed.

Equal vectors are one class with a number of rows, so copies cost nothing. A cell
with more than ``RESIDENTS`` or ``VISITORS`` is split into a grid of blocks, each
pair meeting in exactly one of them.

Defined results: null, empty and zero vectors, those that hold null or non-finite
components, and rows without id link with nothing and are their own component.
Vectors of different lengths never link. Rows that repeat are each returned, and
count as other vectors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.llm.common import attach, components, merge_labels, read_table
from reelshelf.session import materialise

THRESHOLD = 0.95
RECALL = 0.995
SAMPLE = 20_000  # vectors that codebooks are fitted on
PER_CELL = 48  # residents of a cell on average
MAX_CODES = 1024  # codes of one half
MAX_VISITS = 256
RESIDENTS = 4096  # of a block
VISITORS = 16_384  # of a block


def units(raw: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(single: bool):
    """Rows (vec_id, key, dim, raw): digest and bytes of each vector that can link."""
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dims, raws = [], [], []
            for vec_id, vector in zip(batch.column("vec_id"), batch.column("embedding"), strict=True):
                raw = None
                if vec_id.is_valid and vector.is_valid and not (values := vector.values).null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # no negative zeros
                    if len(x) and np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                keys.append(raw and hashlib.blake2b(raw, digest_size=16).digest())
                dims.append(raw and len(raw) // kind().itemsize)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())],
                ["vec_id", "key", "dim", "raw"],
            )

    return run


class MultiIndex:
    """Codebooks of the two halves and the number of cells that a vector visits."""

    def __init__(self, sample: np.ndarray, vectors: int, threshold: float, recall: float, seed: int = 1):
        random = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        codes = int(np.clip(round((vectors / PER_CELL) ** 0.5), 1, min(MAX_CODES, max(1, len(sample) // 8))))
        self.books = [self._fit(part, codes, random) for part in self._halves(sample)]
        self.visits = 1
        self.visits = self._calibrate(sample, threshold, recall, random)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    @staticmethod
    def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ book.T + (book * book).sum(axis=1)[None]

    def _fit(self, x: np.ndarray, codes: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
        book = x[random.choice(len(x), codes, replace=False)].copy()
        for _ in range(rounds):
            near = self._distances(x, book).argmin(axis=1)
            held = np.bincount(near, minlength=codes)
            sums = np.zeros_like(book)
            np.add.at(sums, near, x)
            book[held > 0] = sums[held > 0] / held[held > 0, None]
        return book

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each row, nearest first; the first one is its home.

        The cell of the i-th and j-th nearest codes has (i + 1)(j + 1) - 1 cells
        before it, so only cells below that staircase can be among the first.
        """
        visits = visits or self.visits
        first, second = (self._distances(p, b) for p, b in zip(self._halves(x), self.books, strict=True))
        order1, order2 = np.argsort(first, axis=1, kind="stable"), np.argsort(second, axis=1, kind="stable")
        i, j = np.meshgrid(np.arange(first.shape[1]), np.arange(second.shape[1]), indexing="ij")
        stair = (i + 1) * (j + 1) <= visits
        i, j = i[stair], j[stair]
        a, b = order1[:, i], order2[:, j]
        total = np.take_along_axis(first, a, 1) + np.take_along_axis(second, b, 1)
        # The home comes first even if rounding ties it with another cell.
        total[:, np.flatnonzero((i == 0) & (j == 0))[0]] = -np.inf
        nearest = np.argsort(total, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(a * len(self.books[1]) + b, nearest, 1).astype(np.int32)

    def _calibrate(self, sample: np.ndarray, threshold: float, recall: float, random: np.random.Generator) -> int:
        x = sample[:2000]
        turn = random.standard_normal(x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        turn /= np.maximum(np.sqrt((turn * turn).sum(axis=1, keepdims=True)), 1e-300)
        partner = threshold * x + (1 - threshold**2) ** 0.5 * turn
        most = min(MAX_VISITS, len(self.books[0]) * len(self.books[1]))
        seen, back = self.cells(x, most), self.cells(partner, most)
        there, here = seen == back[:, :1], back == seen[:, :1]
        rank = np.minimum(
            np.where(there.any(axis=1), there.argmax(axis=1), most), np.where(here.any(axis=1), here.argmax(axis=1), most)
        )
        return int(min(most, np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))))] + 1))


def _place(index: MultiIndex, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                raw = np.frombuffer(b"".join(part.column("raw").to_pylist()), dtype=kind).reshape(part.num_rows, -1)
                cells = index.cells(units(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n_rows"), part.column("raw"), pa.array(list(cells), pa.list_(pa.int32()))],
                    ["id", "n_rows", "raw", "cells"],
                )

    return run


def _verify(threshold: float, kind: type):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, rows = group["id"].to_numpy(), group["n_rows"].to_numpy()
        role, home = group["role"].to_numpy(), group["home"].to_numpy()
        x = units(np.frombuffer(b"".join(group["raw"]), dtype=kind).reshape(len(group), -1))
        residents = np.flatnonzero(role == 0)
        if not len(residents):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        # In a cell that isn't split, residents meet each other as well.
        queries = np.flatnonzero((role > 0) | ~group["split"].to_numpy())
        visited = np.stack(group["cells"].to_numpy()[residents])
        counts, labels = np.zeros(len(group), dtype=np.int64), np.arange(len(group))
        for start in range(0, len(queries), 1024):
            block = queries[start : start + 1024]
            left, right = np.nonzero(x[block] @ x[residents].T >= threshold)
            at, to = block[left], residents[right]
            # A pair that meets in both homes counts where the smaller id visits.
            away = role[at] == 1
            twice = ~away
            twice[away] = (visited[right[away]] == home[at[away], None]).any(axis=1)
            keep = (ids[at] < ids[to]) | (~twice & (ids[at] != ids[to]))
            at, to = at[keep], to[keep]
            np.add.at(counts, at, rows[to])
            np.add.at(counts, to, rows[at])
            labels = merge_labels(labels, at, to)
        found = np.flatnonzero(counts)
        return pd.DataFrame({"id": ids[found], "links": counts[found], "root": ids[labels[found]]})

    return run


def _grid(placed: DataFrame, residents: int, visitors: int) -> DataFrame:
    """Rows (cell, block, slice, role, ...) such that each pair that meets does so in one group."""
    columns = ["id", "n_rows", "raw", "cells"]
    rows = placed.select(
        *columns, F.col("cells")[0].alias("home"), F.posexplode("cells").alias("_at", "cell")
    ).withColumn("role", F.when(F.col("_at") == 0, 0).otherwise(1)).drop("_at")
    sizes = rows.groupBy("cell").agg(
        F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("r"), F.count(F.lit(1)).alias("q")
    )
    large = materialise(
        sizes.where((F.col("r") > residents) | (F.col("q") > visitors)).select(
            "cell", F.ceil(F.col("r") / residents).alias("blocks"), F.ceil(F.col("q") / visitors).alias("slices")
        ),
        "large-cells",
    )
    rows = rows.join(large, "cell", "left")
    rows = rows.withColumn("split", F.col("blocks").isNotNull()).withColumns(
        {"blocks": F.greatest("blocks", F.lit(1)), "slices": F.greatest("slices", F.lit(1))}
    )
    # Residents of a split cell are dealt to blocks, and visit all blocks once more.
    roles = F.when(F.col("split") & (F.col("role") == 0), F.array(F.lit(0), F.lit(2))).otherwise(F.array("role"))
    rows = rows.withColumn("role", F.explode(roles))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(F.xxhash64("id"), F.col(n)))
    rows = rows.withColumn("block", F.explode(F.when(F.col("role") == 0, one("blocks")).otherwise(every("blocks"))))
    rows = rows.withColumn("slice", F.explode(F.when(F.col("role") == 0, every("slices")).otherwise(one("slices"))))
    lists = F.when(F.col("role") == 0, F.col("cells"))  # only residents need them
    return rows.select("cell", "block", "slice", "role", "split", "home", "id", "n_rows", "raw", lists.alias("cells"))


def _links(classes: DataFrame, threshold: float, recall: float, kind: type) -> DataFrame:
    """Rows (id, links, root) of the classes of one length."""
    vectors = classes.count()
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("raw").toArrow().column("raw").to_pylist()
    index = MultiIndex(units(np.stack([np.frombuffer(r, dtype=kind) for r in sample])), vectors, threshold, recall)
    placed = materialise(
        classes.select("id", "n_rows", "raw").mapInArrow(
            _place(index, kind), "id long, n_rows long, raw binary, cells array<int>"
        ),
        "placed",
    )
    grouped = _grid(placed, RESIDENTS, VISITORS).groupBy("cell", "block", "slice")
    return grouped.applyInPandas(_verify(threshold, kind), "id long, links long, root long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    embedding = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = materialise(
        vectors.select("vec_id", embedding.alias("embedding")).mapInArrow(
            _keys(single), "vec_id long, key binary, dim int, raw binary"
        ),
        "vectors",
    )
    classes = materialise(
        rows.where("key IS NOT NULL").groupBy("key").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n_rows"), F.first("dim").alias("dim"), F.first("raw").alias("raw")
        ),
        "vector-classes",
    )
    # A table has one length of vectors as a rule; each further one is indexed by itself.
    dims = [d for (d,) in classes.select("dim").distinct().collect()]
    parts = [_links(classes.where(F.col("dim") == d), threshold, recall, kind) for d in dims]
    if parts:
        found = materialise(reduce(DataFrame.unionByName, parts), "vector-links")
    else:
        found = classes.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("root")).limit(0)
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    stars = found.where("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    parts_of = components(stars).withColumnRenamed("vertex", "id")
    labelled = (
        classes.select("key", "id", "n_rows")
        .join(counts, "id", "left")
        .join(parts_of, "id", "left")
        .select(
            "key",
            "n_rows",
            (F.coalesce("links", F.lit(0).cast("long")) + F.col("n_rows") - 1).alias("n_links"),
            F.coalesce("component_id", "id").alias("component"),
        )
    )
    result = attach(rows.select("vec_id", "key"), materialise(labelled, "vector-labels"), "key")
    component = F.coalesce("component", "vec_id")
    return result.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
