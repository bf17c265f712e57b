"""Ranked lexical search by a dual tree.

An item is a set of terms, a document a vector with the worth of each term in it; the
score of a pair is the sum of weight times worth over the item's terms. Both sides
have a hierarchy whose nodes hold coordinate maxima: the items are split in two over
and over by the weight they share, the documents of an Arrow batch are put in order of
their strongest term's place among the items and grouped by eights. The product of an
item node and a document node bounds the score of every pair below them. If no item of
the node could improve its list with it, the whole pair of groups is left out; else
both nodes are opened. As a node is left out only where its bound is below the weakest
score of every list, or equal to it with larger ids, the lists are exact.

Items are taken in blocks of ``BLOCK_BYTES`` (200 items are one block), and each block
is one pass over all documents: a task counts the block's terms in every whole text,
Spark sums what the weights need, and tasks search their batches, carrying the lists
along. At most ``top`` rows of an item leave a task; a window ranks them.

Defined results: a null text has no terms; documents without any are not counted. Equal
item rows count once, items with equal ids and different texts are ranked each by
itself. A null doc_id comes before others of its score. Rows that repeat a document are
ranked each. Texts are read in slices, whatever their length; one item has to fit a
task. No items or documents give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelshelf.llm.common import read_table, running_total
from reelshelf.session import materialise

TOP = 50
BLOCK_BYTES = 2 << 20  # text of the items of one block, a thousand bytes more for each
SLICE_BYTES = 4 << 20
FAN_OUT = 8
# Terms are runs of letters, digits and everything beyond ASCII.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)
FEATURES = "doc_id long, n long, terms array<int>, counts array<long>"
HITS = "item int, doc_id long, score long"


def slices(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, with A-Z in lower case, some megabytes of text at a time."""
    text = text.translate(_PLAIN)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES) if len(text) - start > SLICE_BYTES else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _count(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                length, found = 0, {}
                for words in slices(text.as_py()):
                    length += len(words)
                    seen = Counter(words)
                    for word in seen.keys() & vocabulary.keys():
                        term = vocabulary[word]
                        found[term] = found.get(term, 0) + seen[word]
                if not length:
                    continue
                order = sorted(found)
                ids.append(doc_id)
                lengths.append(length)
                terms += order
                counts += [found[t] for t in order]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    return run


def features(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Documents with a term: all their terms' number, and the counts of those in the vocabulary."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(_count(vocabulary), FEATURES)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after another."""
    before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


class ItemTree:
    """A binary hierarchy of items, cut in halves by the weight they share with two of them.

    ``order`` lists the items from left to right. A node is a run [low, high) of that
    order with the union of its items' terms: a term weighs the same in every item,
    so that is the maximum of each coordinate.
    """

    def __init__(self, items: list[np.ndarray], weights: np.ndarray):
        self.order: list[int] = []
        self.low, self.high, self.left, self.right = [], [], [], []
        terms: list[np.ndarray] = []

        def shared(some: list[int], other: int) -> np.ndarray:
            mask = np.zeros(len(weights), dtype=np.int64)
            mask[items[other]] = weights[items[other]]
            return np.array([mask[items[i]].sum() for i in some])

        def grow(some: list[int]) -> int:
            node = len(self.low)
            self.low.append(len(self.order))
            self.high.append(len(self.order) + len(some))
            self.left.append(-1)
            self.right.append(-1)
            terms.append(np.unique(np.concatenate([items[i] for i in some])))
            if len(some) == 1:
                self.order.append(some[0])
                return node
            first = some[int(np.argmax([weights[items[i]].sum() for i in some]))]
            near = shared(some, first)
            second = some[int(np.argmin(near))]
            lean = near - shared(some, second)
            parts = [some[i] for i in np.argsort(-lean, kind="stable")]
            half = len(parts) // 2
            self.left[node] = grow(parts[:half])
            self.right[node] = grow(parts[half:])
            return node

        grow(list(range(len(items))))
        self.low, self.high, self.left, self.right = (np.array(x) for x in (self.low, self.high, self.left, self.right))
        self.sizes = np.array([len(t) for t in terms])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.terms = np.concatenate(terms)
        self.weights = weights[self.terms]
        # Place of the first item that has a term.
        self.place = np.full(len(weights), len(items), dtype=np.int64)
        for place, item in reversed(list(enumerate(self.order))):
            self.place[items[item]] = place

    def products(self, nodes: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Weight times worth of every node; ``worth`` has a row for each vector."""
        sizes = self.sizes[nodes]
        at = _ranges(self.starts[nodes], sizes)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(worth[:, self.terms[at]] * self.weights[at], starts, axis=1)


class Lists:
    """The best documents of every item so far, by place in the item tree."""

    def __init__(self, tree: ItemTree, top: int):
        self.tree, self.top = tree, top
        n = len(tree.order)
        self.best: list[list[tuple]] = [[] for _ in range(n)]
        self.weakest = np.zeros(n, dtype=np.int64)  # 0 until a list is full
        self.last = np.full(n, np.iinfo(np.int64).min)  # largest id with the weakest score
        self._floor: np.ndarray | None = None

    def floor(self) -> np.ndarray:
        """The weakest score in the lists of each node's items."""
        if self._floor is None:
            starts, leaves = self.tree.low, self.tree.high - self.tree.low
            self._floor = np.minimum.reduceat(self.weakest[_ranges(starts, leaves)], np.concatenate(([0], np.cumsum(leaves)[:-1])))
        return self._floor

    def add(self, place: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        best = self.best[place]
        for i in np.flatnonzero((scores > 0) & (scores >= self.weakest[place])):
            # Null ids come first, then smaller ones.
            entry = (int(scores[i]), (0, 0) if not known[i] else (-1, -int(ids[i])))
            if len(best) < self.top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == self.top and (best[0][0] != self.weakest[place] or self.last[place] != -best[0][1][1]):
            self.weakest[place] = best[0][0]
            self.last[place] = -best[0][1][1] if best[0][1][0] else np.iinfo(np.int64).min
            self._floor = None

    def rows(self) -> pa.RecordBatch:
        flat = [
            (self.tree.order[place], None if not key[0] else -key[1], score)
            for place, best in enumerate(self.best)
            for score, key in best
        ]
        items, ids, scores = zip(*flat, strict=True) if flat else ((), (), ())
        columns = [pa.array(items, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])


def _maxima(owner: np.ndarray, terms: np.ndarray, worth: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest worth of each (owner, term)."""
    key = owner * width + terms
    order = np.argsort(key, kind="stable")
    key, worth = key[order], worth[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] // width, key[first] % width, np.maximum.reduceat(worth, first)


class DocumentTree:
    """Documents grouped by eights, each group with the maxima of its coordinates.

    ``levels[0]`` are the documents themselves; a level is (starts, terms, worth).
    """

    def __init__(self, ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, terms: np.ndarray, worth: np.ndarray, tree: ItemTree, weights: np.ndarray):
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        value = worth * weights[terms]
        strongest = np.maximum.reduceat(value, starts)
        first = np.where(value == np.repeat(strongest, sizes), tree.place[terms], len(tree.order))
        order = np.lexsort((-strongest, np.minimum.reduceat(first, starts)))
        at = _ranges(starts[order], sizes[order])
        self.ids, self.known = ids[order], known[order]
        self.smallest = [np.where(self.known, self.ids, np.iinfo(np.int64).min)]
        width = len(weights)
        owner, terms, worth = np.repeat(np.arange(len(order)), sizes[order]), terms[at], worth[at]
        self.levels = [self._level(owner, terms, worth, len(order))]
        while len(self.levels[-1][0]) > 2:
            owner, terms, worth = _maxima(owner // FAN_OUT, terms, worth, width)
            count = int(owner[-1]) + 1
            self.levels.append(self._level(owner, terms, worth, count))
            self.smallest.append(np.minimum.reduceat(self.smallest[-1], np.arange(0, len(self.smallest[-1]), FAN_OUT)))

    @staticmethod
    def _level(owner, terms, worth, count):
        return np.searchsorted(owner, np.arange(count + 1)), terms, worth

    def children(self, level: int, node: int) -> range:
        return range(node * FAN_OUT, min((node + 1) * FAN_OUT, len(self.levels[level - 1][0]) - 1))


class Search:
    """Walks both trees together; ``visited`` counts the pairs of nodes and the pairs that were scored."""

    def __init__(self, tree: ItemTree, weights: np.ndarray, top: int):
        self.tree, self.weights, self.lists = tree, weights, Lists(tree, top)
        self.worth = np.zeros((FAN_OUT, len(weights)), dtype=np.int64)
        self.visited = {"nodes": 0, "pairs": 0}

    def _spread(self, docs: DocumentTree, level: int, nodes) -> np.ndarray:
        """Dense coordinates of some nodes; the caller clears them."""
        starts, terms, worth = docs.levels[level]
        for row, node in enumerate(nodes):
            a, b = starts[node], starts[node + 1]
            self.worth[row, terms[a:b]] = worth[a:b]
        return self.worth[: len(nodes)]

    def _clear(self, docs: DocumentTree, level: int, nodes) -> None:
        starts, terms, _ = docs.levels[level]
        for row, node in enumerate(nodes):
            self.worth[row, terms[starts[node] : starts[node + 1]]] = 0

    def add(self, docs: DocumentTree) -> None:
        top = len(docs.levels) - 1
        for node in docs.children(top + 1, 0):
            self._visit(docs, top, node, np.array([0]))

    def _alive(self, nodes: np.ndarray, bounds: np.ndarray, smallest: int) -> np.ndarray:
        floor = self.lists.floor()[nodes]
        leaf = self.tree.left[nodes] < 0
        last = self.lists.last[self.tree.low[nodes]]
        better = (bounds > floor) | ((bounds == floor) & (~leaf | (smallest < last)))
        return (bounds > 0) & better

    def _visit(self, docs: DocumentTree, level: int, node: int, nodes: np.ndarray) -> None:
        """One document node against some item nodes: bound, leave out, open both."""
        worth = self._spread(docs, level, [node])
        smallest = int(docs.smallest[level][node])
        # The last level of documents meets single items, others open the item nodes once.
        found = []
        while len(nodes):
            self.visited["nodes"] += len(nodes)
            nodes = nodes[self._alive(nodes, self.tree.products(nodes, worth)[0], smallest)]
            leaf = self.tree.left[nodes] < 0
            found.append(nodes[leaf])
            nodes = np.concatenate((self.tree.left[nodes[~leaf]], self.tree.right[nodes[~leaf]]))
            if level > 1:
                found.append(nodes)
                break
        self._clear(docs, level, [node])
        nodes = np.concatenate(found) if found else nodes
        if not len(nodes):
            return
        if level > 1:
            for child in docs.children(level, node):
                self._visit(docs, level - 1, child, nodes)
            return
        below = docs.children(1, node) if level else range(node, node + 1)
        scores = self.tree.products(nodes, self._spread(docs, 0, below))
        self._clear(docs, 0, below)
        self.visited["pairs"] += scores.size
        ids, known = docs.ids[below.start : below.stop], docs.known[below.start : below.stop]
        for i, place in enumerate(self.tree.low[nodes]):
            self.lists.add(int(place), scores[:, i], ids, known)


def _search(items: list[np.ndarray], weights: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ItemTree(items, weights)
        search = Search(tree, weights, top)
        for batch in batches:
            ids, base, terms, counts = (batch.column(c) for c in ("doc_id", "base", "terms", "counts"))
            sizes = np.diff(terms.offsets.to_numpy()).astype(np.int64)
            flat, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            worth = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(base.to_numpy(), sizes))
            useful = worth * weights[flat] > 0
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[useful], minlength=len(sizes))
            some = sizes > 0
            if not some.any():
                continue
            known = ~np.asarray(ids.is_null())
            number = ids.fill_null(0).to_numpy()
            docs = DocumentTree(number[some], known[some], sizes[some], flat[useful].astype(np.int64), worth[useful], tree, weights)
            search.add(docs)
        yield search.lists.rows()

    return run


def _terms_of(text: str) -> list[bytes]:
    return sorted({t for part in slices(text.encode()) for t in part})


def _ranked(docs: DataFrame, items: list[list[bytes]], top: int) -> DataFrame:
    """Best documents of each item of one block: (item, doc_id, score, rank)."""
    names = sorted({t for terms in items for t in terms})
    vocabulary = {t: i for i, t in enumerate(names)}
    found = materialise(features(docs, vocabulary), "features")
    number, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the block.
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * F.lit(number) + 2) / (2.0 * F.col("df") + 1)))
    weights = np.zeros(len(names), dtype=np.int64)
    for term, w in held.select("term", weight.cast("long")).collect():
        weights[term] = w
    sets = [np.array([vocabulary[t] for t in terms], dtype=np.int64) for terms in items]
    # The product of length and number may go beyond a long.
    product = F.lit(50).cast("decimal(2,0)") * F.col("n").cast("decimal(16,0)") * F.lit(number).cast("decimal(14,0)")
    base = F.expr(f"100 - 50 + _product div cast({max(total, 1)} AS decimal(20,0))")
    rows = found.where(F.size("terms") > 0).withColumn("_product", product).select("doc_id", base.alias("base"), "terms", "counts")
    hits = rows.mapInArrow(_search(sets, weights, top), HITS)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents for every item: (item_id, rank, doc_id, score).

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    sized = texts.withColumn("_size", F.octet_length("text").cast("long") + 1000)
    blocks = running_total(sized, "_size", ["text", "item_id"]).withColumn("_block", F.floor(F.col("before") / BLOCK_BYTES))
    blocks = materialise(blocks, "item-blocks")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for (block,) in blocks.select("_block").distinct().orderBy("_block").collect():
        rows = [(r.item_id, _terms_of(r.text)) for r in blocks.where(F.col("_block") == block).orderBy("text", "item_id").collect()]
        rows = [(i, terms) for i, terms in rows if terms]
        if not rows:
            continue
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(rows)], f"item int, item_id {kind}")
        ranked = _ranked(docs, [terms for _, terms in rows], top)
        # One row for each item of the block.
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(named)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2.0 * docs + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals WHERE term IN (SELECT term FROM item_terms) GROUP BY term, docs
), scores AS (
  SELECT i.item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM item_terms i JOIN weights USING (term) JOIN counts c USING (term) JOIN lengths l ON c.doc_id = l.doc_id, totals
  GROUP BY i.item_id, c.doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
