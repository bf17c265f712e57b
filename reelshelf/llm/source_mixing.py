"""Mixing sources to target weights by the cube method.

Every source is given a share of all words by its weight, at most ``most`` times its
own size; what it can't take goes to the others. A document of a source then has
target over size as its expected number of copies: the whole part is taken as it is,
the fraction is an inclusion probability.

The flight phase of the cube method settles those probabilities. Three documents of a
source are held at a time. Their probabilities move along the null space of the two
constraints (documents, words), in a direction drawn at random that keeps each
expectation, until one of them is zero or one; that document is settled, and the next
takes its place. The largest documents come first, so what is left over is small.

A large document can't be settled by documents far smaller than itself. When one more
than ``FAR`` times as large as the next is still open, it is landed on its own, and its
words too many or too few are carried: the following documents give up a part of their
probabilities for it. It is landed at random if all that follows can take that up, else
at the nearer end.

The rows of a source are dealt into blocks by a hash, and each block flies by itself as
a stream. The at most two documents that a block leaves over (two in ``BLOCK_ROWS``)
fly once more, as one stream for each source. Then two documents at most are left for a
source: the landing takes the outcome of the four that is closest in words, then in
documents. Blocks and draws depend on the rows alone, so reruns agree on any cluster.

Defined results: a null text has size 0; a null source is a source of its own, the last
in order. Documents without words are taken zero words. A source without words has
target 0. Rows that repeat a document are documents of their own. No documents give
no rows. Columns other than those asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelshelf.llm.common import attach, read_table, running_total
from reelshelf.session import materialise

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_ROWS = 1 << 16
FAR = 8
SEED = 12
_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
_BLANKS = " \t\n\x0b\x0c\r"
_EPSILON = 1e-9


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, without a list of them."""
    marks = F.ltrim(F.regexp_replace(text, _WORD, "."), F.lit(_BLANKS))
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One stored row per source: (_source, n_rows, source_size, target).

    The level (words for each unit of weight) rises while sources reach their limit,
    one aggregation of the sources at a time; only its two sums come to the driver.
    """
    sums = sized.groupBy("_source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    sums = sums.withColumns({"_last": F.col("_source") == "", "_one": F.lit(1).cast("long")})
    ranked = running_total(materialise(sums, "sources"), "_one", ["_last", "_source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    sources = materialise(ranked.withColumn("weight", weight.cast("long")), "weights")

    limit = F.col("source_size") * most
    words, units = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, over = words, units
    while over:
        reached = F.col("weight") * F.lit(left) / F.lit(over) > limit
        full, weigh = sources.where(reached).agg(F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (words - full, units - weigh) == (left, over):
            break
        left, over = words - full, units - weigh
    share = F.col("weight") * F.lit(left) / F.lit(over) if over else limit
    target = F.least(share, limit).cast("double")
    return materialise(sources.select("_source", "n_rows", "source_size", target.alias("target")), "targets")


class Flight:
    """The documents of one stratum that are not settled yet: at most three, as [probability, size, place].

    Documents come in order of size, the largest first. ``carry`` counts the words
    taken too many so far.
    """

    def __init__(self, name: str, carry: float = 0.0):
        self.draws = Random(name)
        self.units: list[list] = []
        self.carry = carry

    def add(self, chance: float, size: int, place, tail: float = 0.0) -> list[tuple]:
        """Take in one document; (place, 0 or 1) of those that are settled by it.

        ``tail`` says how many words this document and those after it hold.
        """
        settled = [self._land_alone(u, tail * min(chance, 1 - chance) / 2) for u in self.units[:] if u[1] > FAR * size]
        if size and self.carry:
            most = min(chance, 1 - chance) / 2
            shift = max(-most, min(most, self.carry / size))
            chance, self.carry = chance - shift, self.carry - shift * size
        self.units.append([chance, size, place])
        while (moved := self._direction()) is not None:
            settled += self._move(*moved)
        return settled

    def _land_alone(self, unit: list, room: float) -> tuple:
        chance, size, place = unit
        outcome = int(self.draws.random() < chance)
        if abs(self.carry + (outcome - chance) * size) > room:
            outcome = min((0, 1), key=lambda o: abs(self.carry + (o - chance) * size))
        self.carry += (outcome - chance) * size
        self.units.remove(unit)
        return place, outcome

    def _direction(self) -> tuple[list, tuple] | None:
        """Documents to move, and a vector that changes neither their number nor their words."""
        units = self.units
        for i in range(len(units)):
            for j in range(i):
                if units[i][1] == units[j][1]:
                    return [units[i], units[j]], (1, -1)
        if len(units) < 3:
            return None
        a, b, c = (u[1] for u in units)
        return units[:], (b - c, c - a, a - b)

    def _move(self, units: list, way: tuple) -> list[tuple]:
        ahead = min((1 - u[0]) / w if w > 0 else u[0] / -w for u, w in zip(units, way, strict=True) if w)
        back = min(u[0] / w if w > 0 else (1 - u[0]) / -w for u, w in zip(units, way, strict=True) if w)
        step = ahead if self.draws.random() * (ahead + back) < back else -back
        settled = []
        for unit, w in zip(units, way, strict=True):
            unit[0] += step * w
            if unit[0] < _EPSILON or unit[0] > 1 - _EPSILON:
                settled.append((unit[2], round(unit[0])))
                self.units.remove(unit)
        return settled

    def land(self) -> list[tuple]:
        """Settle the last documents: the outcome closest in words, then in documents."""

        def miss(outcome):
            words = sum((o - u[0]) * u[1] for o, u in zip(outcome, self.units, strict=True))
            return abs(self.carry + words), abs(sum(o - u[0] for o, u in zip(outcome, self.units, strict=True))), outcome

        best = min(product((0, 1), repeat=len(self.units)), key=miss)
        return [(u[2], o) for u, o in zip(self.units, best, strict=True)]


def _flights(strata: list[str], land: bool):
    """Rows with ``_chance`` settled; without ``land`` at most two rows of a stratum keep a fraction.

    What a stratum carries at its end leaves as a row marked ``_note``; with ``land``
    such rows come first and are taken in.
    """

    def told(batch: pa.RecordBatch, rows: list[int], **columns: list) -> pa.RecordBatch:
        picked = batch.take(pa.array(rows, pa.int64()))
        for name, values in columns.items():
            at = batch.schema.get_field_index(name)
            picked = picked.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
        return picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, flight, held = None, None, {}  # held: one-row batches of earlier batches
        last = None  # any row of the stratum

        def finished() -> tuple[list[tuple], list[pa.RecordBatch]]:
            if land:
                return flight.land(), []
            note = [told(last[0], [last[1]], _chance=[0.0], _carry=[flight.carry], _note=[True])] if flight.carry else []
            return [(u[2], u[0]) for u in flight.units], note

        for number, batch in enumerate(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in strata), strict=True)
            chances, sizes, tails, carries, notes = (batch.column(c).to_pylist() for c in ("_chance", "size", "_tail", "_carry", "_note"))
            settled, extra = [], []
            for row, now in enumerate(keys):
                if now != name:
                    if flight:
                        more, note = finished()
                        settled, extra = settled + more, extra + note
                    name, flight = now, Flight(f"{SEED} {land} {now}")
                if notes[row]:
                    flight.carry += carries[row]
                else:
                    settled += flight.add(chances[row], sizes[row], (number, row), tails[row])
                last = (batch, row)
            here = [(row, chance) for (n, row), chance in settled if n == number]
            if here:
                rows, values = zip(*here, strict=True)
                yield told(batch, list(rows), _chance=list(values))
            for place, chance in settled:
                if place[0] != number:
                    yield told(held.pop(place), [0], _chance=[chance])
            yield from extra
            for _, _, place in flight.units if flight else []:
                if place[0] == number:
                    held[place] = batch.slice(place[1], 1)
        if flight:
            settled, extra = finished()
            for place, chance in settled:
                yield told(held.pop(place), [0], _chance=[chance])
            yield from extra

    return run


def _flown(rows: DataFrame, strata: list[str], land: bool) -> DataFrame:
    dealt = rows.repartition(*strata)
    order = [F.desc("_note"), F.desc("size"), "_order"]
    if not land:
        block = Window.partitionBy(*strata)
        before = F.sum("size").over(block.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        dealt = dealt.withColumn("_tail", (F.sum("size").over(block) - F.coalesce(before, F.lit(0))).cast("double"))
    dealt = dealt.sortWithinPartitions(*strata, *order)
    return dealt.mapInArrow(_flights(strata, land), rows.schema)


def mix(
    docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, size: Column | None = None
) -> DataFrame:
    """Copies of every document in the mix: (row, size, source_size, target, copies).

    ``row`` holds the columns ``keep`` (all, if not given) of ``docs``; ``size`` is
    the number of words unless another whole number is given.
    """
    keep = docs.columns if keep is None else keep
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    sized = docs.select(F.struct(*keep).alias("row"), source_key(F.col("source").cast("string")).alias("_source"), size.alias("size"))
    plain = [F.col(f"row.{f.name}") for f in sized.schema["row"].dataType if "map<" not in f.dataType.simpleString()]
    sized = materialise(sized.withColumn("_order", F.xxhash64("size", *plain)), "sized")
    rows = attach(sized, targets(sized, weights, most), "_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    rows = rows.withColumns({"_whole": F.floor(ratio), "_block": F.pmod(F.xxhash64("_order", F.lit(SEED)), blocks)})
    rows = rows.withColumns(
        {"_chance": ratio - F.col("_whole"), "_tail": F.lit(0.0), "_carry": F.lit(0.0), "_note": F.lit(False)}
    ).drop("n_rows")
    fraction = (F.col("_chance") > _EPSILON) & (F.col("_chance") < 1 - _EPSILON)
    flown = materialise(_flown(rows.where(fraction), ["_source", "_block"], False), "flown")
    landed = _flown(flown.where(fraction | F.col("_note")), ["_source"], True)
    out = rows.where(~fraction).unionByName(flown.where(~fraction & ~F.col("_note"))).unionByName(landed)
    copies = F.col("_whole") + F.round("_chance").cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    taken = mix(docs, **options).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
