"""Tables on a shared folder, as plain partitioned Parquet.

Every keyed table is partitioned by a hash bucket of its key and sorted by the key
inside. A change is computed for the buckets it touches and written over those buckets
only; all other files stay as they are.

A commit changes several tables. Their new buckets, the log rows of the step and its
mark are first written below ``journal``, then the plan that lists them, and only then
the tables. A job that dies before the plan is there has changed nothing; after that,
:meth:`Store.recover` (which every commit and every job begins with) writes what the
plan lists once more. So a batch that is run again goes on where it stopped: its
finished steps are marked, what they did is in the logs, and no step is computed from
tables it has already changed.

One job at a time may change a store. Readers may meet a commit half written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from random import Random

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf.operators.profile import build_facets
from reelshelf.plans.catalogue import Catalogue
from reelshelf.schemas import Link, schema
from reelshelf.session import path_exists, remove_path

KEYS = {
    "anime": "anime_id",
    "manga": "manga_id",
    "anime_genre": "anime_id",
    "anime_studio": "anime_id",
    "anime_streaming_service": "anime_id",
    "manga_genre": "manga_id",
    "manga_author": "manga_id",
    "genre": "id",
    "studio": "id",
    "author": "id",
    "streaming_service": "normalized_name",
    "sync_state": "key",
    "refused_pages": "scan_key",
    "anime_directory": "mal_id",
    "manga_directory": "mal_id",
    "visitor_number": "visitor_token_hash",
}
# Which title has a provider id; kept with the titles, and looked up by that id.
DIRECTORIES = {"anime": "anime_directory", "manga": "manga_directory"}
BUCKETS = 16
MARK = "batch long, running long, steps array<int>, since long"


PLAN = "table string, by array<string>, buckets array<int>"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


@dataclass(frozen=True)
class Change:
    """New rows of one table: of some buckets, or of the partitions ``by`` that they lie in."""

    table: str
    rows: DataFrame
    by: tuple[str, ...] = ("bucket",)
    buckets: tuple[int, ...] | None = None


class Store:
    """Tables below one root folder.

    The number of ``buckets`` is fixed when the folder is first written to and kept
    beside the tables; another number is refused afterwards.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        layout = self._load("layout", "buckets int")
        kept = layout.first().buckets if layout is not None else None
        if kept is not None and buckets not in (None, kept):
            raise ValueError(f"this store has {kept} buckets")
        self.buckets = kept or buckets or BUCKETS

    def _load(self, table: str, columns) -> DataFrame | None:
        try:
            return self.spark.read.schema(columns).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets; one that was never written is empty."""
        columns = schema(table)
        extra = {"bucket": "integer"} if table in KEYS else {}
        for name, kind in extra.items():
            columns = columns.add(name, kind)
        rows = self._load(table, columns)
        if rows is None:
            return self.spark.createDataFrame([], schema(table))
        if table in KEYS:
            # Each bucket has a row without key, so that an emptied one can be written.
            rows = rows.filter(F.col(KEYS[table]).isNotNull())
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(sorted(buckets)))
        return rows.select(*schema(table).names)

    def find(self, table: str, keys: list) -> DataFrame:
        """Rows of a table with one of a few keys; only their buckets are read."""
        if not keys:
            return self.read(table).limit(0)
        kind = schema(table)[KEYS[table]].dataType
        row = self.spark.range(1).select(
            *[bucket_of(F.lit(k).cast(kind), self.buckets).alias(f"k{i}") for i, k in enumerate(keys)]
        ).first()
        return self.read(table, set(row)).filter(F.col(KEYS[table]).isin(keys))

    def buckets_of(self, ids: DataFrame) -> frozenset[int]:
        """Buckets of the first column of ``ids``; never more than there are."""
        column = F.col(ids.columns[0])
        return frozenset(r[0] for r in ids.select(bucket_of(column, self.buckets)).distinct().collect())

    def known(self, medium: str, mal_ids: DataFrame) -> DataFrame:
        """Titles with one of some provider ids: (mal_id, item_id), from the directory's buckets of those."""
        rows = self.read(DIRECTORIES[medium], self.buckets_of(mal_ids.select("mal_id")))
        return rows.join(mal_ids.select("mal_id"), "mal_id", "left_semi")

    def load(self, tables: dict[str, DataFrame]) -> None:
        """Fill tables for the first time; a load that fails is run again as a whole."""
        self._keep_layout()
        self._in_threads(self._overwrite, self._changes(tables, {}))

    def _keep_layout(self) -> None:
        if not path_exists(self.spark, f"{self.root}/layout"):
            layout = self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1)
            layout.write.mode("overwrite").parquet(f"{self.root}/layout")

    def write(
        self,
        tables: dict[str, DataFrame],
        touched: dict[str, Iterable[int]] | None = None,
        logs: Iterable[Change] = (),
        mark: tuple[str, DataFrame] | None = None,
    ) -> None:
        """Replace the touched buckets of each table, or all where none are named, in one commit.

        ``logs`` are rows of :meth:`batch_rows`, ``mark`` a row of :meth:`marked`.
        """
        self.recover()
        changes = [*self._changes(tables, touched or {}), *logs]
        if mark:
            changes.append(Change("marks", mark[1], ("source",)))
        if not changes:
            return
        self._keep_layout()
        self._in_threads(lambda c: c.rows.write.mode("overwrite").parquet(f"{self.root}/journal/{c.table}"), changes)
        plan = [(c.table, list(c.by), None if c.buckets is None else list(c.buckets)) for c in changes]
        # One file, so that the plan is there as a whole or not at all.
        plan = self.spark.createDataFrame(plan, PLAN).coalesce(1)
        plan.write.mode("overwrite").parquet(f"{self.root}/journal/plan")
        self.recover()

    def recover(self) -> None:
        """Write what a planned commit lists into the tables, and forget the plan."""
        if not path_exists(self.spark, f"{self.root}/journal"):
            return
        plan = self._load("journal/plan", PLAN)
        changes = []
        for row in plan.collect() if plan is not None else []:
            rows = self._load(f"journal/{row.table}", self._columns(row.table, tuple(row.by)))
            changes.append(Change(row.table, rows, tuple(row.by), None if row.buckets is None else tuple(row.buckets)))
        self._in_threads(self._overwrite, changes)
        remove_path(self.spark, f"{self.root}/journal/plan")
        remove_path(self.spark, f"{self.root}/journal")

    def _columns(self, table: str, by: tuple[str, ...]):
        if table == "marks":
            return f"{MARK}, source string"
        columns = schema(table)
        for name in by:
            if name not in columns.names:
                columns = columns.add(name, "integer" if name == "bucket" else "string")
        return columns

    def _changes(self, tables: dict[str, DataFrame], touched: dict[str, Iterable[int]]) -> list[Change]:
        changes = []
        # A title table that is written as a whole gets its directory anew.
        whole = {DIRECTORIES[t]: t for t in tables if t in DIRECTORIES and t not in touched and DIRECTORIES[t] not in tables}
        more = {d: tables[t].filter("mal_id IS NOT NULL").select("mal_id", F.col(KEYS[t]).alias("item_id")) for d, t in whole.items()}
        for table, rows in {**tables, **more}.items():
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table)]
            bucket = bucket_of(F.col(KEYS[table]), self.buckets).alias("bucket")
            buckets = tuple(sorted(touched.get(table, range(self.buckets))))
            changes.append(Change(table, rows.select(*columns).select("*", bucket), buckets=buckets))
        return changes

    def _in_threads(self, work: Callable[[Change], None], changes: list[Change]) -> None:
        """The jobs of several tables side by side; Spark shares its cores among them."""
        with ThreadPoolExecutor(max(1, len(changes))) as pool:
            list(pool.map(work, changes))

    def batch_rows(self, table: str, rows: DataFrame, batch: str, *by: str) -> Change:
        """Rows of one batch, to be added with a commit; the same batch written again replaces itself."""
        return Change(table, rows.select(*schema(table).names).withColumn("batch", F.lit(batch)), (*by, "batch"))

    def write_batch(self, table: str, rows: DataFrame, batch: str, *by: str) -> None:
        """Add the rows of one batch to a table by itself."""
        self._overwrite(self.batch_rows(table, rows, batch, *by))

    def read_batches(self, table: str, batches: Iterable[str] | None = None) -> DataFrame:
        """Rows of all batches of a table, or of some."""
        rows = self._load(table, schema(table).add("batch", "string"))
        if rows is None:
            return self.spark.createDataFrame([], schema(table))
        if batches is not None:
            rows = rows.filter(F.col("batch").isin(sorted(batches)))
        return rows.select(*schema(table).names)

    def _overwrite(self, change: Change) -> None:
        rows, by = change.rows, list(change.by)
        if change.buckets is not None:
            # Each bucket has a row without key, so that an emptied one is written.
            empty = self.spark.createDataFrame([(b,) for b in change.buckets], "bucket int")
            rows = rows.unionByName(empty, allowMissingColumns=True)
            # Large buckets are split over tasks, small ones share one.
            rows = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", KEYS[change.table])
        elif len(by) > 1:
            rows = rows.hint("rebalance", *by[:-1])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(
            f"{self.root}/{change.table}"
        )

    def _mark(self, source: str):
        marks = self._load("marks", f"{MARK}, source string")
        return marks.filter(F.col("source") == source).first() if marks is not None else None

    def batch(self, source: str) -> int:
        """Last batch of ``source`` that was applied, -1 before the first."""
        found = self._mark(source)
        return -1 if found is None else found.batch

    def steps(self, source: str, batch: int) -> frozenset[int]:
        """Steps of a batch that is not finished which were committed before it stopped."""
        found = self._mark(source)
        return frozenset(found.steps) if found is not None and found.running == batch else frozenset()

    def since(self, source: str, batch: int) -> int | None:
        """What was noted when an unfinished batch began."""
        found = self._mark(source)
        return found.since if found is not None and found.running == batch else None

    def marked(self, source: str, batch: int, steps: Iterable[int] | None = None, since: int | None = None) -> tuple[str, DataFrame]:
        """The mark of a finished batch; with ``steps``, of one that goes on after them."""
        row = (batch, None, [], None) if steps is None else (batch - 1, batch, sorted(steps), since)
        return source, self.spark.createDataFrame([(*row, source)], f"{MARK}, source string").coalesce(1)

    def mark(self, source: str, batch: int) -> None:
        self.write({}, mark=self.marked(source, batch))

    def catalogue(self) -> StoredCatalogue:
        """All catalogue tables, as they are now."""
        rows = {t: self.read(t) for t in Catalogue.tables()}
        return StoredCatalogue(**rows, store=self, stored=rows)

    def commit(self, cat: StoredCatalogue, logs: Iterable[Change] = (), mark: tuple[str, DataFrame] | None = None) -> None:
        """Write the tables of a catalogue that were changed where they were, with logs and mark."""
        changed = {t: getattr(cat, t) for t in Catalogue.tables() if getattr(cat, t) is not cat.stored[t]}
        touched = dict(cat.touched)
        for medium, moves in cat.moves.items():
            table = DIRECTORIES[medium]
            touched[table] = self.buckets_of(moves.select("mal_id"))
            if touched[table]:
                left = self.read(table, touched[table]).join(moves.select("mal_id"), "mal_id", "left_anti")
                changed[table] = left.unionByName(moves.filter("NOT gone").select("mal_id", "item_id"))
        self.write(changed, touched, logs, mark)


@dataclass(frozen=True)
class StoredCatalogue(Catalogue):
    """A catalogue in a store.

    ``touched`` names the buckets that title tables were narrowed to, ``moves`` the
    entries (mal_id, item_id, gone) by which the directory of a medium changes.
    """

    store: Store | None = None
    stored: dict[str, DataFrame] = field(default_factory=dict)
    touched: dict[str, frozenset[int]] = field(default_factory=dict)
    moves: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def tables(cls) -> tuple[str, ...]:
        return Catalogue.tables()

    def narrowed(self, ids: DataFrame, *tables: str) -> StoredCatalogue:
        buckets = self.store.buckets_of(ids)
        rows = {t: self.store.read(t, buckets) for t in tables}
        touched = self.touched | dict.fromkeys(tables, buckets)
        return replace(self, **rows, stored=self.stored | rows, touched=touched)

    def known(self, medium: str, mal_ids: DataFrame) -> DataFrame:
        return self.store.known(medium, mal_ids)

    def moved(self, medium: str, moves: DataFrame) -> StoredCatalogue:
        return replace(self, moves={**self.moves, medium: moves})

    def picked(self, anime_ids: list[int], print_ids: list[int]) -> StoredCatalogue:
        ids = {"anime_id": anime_ids, "manga_id": print_ids}
        rows = {t: self.store.find(t, ids[k]) for t, k in KEYS.items() if k in ids}
        return replace(self, **rows)

    def sampled(self, share: float, seed: int) -> tuple[StoredCatalogue, float]:
        """All titles of a few buckets, which have nothing in common but their hash."""
        count = max(1, round(share * self.store.buckets))
        chosen = set(Random(seed).sample(range(self.store.buckets), count))
        return replace(self, anime=self.store.read("anime", chosen), manga=self.store.read("manga", chosen)), 1.0

    def widened(self, link: Link, refs: DataFrame) -> StoredCatalogue:
        if link.table not in self.touched:
            return self
        linked = self.store.read(link.table).join(refs, link.ref, "left_semi").select(link.item)
        more = self.store.buckets_of(linked) - self.touched[link.table]
        if not more:
            return self
        rows = getattr(self, link.table).unionByName(self.store.read(link.table, more))
        touched = self.touched | {link.table: self.touched[link.table] | more}
        return replace(self, **{link.table: rows}, touched=touched)


def publish_facets(store: Store, cat: Catalogue) -> int:
    """Replace the facet table, one folder per type of facet; returns its row count."""
    keys = ("content_type", "facet_type")
    facets = build_facets(cat).select(*schema("catalogue_facet").names)
    facets.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(f"{store.root}/catalogue_facet")
    return store.read("catalogue_facet").count()
