"""Repair of conversation structure by the cheapest edits.

A sound conversation has the role initials ``(s?(ua)+)?``: at most one system turn,
then pairs of user and assistant. Turns may be kept, given another role, deleted, or
inserted without text; turns that are blank or repeat an earlier turn have to go, and
a truncated turn costs more when it stays. Of the cheapest edits those with the
ASCII-least initials are taken.

The rows are dealt by conversation and sorted by turn. One pass per task carries the
cheapest way into each of the four states (nothing yet, after a system, user or
assistant turn) from one Arrow batch to the next, with the running SHA-256 of the
turns kept on that way, so no text is held back. What is remembered of a row are two
bytes of backpointers; beyond ``SPILL_ROWS`` rows of a conversation they go to files
below ``spark.checkpoint.dir``, which are read from the last to the first.

Two ways into one state differ in their initials before either ends, so comparing the
ways of one row by rank is enough to keep the least initials.

Defined results: a null role or text is one space. Null turns come first; rows of the
same turn are ordered by role and text, and rows that repeat one another stand side
by side. A role without an initial (empty) can't be kept. Rows with a null id form one
conversation. A conversation whose rows are all dropped has zeros, no audit and the
hash of the empty string. Gaps beyond a long wrap around. No rows give no rows; other
columns are not read. One audit is one string, so it has to fit a task.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelshelf.llm.common import read_table
from reelshelf.session import scratch_dir

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPILL_ROWS = 1 << 20
BLANKS = " \t\n\x0b\x0c\r"
SOUND, BLANK, DUPLICATE, CUT = range(4)
SUMMARY = (
    "_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, opens_with_system boolean, repaired_sha256 string"
)

# States of the turns kept so far, and the edits in the order of their initials.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_EDITS = ("D", "IK", "IR", "K", "R")
_DELETE, _INSERT_KEEP, _INSERT_REROLE, _KEEP, _REROLE = range(5)
_FAR = 1 << 50
# Bytes that stand between the turns kept so far and the next one, without and with an insertion.
_JOINT = {
    EMPTY: (b"", b"user:\n"),
    SYSTEM: (b"\n", b"\nuser:\n"),
    USER: (b"\n", b"\nassistant:\n"),
    ASSISTANT: (b"\n", b"\nuser:\n"),
}
_ENDING = {EMPTY: (0, "", b""), ASSISTANT: (0, "", b""), USER: (1, "I", b"\nassistant:"), SYSTEM: (2, "II", b"\nuser:\nassistant:")}


def ordered(rows: DataFrame) -> DataFrame:
    """Turns by conversation and turn, with ``_fault`` and ``_position`` (from 1).

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; a row whose optional
    column ``dropped`` is true only tells that its conversation exists.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    rows = rows.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(~dropped, F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(~dropped, F.coalesce("text", F.lit(" "))).alias("text"),
        dropped.alias("_dropped"),
    ).repartition("_key")
    same = Window.partitionBy("_key", "_dropped", "role", "text").orderBy("turn")
    rows = rows.withColumn("_repeat", F.row_number().over(same))
    place = Window.partitionBy("_key").orderBy("_dropped", "turn", "role", "text", "_repeat")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = (
        F.when(end == "", BLANK).when(F.col("_repeat") > 1, DUPLICATE).when(~end.isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    return rows.select(
        "conv_id", "_key", "turn", "role", "text", "_dropped", "_repeat", fault.alias("_fault"), F.row_number().over(place).alias("_position")
    )


class Backpointers:
    """Two bytes a row, held in memory or in files of ``block`` rows each."""

    def __init__(self, folder: str, block: int):
        self.folder, self.block = folder, block
        self.recent, self.files = array("H"), []

    def add(self, word: int) -> None:
        self.recent.append(word)
        if len(self.recent) >= self.block:
            system, root = fs.FileSystem.from_uri(self.folder)
            system.create_dir(root)
            name = f"{root}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                out.write(self.recent.tobytes())
            self.files.append(name)
            self.recent = array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.recent)
        while self.files:
            system, _ = fs.FileSystem.from_uri(self.folder)
            name, words = self.files.pop(), array("H")
            with system.open_input_stream(name) as rows:
                words.frombytes(rows.read())
            system.delete_file(name)
            yield from reversed(words)


def _wrapped(value: int) -> int:
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


class Repair:
    """The state of one conversation; rows are added in order."""

    def __init__(self, folder: str, spill_rows: int = SPILL_ROWS):
        self.cost = [0, _FAR, _FAR, _FAR]
        self.rank = [0, 1, 2, 3]  # of the initials of each state's way
        self.hash = [hashlib.sha256(), None, None, None]
        self.back = Backpointers(folder, spill_rows)
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.initial: str | None = None
        self.turns: list[int] = []  # smallest and latest
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.faults[fault] += 1
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn]
                self.distinct = 1
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.distinct += 1

        # A way is one number: its cost, the rank of where it came from, its edit.
        cost, rank = self.cost, self.rank
        ways = [(cost[s] + DELETE) << 5 | rank[s] << 3 | _DELETE for s in range(4)]
        if fault in (SOUND, CUT):
            extra = TRUNCATED if fault == CUT else 0
            if initial == "s":
                ways[SYSTEM] = min(ways[SYSTEM], (cost[EMPTY] + extra) << 5 | rank[EMPTY] << 3 | _KEEP)
            for state, name in ((USER, "u"), (ASSISTANT, "a")):
                same = initial == name
                price = extra if same else extra + REROLE
                for origin in range(4):
                    # Only a user turn may precede an assistant turn, and none of them a user turn.
                    if (origin == USER) == (state == ASSISTANT):
                        edit, more = (_KEEP if same else _REROLE), 0
                    else:
                        edit, more = (_INSERT_KEEP if same else _INSERT_REROLE), INSERT
                    way = (cost[origin] + price + more) << 5 | rank[origin] << 3 | edit
                    if way < ways[state]:
                        ways[state] = way

        at_rank = [0] * 4
        for state, r in enumerate(rank):
            at_rank[r] = state
        word, hashes = 0, [self.hash[EMPTY], None, None, None]
        body = None
        for state in (SYSTEM, USER, ASSISTANT):
            way = ways[state]
            if way >> 5 >= _FAR:
                continue
            origin, edit = at_rank[way >> 3 & 3], way & 7
            word |= (origin << 3 | edit) << (5 * state - 5)
            if edit == _DELETE:
                hashes[state] = self.hash[origin]
                continue
            if body is None:
                body = text.encode()
            done = self.hash[origin].copy()
            done.update(_JOINT[origin][edit in (_INSERT_KEEP, _INSERT_REROLE)])
            kept = edit in (_KEEP, _INSERT_KEEP)
            done.update(f"{role}:".encode() if kept else b"user:" if state == USER else b"assistant:")
            done.update(body)
            hashes[state] = done
        self.back.add(word)
        self.hash = hashes
        self.cost = [min(w >> 5, _FAR) for w in ways]
        for place, state in enumerate(sorted(range(4), key=lambda s: ways[s] & 31 if self.cost[s] < _FAR else 32)):
            self.rank[state] = place

    def result(self) -> tuple:
        """Gaps, faults, illegal pairs, cost, audit, whether a system turn opens, and the hash."""
        ends = [(self.cost[s] + INSERT * n, self.rank[s], s) for s, (n, _, _) in _ENDING.items() if self.cost[s] < _FAR]
        cost, _, state = min(ends)
        _, edits, tail = _ENDING[state]
        done = self.hash[state].copy()
        done.update(tail)
        audit, opens = bytearray(edits.encode()), state == SYSTEM
        for word in self.back.backwards():
            if state == EMPTY:
                audit += b"D"
                continue
            way = word >> (5 * state - 5)
            origin, edit = way >> 3 & 3, way & 7
            audit += _EDITS[edit].encode()[::-1]
            opens |= origin == SYSTEM
            state = origin
        audit.reverse()
        first, last = self.turns or (0, 0)
        gaps = _wrapped(last - first + 1 - self.distinct) if self.turns else 0
        _, blank, duplicate, cut = self.faults
        return gaps, blank, duplicate, cut, self.illegal, cost, audit.decode(), opens, done.hexdigest()


def _stream(folder: str, spill_rows: int):
    names = [c.strip().split(" ")[0] for c in SUMMARY.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, repair = None, None
        for batch in batches:
            done = []
            columns = (batch[c].tolist() for c in ("_key", "_turn", "role", "text", "_dropped", "_fault"))
            for now, turn, role, text, dropped, fault in zip(*columns, strict=True):
                if now != key:
                    if repair is not None:
                        done.append((key, *repair.result()))
                    key, repair = now, Repair(folder, spill_rows)
                if not dropped:
                    repair.add(int(turn) if turn else None, role, text, fault)
            yield pd.DataFrame(done, columns=names)
        if repair is not None:
            yield pd.DataFrame([(key, *repair.result())], columns=names)

    return run


def repair(rows: DataFrame, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: its faults, and the cost, audit and hash of its repair."""
    folder = f"{scratch_dir(rows.sparkSession)}/reelshelf/backpointers-{uuid.uuid4().hex}"
    turns = ordered(rows)
    # Turns travel as text, because pandas has no column of longs with nulls.
    turns = turns.sortWithinPartitions("_key", "_dropped", "turn", "role", "text", "_repeat").select(
        "conv_id", "_key", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("_turn"), "role", "text", "_dropped", "_fault"
    )
    found = turns.drop("conv_id").mapInPandas(_stream(folder, spill_rows), SUMMARY)
    kind = turns.schema["conv_id"].dataType
    name = F.when(F.col("_key") != "", F.substring("_key", 2, 1 << 30).cast(kind)).alias("conv_id")
    return found.select(name, *[c for c in found.columns if c != "_key"])


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: rows (conv_id, place, role, text), inserted turns among them.

    ``found`` is what :func:`repair` gives for ``rows``. The audit says which turns stay, and the place says the role of those that were
    inserted or given another one.
    """
    edits = found.select("conv_id", "opens_with_system", F.posexplode(F.split("audit", "")).alias("_i", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("conv_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.select(
        "conv_id",
        "edit",
        F.sum((F.col("edit") != "I").cast("int")).over(so_far).alias("_position"),
        F.sum((F.col("edit") != "D").cast("int")).over(so_far).alias("place"),
        F.col("opens_with_system").cast("int").alias("_opens"),
    ).where("edit <> 'D'")
    user = (F.col("place") - F.col("_opens")) % 2 == 1
    kept = ordered(rows).where(~F.col("_dropped")).select(F.col("conv_id").alias("_conv"), F.col("_position").alias("_row"), "role", "text")
    match = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_position") == F.col("_row")) & (F.col("edit") != "I")
    return edits.join(kept, match, "left").select(
        "conv_id",
        "place",
        F.when(F.col("edit") == "K", F.col("role")).when(user, "user").otherwise("assistant").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Known damage, by a checksum of each turn's name: dropped, emptied, cut, doubled or reroled turns."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("_kind"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("dropped"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows)).drop("opens_with_system")


_BIT = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
OP11_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
), coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce([4294967295] || list_transform(range(1, length(name) + 1), lambda i: ord(substr(name, i, 1))::BIGINT),
                         lambda c, b: {_BIT}), 4294967295) % 20 AS kind
  FROM named
), damaged AS (
  SELECT conv_id, turn,
         CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged)
), faulty AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN last = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM numbered
), rules(origin, state, inserted) AS (
  VALUES ('', 'u', ''), ('s', 'u', ''), ('a', 'u', ''), ('u', 'u', 'assistant'), ('u', 'a', ''), ('', 'a', 'user'), ('s', 'a', 'user'), ('a', 'a', 'user')
), ways AS (
  SELECT conv_id, 0::BIGINT AS n, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS turns FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, state, best.cost, best.audit, best.turns
  FROM (
    SELECT conv_id, n, state, min({{'cost': cost, 'audit': audit, 'turns': turns}}) AS best
    FROM (
      SELECT w.conv_id, f.n, w.state, w.cost + 2 AS cost, w.audit || 'D' AS audit, w.turns
      FROM ways w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1
      UNION ALL
      SELECT w.conv_id, f.n, 's', w.cost + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, w.audit || 'K', list_append(w.turns, f.role || ':' || f.text)
      FROM ways w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1
      WHERE w.state = '' AND f.initial = 's' AND f.fault IN ('none', 'truncated')
      UNION ALL
      SELECT w.conv_id, f.n, r.state,
             w.cost + CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END + CASE WHEN r.inserted = '' THEN 0 ELSE 5 END
                    + CASE WHEN f.initial = r.state THEN 0 ELSE 1 END,
             w.audit || CASE WHEN r.inserted = '' THEN '' ELSE 'I' END || CASE WHEN f.initial = r.state THEN 'K' ELSE 'R' END,
             list_append(CASE WHEN r.inserted = '' THEN w.turns ELSE list_append(w.turns, r.inserted || ':') END,
                         CASE WHEN f.initial = r.state THEN f.role WHEN r.state = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text)
      FROM ways w JOIN faulty f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = w.n + 1
      JOIN rules r ON r.origin = w.state
      WHERE f.fault IN ('none', 'truncated')
    )
    GROUP BY conv_id, n, state
  )
), counted AS (
  SELECT conv_id, count(*) AS rows,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM faulty)
  GROUP BY conv_id
), ends AS (
  SELECT w.conv_id, min({{
    'cost': w.cost + CASE w.state WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END,
    'audit': w.audit || CASE w.state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
    'turns': list_concat(w.turns, CASE w.state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END)
  }}) AS best
  FROM ways w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id
  WHERE w.n = coalesce(c.rows, 0)
  GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit,
       sha256(array_to_string(e.best.turns, chr(10))) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
