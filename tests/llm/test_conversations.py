"""Conversation repair against all edits of small conversations, and against its SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from reelshelf.llm import conversation_repair as cr

ROWS = "conv_id long, turn long, role string, text string, dropped boolean"


def by_hand(rows):
    """All edits of (turn, role, text) rows in order: least (cost, audit) and the repaired turns."""
    seen, faults = set(), []
    for _, role, text in rows:
        words = text.strip(cr.BLANKS)
        if not words:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("none" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    edits = ["K", "R user", "R assistant", "D"]
    for chosen in itertools.product(edits, repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, chosen)):
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for role in gaps[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((role, ""))
                if i == len(rows):
                    break
                _, role, text = rows[i]
                edit = chosen[i]
                audit += edit[0]
                cost += {"K": 0, "R": 1, "D": 2}[edit[0]]
                if edit != "D":
                    cost += 5 * (faults[i] == "truncated")
                    out.append((role if edit == "K" else edit[2:], text))
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
                if best is None or (cost, audit) < best[:2]:
                    best = cost, audit, out
    return best, faults


def hashed(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["A b.", "C d?", "cut off", "", " \t", "E!", "trail. \n"]
    out = []
    for conv in range(count):
        rows = [(rng.choice([None, 0, 1, 2, 5]), rng.choice(["system", "user", "assistant", "tool", "s", ""]), rng.choice(texts)) for _ in range(rng.randint(0, longest))]
        out.append((conv, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))))
    return out


def test_repair_against_all_edits(spark):
    convs = conversations(5, 60, 3)
    rows = [(c, *r, False) for c, turns in convs for r in turns] + [(c, 0, None, None, True) for c, _ in convs]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, ROWS)
    found = cr.repair(table, spill_rows=2)
    got = {r.conv_id: r for r in found.collect()}
    assert len(got) == len(convs)
    turns = {}
    for r in cr.repaired_turns(table, found).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, rows in convs:
        (cost, audit, out), faults = by_hand(rows)
        r = got[conv]
        assert (r.cost, r.audit) == (cost, audit), rows
        assert r.repaired_sha256 == hashed(out) and turns.get(conv, []) == out
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        known = [t for t, _, _ in rows if t is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_giant_conversation_spills_and_keeps_its_turns(spark):
    """One conversation over many Arrow batches beside small ones; files of backpointers go again."""
    n = 30_000
    giant = spark.range(n).selectExpr(
        "7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('turn ', id, '.') AS text", "false AS dropped"
    )
    small = spark.range(100, 200).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'Hello.' AS text", "false AS dropped")
    got = {r.conv_id: r for r in cr.repair(giant.unionByName(small), spill_rows=1000).collect()}
    assert len(got) == 101 and got[7].cost == 0 and got[7].audit == "K" * n
    assert got[7].repaired_sha256 == hashed([(("user", "assistant")[i % 2], f"turn {i}.") for i in range(n)])
    assert got[150].audit == "D"


def test_files_of_backpointers_are_removed(tmp_path):
    back = cr.Backpointers(f"file://{tmp_path}/b", 10)
    for i in range(95):
        back.add(i)
    assert len(list((tmp_path / "b").iterdir())) == 9
    assert list(back.backwards()) == list(range(94, -1, -1))
    assert not list((tmp_path / "b").iterdir())


def test_nulls_ties_long_texts_and_empty_tables(spark):
    long = "word " * 400_000 + "end."
    table = spark.createDataFrame(
        [
            (None, None, None, None, 1),
            (1, None, "user", long, 2),
            (1, 1, "assistant", "Yes.", 3),
            (1, 1, "assistant", "Yes.", 4),
            (2, -(2**63), "user", "A.", 5),
            (2, 2**63 - 1, "assistant", "B.", 6),
        ],
        "conv_id long, turn long, role string, text string, _fault int",
    )
    got = {r.conv_id: r for r in cr.repair(table).collect()}
    assert (got[None].blank, got[None].audit, got[None].repaired_sha256) == (1, "D", hashed([]))
    assert (got[1].audit, got[1].duplicate, got[1].gaps) == ("KKD", 1, 0)
    assert got[1].repaired_sha256 == hashed([("user", long), ("assistant", "Yes.")])
    assert got[2].gaps == -2 and got[2].cost == 0
    assert cr.repair(table.limit(0)).count() == 0
    names = table.selectExpr("concat('c', conv_id) AS conv_id", "turn", "role", "text")
    assert {r.conv_id for r in cr.repair(names).collect()} == {None, "c1", "c2"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    from oracle import connect

    folder = f"/root/testdata/{sf}"
    df = cr.op11_conversation_repair(spark, folder)
    rel = connect(folder).sql(cr.OP11_SQL).select(*[f'"{c}"' for c in df.columns])
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, None if t == 3 else "system", "One. Two! three?" if c % 2 else None) for c in range(20) for t in [None, *range(5)]]
    got = cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if kind == 4 else role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, role, text, kind == 0)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
