"""Compare registered queries with their SQL on an embedded engine.

Run ``python tests/oracle.py FOLDER [NAME...]`` for a report.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v)
    return str(v)


def _kind(type_name: str) -> str:
    t = type_name.lower()
    for kind, names in {
        "int": ("bigint", "int", "integer", "smallint", "tinyint", "long"),
        "float": ("double", "float"),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
        "date": ("date",),
        "time": ("timestamp", "timestamp_ntz"),
    }.items():
        if t in names:
            return kind
    return t


def compare(spark, con, name: str, folder: str) -> str:
    """Empty text when both engines agree, else the difference."""
    from reelshelf.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, folder)
    ours = [[_cell(r[c]) for c in sorted(df.columns)] for r in df.collect()]
    if name not in ORACLES:
        return "" if ours else "no rows"
    rel = con.sql(ORACLES[name])
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    for field in df.schema:
        if _kind(field.dataType.simpleString()) != kinds[field.name]:
            return f"type of {field.name}: {field.dataType.simpleString()} != {kinds[field.name]}"
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    theirs = [[_cell(r[i]) for i in order] for r in rel.fetchall()]
    ours.sort(), theirs.sort()
    if ours != theirs:
        first = next((p for p in zip(ours, theirs) if p[0] != p[1]), None)
        return f"{len(ours)} rows vs {len(theirs)}; {sorted(df.columns)}; first difference {first}"
    return "" if ours else "both empty"


def main() -> None:
    from reelshelf import build_session
    from reelshelf.queries import QUERIES

    folder = sys.argv[1]
    names = [n for n in QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as error:  # report every query, also the failing ones
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
