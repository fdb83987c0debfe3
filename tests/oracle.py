"""Run queries next to their DuckDB SQL and compare the rows exactly."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


# What no plan may contain: Python row by row, or all pairs of rows.
FORBIDDEN = ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin")


def compare(spark, db, folder, query, sql):
    """None when equal, else what differs."""
    frame = query(spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if found := [word for word in FORBIDDEN if word in plan]:
        return f"plan contains {found}"
    if sql is None:
        return None if frame.collect() or frame.columns else "no rows"
    return differences(frame, db, sql)


def differences(frame, db, sql):
    """None when the frame has the rows of the SQL, else what differs."""
    got = frame.collect()
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    want = answer.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    mine = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema}
    described = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    if mine != described:
        bad = {k: (mine[k], described[k]) for k in mine if mine[k] != described[k]}
        return f"types {bad}"
    a, b = _rows(frame.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from scrubline.queries import ORACLES, QUERIES
    from scrubline.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = [n for n in QUERIES if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, db, folder, QUERIES[name], ORACLES.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "" if name in ORACLES else " (no oracle)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} match")
