"""Run every query on Spark and its statement on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connect(sf_dir: str):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value) if type(value).__name__ == "Decimal" else value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(spark, db, sf_dir, function, sql) -> tuple[bool, str, float]:
    started = time.time()
    got = function(spark, sf_dir).toPandas()
    seconds = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no statement", seconds
    want = db.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}", seconds
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"rows {len(a)} / {len(b)} columns {sorted(got.columns)}\n   spark  {only_a}\n   duckdb {only_b}", seconds
    note = "" if kinds(got) == kinds(want) else " types " + str({c: (k, kinds(want)[c]) for c, k in kinds(got).items() if k != kinds(want)[c]})
    return True, f"{len(a)} rows{note}", seconds


def main() -> int:
    from sealcheck.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                                "spark.ui.showConsoleProgress": "false",
                                                "spark.sql.session.timeZone": os.environ.get("COMPARE_TZ", "UTC")})
    spark.sparkContext.setLogLevel("OFF")
    from checks.oracle import SQL
    from checks.spark_queries import QUERIES
    db, failed = connect(sf_dir), []
    for name in QUERIES:
        if wanted and not any(name == w or name.startswith(w + "_") or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note, seconds = compare(spark, db, sf_dir, QUERIES[name], SQL.get(name))
        except Exception as error:      # report and go on with the next query
            ok, note, seconds = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} {seconds:.1f}s {note}", flush=True)
        failed += [] if ok else [name]
    print(f"{len(failed)} failed: {failed}; statements without query: {sorted(set(SQL) - set(QUERIES))}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
