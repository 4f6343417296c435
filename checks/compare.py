"""Run registered queries next to their DuckDB SQL and compare the values.

Usage: python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from veilframe.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def canonical(df: pd.DataFrame) -> list[tuple]:
    ordered = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in ordered.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both results hold the same rows."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0][0]} against {wrong[0][1]}" if wrong else ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            ours = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"{name:32s} ERROR {str(error)[:600]}")
            continue
        seconds = time.time() - start
        note = "rows only"
        if name in ORACLE:
            start = time.time()
            try:
                note = difference(ours, db.execute(ORACLE[name]).fetch_df()) or "same"
            except duckdb.Error as error:
                note = f"SQL ERROR {str(error)[:300]}"
            note += f" (sql {time.time() - start:.1f}s)"
            failed += not note.startswith("same")
        print(f"{name:32s}{len(ours):8d} rows {seconds:6.1f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} wrong")
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
