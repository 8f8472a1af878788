"""Compare every query with its SQL: columns, rows, values. ``python tests/check.py <folder> [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name, so that both engines print alike."""
    columns = sorted(frame.columns)

    def text(value) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value) or value is pd.NA:
            return "null"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            number = float(value)
            return repr(number + 0.0) if number else "0.0"
        return str(value)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(set(spark_frame.columns) ^ set(sql_frame.columns))}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} rows, expected {len(right)}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        return f"{len(different)} of {len(left)} rows differ, first {different[0]}"
    return None


def main() -> None:
    import __spark_entry__ as contract
    from zephyra.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), database(folder)
    sql = contract.oracle_sql()
    bad = 0
    for name, run in contract.queries().items():
        if (wanted and name not in wanted) or (not wanted and name not in sql):
            continue
        start = time.time()
        try:
            made = run(spark, folder).toPandas()
            took = time.time() - start
            start = time.time()
            expected = con.execute(sql[name]).df()
            problem = compare(made, expected)
            note = "" if kinds(made) == kinds(expected) else f" kinds {kinds(made)} {kinds(expected)}"
        except Exception as error:  # noqa: BLE001
            problem, took, note = f"{type(error).__name__}: {str(error)[:700]}", 0.0, ""
        bad += problem is not None
        status = "ok  " if problem is None else "FAIL"
        print(f"{status} {name:28s} {took:6.2f}s sql {time.time() - start:6.2f}s {problem or ''}{note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
