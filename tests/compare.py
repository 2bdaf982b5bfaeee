"""Runs registered queries beside their SQL in DuckDB and compares rows, columns and values.

python -m tests.compare FOLDER [QUERY...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        if isinstance(x, float):
            return f"{x + 0.0:.6g}"
        if isinstance(x, list):
            return tuple(value(y) for y in x)
        if isinstance(x, dict):
            return tuple(sorted((k, value(y)) for k, y in x.items()))
        if hasattr(x, "asDict"):
            return tuple(value(y) for y in x)
        return str(x) if x is not None else None

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


def duck(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        if p.suffix == ".parquet":
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    return [x[0] for x in cur.description], cur.fetchall()


def difference(spark, query, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    columns, expected = duck(folder, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = canonical(df.columns, rows), canonical(columns, expected)
    if a == b:
        return ""
    in_a, in_b = set(a), set(b)
    only_a, only_b = [x for x in a if x not in in_b][:3], [x for x in b if x not in in_a][:3]
    return f"rows {len(a)} against {len(b)}; only Spark {only_a}; only SQL {only_b}"


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as e

    from burstline.session import local_session

    spark = local_session(8)
    queries, sql, bad = e.queries(), e.oracle_sql(), 0
    for name in names or queries:
        began = time.time()
        try:
            said = difference(spark, queries[name], sql[name], folder) if name in sql else f"no SQL, {queries[name](spark, folder).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"error {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
