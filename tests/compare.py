"""Runs a query and its SQL text and compares schema, row count and values."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    return con


def compare(spark, con, name: str, query, sf_dir: str) -> tuple[str, int, float, float]:
    started = time.time()
    frame = query.build(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(r[c] for c in columns) for r in frame.collect()]
    spark_seconds = time.time() - started
    types = dict(frame.dtypes)
    if query.sql is None:
        return "rows", len(ours), spark_seconds, 0.0
    started = time.time()
    cursor = con.execute(query.sql)
    their_types = {d[0]: str(d[1]) for d in cursor.description}
    their_columns = [d[0] for d in cursor.description]
    raw = cursor.fetchall()
    sql_seconds = time.time() - started
    if sorted(their_columns) != columns:
        return f"columns {columns} vs {sorted(their_columns)}", len(ours), spark_seconds, sql_seconds
    order = [their_columns.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in raw]
    for c in columns:
        if types[c] not in KINDS:
            return f"type of {c} is {types[c]}", len(ours), spark_seconds, sql_seconds
        if KINDS[types[c]] != their_types[c]:
            return f"type of {c}: {types[c]} vs {their_types[c]}", len(ours), spark_seconds, sql_seconds
    a, b = Counter(ours), Counter(theirs)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return (
            f"values: {sum((a-b).values())} only spark {only_a} / {sum((b-a).values())} only sql {only_b}"
            f" columns {columns}"
        ), len(ours), spark_seconds, sql_seconds
    return ("ok" if ours else "EMPTY"), len(ours), spark_seconds, sql_seconds


def main() -> None:
    import importlib

    from plumbline.session import get_spark

    entry = importlib.import_module("__spark_entry__")
    from plumbline.registry import CATALOG

    entry.queries()
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = next((a[5:] for a in sys.argv[1:] if a.startswith("--sf=")), "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    module = next((a[6:] for a in sys.argv[1:] if a.startswith("--mod=")), None)
    names = args or [
        n for n, q in CATALOG.items() if module is None or q.build.__module__.endswith("." + module)
    ]
    spark = get_spark("compare")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            status, rows, t1, t2 = compare(spark, con, name, CATALOG[name], sf_dir)
        except Exception as exc:  # noqa: BLE001 - the report lists every failure
            status, rows, t1, t2 = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", -1, 0, 0
        if status not in ("ok", "rows"):
            bad += 1
        print(f"{name:28s} rows={rows:<7d} spark={t1:6.2f}s sql={t2:6.2f}s {status[:1500]}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")


if __name__ == "__main__":
    main()
