"""Runs registered queries beside their SQL: ``python -m catalog.check [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from catalog.registry import Query


def session(cpus: str = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _value(x: object) -> object:
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x


def _key(row: tuple) -> tuple:
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n",
                  0 if v is None else v) for v in row)


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=_key)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, root: str, query: Query, sql: str | None) -> tuple[bool, str]:
    """Exact comparison of one query's rows with its SQL's."""
    df = query(spark, root)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, (str(d[1]) for d in cur.description)))
    plain = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "date": "DATE", "boolean": "BOOLEAN"}
    odd = [(c, t, types.get(c)) for c, t in df.dtypes if plain.get(t, t) != types.get(c)]
    want = sorted_rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows against {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        return False, f"{len(wrong)} of {len(got)} rows differ, e.g. {sorted(names)} {wrong[0]}"
    return True, f"{len(got)} rows" + (f", types differ {odd}" if odd else "")


def main(argv: list[str]) -> int:
    from catalog import ORACLES, QUERIES

    root = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = session(), connect(root)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, root, QUERIES[name], ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} pass")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
