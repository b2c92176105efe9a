"""Runs registered queries and their SQL side by side: python -m tests.compare SF_DIR [prefix...]"""

from __future__ import annotations

import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES.split():
        path = f"{sf_dir}/{name}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    right = rows_of([d[0] for d in got.description], got.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} / {len(right[1])} rows"
    odd = [(a, b) for a, b in zip(left[1], right[1]) if a != b and not (repr(a) == repr(b))]
    return f"{len(odd)} of {len(left[1])} rows differ: {odd[:2]}" if odd else ""


def main(sf_dir: str, prefixes: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad, done, queries, oracles = duck(sf_dir), 0, 0, entry.queries(), entry.oracle_sql()
    for name, sql in oracles.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            found = differences(spark, con, sf_dir, queries[name], sql)
        except Exception as e:  # reported, so that the others still run
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad, done = bad + bool(found), done + 1
        if found:
            print(name, found[:900], flush=True)
    print(f"{bad} of {done} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
