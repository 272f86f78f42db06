"""Compare a registered query with its SQL counterpart in DuckDB.

Run ``python -m tests.oracle [sf_dir] [name part ...]`` for a table of results.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diff)} rows differ, first {diff[0]}" if diff else None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, fn in e.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        start = time.time()
        sql = e.oracle_sql().get(name)
        try:
            if sql:
                result = compare(spark, con, fn, sql, sf_dir)
                state = "ok" if result is None else f"DIFF {result}"
            else:
                state = f"rows {fn(spark, sf_dir).count()}"
        except Exception as ex:  # report and go on with the next query
            state = f"ERROR {type(ex).__name__}: {str(ex)[:600]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {state}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
