"""Compare registered queries with their DuckDB oracle: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return f"{v:.5f}"
        return str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows only: {len(got)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"spark {len(got)} rows {t1 - t0:.1f}s, duckdb {len(want)} rows {t2 - t1:.1f}s"
    if sorted(cols) != sorted(df.columns):
        return False, f"{note}; columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"{note}; spark only {only_a}; duckdb only {only_b}"
    return True, note + ("" if got else "  EMPTY")


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    sf_dir = f"/root/testdata/{sf}"
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    spark, con = session(), duck(sf_dir)
    failed = []
    for name in wanted:
        try:
            ok, note = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(wanted) - len(failed)} of {len(wanted)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
