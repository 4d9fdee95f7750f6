"""Runs registered queries in Spark and their twins in DuckDB, and compares the results."""

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks import ORACLES, QUERIES
from checks.registry import with_folder

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    """Floats by their digits, so that NaN equals itself and -0.0 differs from 0.0."""
    return repr(value) if isinstance(value, float) else value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df: DataFrame, con, sql: str) -> str | None:
    """What differs between a Spark result and a DuckDB query, or None."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want, got = _rows(names, expected.fetchall()), _rows(df.columns, df.collect())
    if want == got:
        return None
    return f"{sum(got.values())} rows, expected {sum(want.values())}; extra {list((got - want))[:2]}; missing {list((want - got))[:2]}"


def main(sf_dir: str, pattern: str = "") -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    with_folder(spark).sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in [n for n in QUERIES if pattern in n]:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            note = difference(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
            bad = name in ORACLES and note is not None
        except Exception as error:
            note, bad = f"{type(error).__name__}: {str(error)[:700]}", True
        failed += bad
        print(f"{'FAIL' if bad else 'ok  '} {name} {time.time() - start:.2f}s {note or ''}", flush=True)
    print(f"{failed} failed of {len(QUERIES)}")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]) > 0)
