"""Run catalog queries against their SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
            )
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def difference(df, connection, sql: str) -> str | None:
    """A description of the first mismatch, or None when both results are the same bag of rows."""
    result = connection.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = Counter(tuple(_plain(row[i]) for i in at) for row in expected)
    got = Counter(tuple(_plain(v) for v in row) for row in df.select(*(f"`{c}`" for c in order)).collect())
    if want == got:
        return None
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; "
        f"only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    )


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from cellpulse.catalog import QUERIES
    from cellpulse.oracle import ORACLE

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name in names:
        began = time.time()
        try:
            outcome = difference(QUERIES[name](spark, sf_dir), connection, ORACLE[name])
        except Exception as error:  # report and go on with the next query
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - began:6.2f}s  {'ok' if outcome is None else outcome}", flush=True)
