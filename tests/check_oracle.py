"""Run catalog queries next to their SQL in DuckDB and compare whole results.

    python tests/check_oracle.py [scale-folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normalised(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)

    def cell(value):
        if isinstance(value, (float, Decimal)):
            return repr(float(value))
        return None if value is None else str(value)

    columns = [table.column(name).to_pylist() for name in names]
    return sorted((tuple(map(cell, row)) for row in zip(*columns)), key=repr)


def kind(dtype: pa.DataType) -> str:
    for label, test in (("int", pa.types.is_integer), ("text", pa.types.is_string), ("time", pa.types.is_timestamp)):
        if test(dtype):
            return label
    return str(dtype)


def difference(got: pa.Table, want: pa.Table) -> str | None:
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} != {sorted(want.column_names)}"
    for name in got.column_names:
        kinds = kind(got.schema.field(name).type), kind(want.schema.field(name).type)
        if kinds[0] != kinds[1] and "null" not in kinds:
            return f"type of {name}: {kinds[0]} != {kinds[1]}"
    a, b = normalised(got), normalised(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x}\n   != {y}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if args and name not in args:
            continue
        began = time.time()
        try:
            got = build(spark, sf_dir).toArrow()
            problem = difference(got, con.execute(oracles[name]).to_arrow_table()) if name in oracles else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem, got = f"{type(error).__name__}: {str(error)[:900]}", []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={len(got)} {time.time() - began:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
