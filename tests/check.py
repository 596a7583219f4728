"""Run queries against their DuckDB statements: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    """Sorted rows with columns in name order."""
    order = sorted(range(len(columns)), key=lambda position: columns[position])
    return [columns[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(frame):
    return rows_of(frame.columns, [tuple(row) for row in frame.collect()])


def oracle_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [item[0] for item in cursor.description]
    return rows_of(columns, cursor.fetchall())


# Spark type -> the DuckDB type of the same values
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp": "TIMESTAMP", "boolean": "BOOLEAN",
}


def type_differences(frame, connection, sql):
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {row[0]: row[1] for row in described}
    return {
        name: (kind, theirs.get(name)) for name, kind in frame.dtypes if TYPES.get(kind, kind) != theirs.get(name)
    }


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name in names:
        started = time.time()
        try:
            frame = entry.queries()[name](spark, sf_dir)
            mine = spark_rows(frame)
            middle = time.time()
            if name not in oracles:
                print(f"rows {name} {len(mine[1])}")
                continue
            theirs = oracle_rows(connection, oracles[name])
            kinds = type_differences(frame, connection, oracles[name])
            same = mine == theirs and not kinds
            print(
                f"{'ok  ' if same else 'DIFF'} {name} {len(mine[1])}/{len(theirs[1])}"
                f" {middle - started:.2f}s oracle {time.time() - middle:.2f}s",
                flush=True,
            )
            if not same:
                bad += 1
                if kinds:
                    print("  types", kinds)
                if mine[0] != theirs[0]:
                    print("  columns", mine[0], theirs[0])
                here, there = set(mine[1]), set(theirs[1])
                print("  spark only ", sorted(here - there)[:3])
                print("  oracle only", sorted(there - here)[:3], flush=True)
        except Exception as error:  # report every query, not the first failure only
            bad += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
