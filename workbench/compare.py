"""Run the registered queries and their SQL side by side: python -m workbench.compare [folder] [names…]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workbench.cases import CASES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WORKBENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{type(value).__name__}:{value!r}"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    return [names[at] for at in order], sorted(tuple(cell(row[at]) for at in order) for row in rows)


def check(spark, connection, folder: str, name: str) -> str:
    case = CASES[name]
    started = time.time()
    df = case.run(spark, folder)
    rows = [tuple(row) for row in df.collect()]
    took = time.time() - started
    if case.sql is None:
        return f"{name}: {len(rows)} rows, no SQL, {took:.1f} s"
    answer = connection.execute(case.sql)
    expected = normal([column[0] for column in answer.description], answer.fetchall())
    found = normal(df.columns, rows)
    if found == expected:
        return f"{name}: ok, {len(rows)} rows, {took:.1f} s"
    if found[0] != expected[0]:
        return f"{name}: FAIL, columns {found[0]} against {expected[0]}"
    wrong = [(a, b) for a, b in zip(found[1], expected[1]) if a != b]
    return f"{name}: FAIL, {len(found[1])} rows against {len(expected[1])}, {len(wrong)} differ, first {wrong[:2]}, {took:.1f} s"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CASES)
    spark, connection = session(), database(folder)
    failures = 0
    for name in names:
        try:
            line = check(spark, connection, folder, name)
        except Exception as error:  # one broken query must not hide the others
            line = f"{name}: FAIL, {type(error).__name__}: {str(error)[:600]}"
        failures += "FAIL" in line
        print(line, flush=True)
    print(f"{failures} of {len(names)} failed")
    return min(failures, 1)


if __name__ == "__main__":
    sys.exit(main())
