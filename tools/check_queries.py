"""Compare every registered query with its DuckDB SQL on one folder of tables.

usage: python tools/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from grainwise.queries import load  # noqa: E402
from grainwise.queries.base import TABLE_NAMES, Tables  # noqa: E402
from grainwise.session import configure  # noqa: E402


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, repr(value + 0.0))
    return (1, str(value))


def main() -> int:
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    registry = load()
    names = args[1:] or list(registry)
    spark = configure(
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for table in TABLE_NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names:
        q = registry[name]
        start = time.time()
        try:
            got = q.run(Tables(spark, folder)).toArrow()
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name}: {got.num_rows} rows, {took:.1f}s")
                continue
            want = con.execute(q.sql).to_arrow_table()
            columns = sorted(got.column_names)
            problems = []
            if columns != sorted(want.column_names):
                problems.append(f"columns {columns} / {sorted(want.column_names)}")
            else:
                types = {c: (str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in columns}
                odd = {c: t for c, t in types.items() if t[0].replace("large_", "") != t[1].replace("large_", "")}
                if odd:
                    problems.append(f"types {odd}")
                a = sorted(tuple(plain(r[c]) for c in columns) for r in got.to_pylist())
                b = sorted(tuple(plain(r[c]) for c in columns) for r in want.to_pylist())
                if a != b:
                    gone, extra = [x for x in b if x not in a], [x for x in a if x not in b]
                    problems.append(f"{len(a)} / {len(b)} rows; spark only {extra[:3]}; duckdb only {gone[:3]}")
            bad += bool(problems)
            print(f"{'FAIL ' if problems else 'ok   '} {name}: {got.num_rows} rows, {took:.1f}s {' | '.join(problems)}")
        except Exception as error:  # report and go on
            bad += 1
            text = "".join(traceback.format_exception_only(error)).strip()
            print(f"ERROR {name}: {text[:700]}")
    print(f"{len(names)} queries, {bad} not matching")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
