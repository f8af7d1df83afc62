"""Compare registered queries with their SQL, value by value.

``python -m workload.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from ledgerlens.session import get_session
from workload import registry
from workload.common import TABLES


def sql_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def check(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = registry.queries()[name](spark, sf_dir)
    left = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return False, f"no SQL ({len(left[1])} rows)"
    result = con.execute(sql)
    right = _sorted_rows([c[0] for c in result.description], result.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return False, f"rows {len(left[1])} vs {len(right[1])}"
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b or list(map(type, a)) != list(map(type, b))]
    if bad:
        return False, f"{len(bad)} of {len(left[1])} rows differ: {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(left[1])} rows"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(registry.oracle_sql())
    spark = get_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = sql_connection(sf_dir)
    failed = 0
    for name in names:
        began = time.time()
        try:
            ok, note = check(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.2f}s {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
