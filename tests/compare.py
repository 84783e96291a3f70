"""Run registered queries against their DuckDB text: ``python tests/compare.py <sf> [name ...]``."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql, limit=3):
    """Empty when the Spark result equals the DuckDB result."""
    expected = con.execute(sql)
    want_columns = [d[0] for d in expected.description]
    want = rows_of(want_columns, expected.fetchall())
    got = rows_of(df.columns, df.collect())
    problems = []
    if sorted(df.columns) != sorted(want_columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(want_columns)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want and not problems:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:limit]
        problems += [f"got {str(g)[:400]}\n   want {str(w)[:400]}" for g, w in odd]
    return problems


if __name__ == "__main__":
    import __spark_entry__ as entry

    from lingospan.config import build_session

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            df = build(spark, sf_dir)
            problems = differences(df, con, oracles[name]) if name in oracles else [] if df.collect() else ["no rows"]
        except Exception:
            problems = [traceback.format_exc()[-1500:]]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - began:.2f}s", *problems, sep="\n   " if problems else " ")
    print("failed:", failed)
