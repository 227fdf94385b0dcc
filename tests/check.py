"""Compare registered queries with their SQL on one data folder.

    python tests/check.py [--sf 0.01] [KEY ...]
"""

import argparse
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from paperloom.fixtures import TABLES  # noqa: E402
from paperloom.session import build_session  # noqa: E402


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = build_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    bad = []
    for key, build in entry.queries().items():
        if args.keys and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in args.keys):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            got = rows(df.columns, df.collect())
            spent = time.time() - start
            if key not in sql:
                print(f"{key:5} rows {len(got[1])} {spent:.1f}s")
                continue
            start = time.time()
            cur = con.execute(sql[key])
            want = rows([c[0] for c in cur.description], cur.fetchall())
            duck = time.time() - start
        except Exception as exc:  # report and go on
            bad.append(key)
            print(f"{key:5} ERROR {str(exc)[:700]}")
            continue
        if got == want:
            print(f"{key:5} ok {len(got[1])} rows {spent:.1f}s / {duck:.1f}s")
            continue
        bad.append(key)
        print(f"{key:5} DIFF {got[0]} vs {want[0]}; {len(got[1])} vs {len(want[1])}")
        left, right = set(got[1]), set(want[1])
        print("   spark only", sorted(left - right)[:3])
        print("   sql only  ", sorted(right - left)[:3])
    print("bad:", bad)


if __name__ == "__main__":
    main()
