"""Run registered queries beside their check SQL and compare whole results.

    python tests/run_checks.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("satchel")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    return value


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canon(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    cols, got = bag(df.columns, df.collect())
    if not sql:
        return f"rows only ({sum(got.values())})"
    rel = con.sql(sql)
    want_cols, want = bag(rel.columns, rel.fetchall())
    if cols != want_cols:
        return f"COLUMNS {cols} != {want_cols}"
    if got != want:
        extra, lost = list((got - want).elements()), list((want - got).elements())
        return f"DIFF spark+{len(extra)} {str(extra[:2])[:300]} / sql+{len(lost)} {str(lost[:2])[:300]}"
    return f"ok ({sum(got.values())})"


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(f"/root/testdata/sf{sf}")
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            verdict = compare(spark, con, query, sqls.get(name, ""), sf_dir)
        except Exception as exc:  # report and go on with the next query
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:400]}"
        bad += not verdict.startswith(("ok", "rows"))
        print(f"CHECK {name:24s} {time.time() - began:6.1f}s {verdict}", flush=True)
    print("CHECK bad:", bad)


if __name__ == "__main__":
    main()
