"""Run registered queries against their SQL in DuckDB: python tests/check_queries.py [-s SF_DIR] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(9)
        frame[c] = frame[c].map(lambda v: "NULL" if v is None or v is pd.NA else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def compare(spark_frame, sql_frame):
    """None if equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    kinds = {c: (str(spark_frame[c].dtype), str(sql_frame[c].dtype)) for c in spark_frame.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and len(spark_frame)}
    if odd:
        return f"types {odd}"
    a, b = normal(spark_frame), normal(sql_frame)
    bad = (a != b).any(axis=1)
    if bad.any():
        return f"{bad.sum()} rows differ\n{a[bad].head(3)}\n{b[bad].head(3)}"
    return None


def main():
    import tempfile

    import __spark_entry__ as e
    from signalvault.session import build_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.local.dir": scratch, "spark.sql.warehouse.dir": scratch, "spark.checkpoint.dir": scratch + "/cp"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - start
            want = con.sql(oracles[name]).df() if name in oracles else None
            problem = compare(got, want) if want is not None else None
            status = problem or ("ok" if want is not None else "rows only")
        except Exception as x:  # noqa: BLE001
            took, got, problem = time.time() - start, [], str(x)[:1500]
            status = "ERROR " + problem
        print(f"{name:24s} {len(got):8d} rows {took:6.2f}s {status}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
