"""Run every registered query against its SQL and compare rows, columns and values."""

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, run, sql):
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    got_cols, got = as_bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_cols, want = as_bag([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {set(got_cols) ^ set(want_cols)}"
    if got != want:
        extra, missing = list((got - want).items()), list((want - got).items())
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {len(extra)}: {extra[:2]}; "
            f"only sql {len(missing)}: {missing[:2]}"
        )
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from cohortloom.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-stages-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf, name, run, oracle[name]) if name in oracle else "no sql"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__} {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:32s} {time.time() - t:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("different:", bad)
