"""Run registered queries beside their SQL: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (0.0 if v == 0 else v)
        if hasattr(v, "asDict"):
            return str(v.asDict())
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows),
                  key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


FAMILY = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "huge",
          "double": "double", "float": "double", "string": "str", "varchar": "str", "boolean": "bool",
          "timestamp_ntz": "ts", "timestamp": "ts", "date": "date"}


def compare(df, con, sql: str, rows=None):
    """None when equal, else a message."""
    got_rows = [tuple(r) for r in (df.collect() if rows is None else rows)]
    rel = con.sql(sql)
    exp_rows, exp_cols = rel.fetchall(), rel.columns
    if sorted(df.columns) != sorted(exp_cols):
        return f"columns {sorted(df.columns)} != {sorted(exp_cols)}"
    exp_types = dict(zip(exp_cols, [str(t).lower() for t in rel.types]))
    for c, t in df.dtypes:
        a, b = FAMILY.get(t, t), FAMILY.get(exp_types[c], exp_types[c])
        if a != b:
            return f"type of {c}: {t} != {exp_types[c]}"
    got, exp = norm(got_rows, df.columns), norm(exp_rows, exp_cols)
    if len(got) != len(exp):
        return f"rows {len(got)} != {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, columns {sorted(df.columns)}, first:\n   got {bad[0][0]}\n   exp {bad[0][1]}"
    return None if got else "EMPTY"


def main() -> None:
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf, args = f"/root/testdata/{args[0]}", args[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "10g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if "--blocks" in args:  # force the path for inputs of any size
        args.remove("--blocks")
        spark.conf.set("nodehours.blockRows", "200")
    con, fails = connect(sf), 0
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t, mine = time.time(), 0.0
        try:
            if name in sqls:
                df = fn(spark, sf)
                rows = df.collect()
                mine = time.time() - t
                msg = compare(df, con, sqls[name], rows)
            else:
                msg = None if fn(spark, sf).count() else "EMPTY"
        except Exception as err:  # report and go on
            msg = f"{type(err).__name__}: {str(err)[:900]}"
        fails += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {mine:.1f}s + sql {time.time() - t - mine:.1f}s {'' if name in sqls else '(rows only)'} {msg or ''}", flush=True)
    print("failures:", fails)


if __name__ == "__main__":
    main()
