"""Compare registered queries with their SQL in DuckDB. Also runs from the command line."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


_SAME = {("int", "integer"), ("string", "varchar"), ("timestamp_ntz", "timestamp")}


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when rows, names and types agree, else what differs."""
    df = fn(spark, folder)
    mine = _rows(df.columns, df.collect())
    rel = con.sql(sql)
    theirs = _rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    st = {n: t for n, t in df.dtypes}
    dt = {n: str(t).lower() for n, t in zip(rel.columns, rel.types)}
    off = [(c, st[c], dt[c]) for c in st if st[c] != dt[c] and (st[c], dt[c]) not in _SAME]
    if off:
        return f"types {off}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} values, e.g. {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    only = [a for a in sys.argv[2:] if a != "--large"]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if "--large" in sys.argv:  # take the plans meant for tables beyond one task
        spark.conf.set("tablekit.rowsPerTask", "200")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    con, failed = connect(folder), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        sql, start = entry.oracle_sql().get(name), time.time()
        try:
            if sql is None:
                note = f"rows only: {fn(spark, folder).count()}"
            else:
                problem = compare(spark, con, folder, fn, sql)
                note = "ok" if problem is None else "DIFF " + problem
        except Exception as e:  # report and go on
            note = "ERROR " + type(e).__name__ + " " + str(e).strip()[:600]
        failed += note.startswith(("DIFF", "ERROR"))
        print(f"{time.time() - start:6.2f}s {name}: {note}", flush=True)
    print("failed:", failed)
