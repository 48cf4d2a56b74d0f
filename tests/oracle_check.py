"""Run registered queries next to their SQL and compare whole results.

``python tests/oracle_check.py [sf] [query ...]``
"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, db, query, sql, sf_dir):
    """(equal, note, spark seconds, sql seconds)"""
    t0 = time.time()
    df = query(spark, sf_dir)
    left = rows_of(df.columns, df.collect())
    t1 = time.time()
    cur = db.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time()
    if left[0] != right[0]:
        note = f"columns {left[0]} != {right[0]}"
    elif len(left[1]) != len(right[1]):
        note = f"{len(left[1])} rows != {len(right[1])}"
    else:
        note = next((f"{str(a)[:300]} != {str(b)[:300]}" for a, b in zip(left[1], right[1]) if a != b), "")
    return not note, note or f"{len(left[1])} rows", t1 - t0, t2 - t1


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db, sql = connect(sf_dir), entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            if name in sql:
                ok, note, a, b = compare(spark, db, query, sql[name], sf_dir)
            else:
                t = time.time()
                ok, note, a, b = True, f"{query(spark, sf_dir).count()} rows, no SQL", time.time() - t, 0
        except Exception as e:  # report and go on with the next query
            ok, note, a, b = False, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32} spark {a:6.2f}s sql {b:6.2f}s  {note}", flush=True)
    print("failed:", bad)
