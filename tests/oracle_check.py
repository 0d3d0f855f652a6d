"""Compares a registered query with its DuckDB oracle; also a command line tool.

python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.9g}"
    return f"{type(value).__name__}:{value}"


def compare(spark, con, name, query, sql, sf_dir):
    """Returns (row count, list of differences)."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(canonical(v) for v in row) for row in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return sum(mine.values()), [f"columns {cols} vs {sorted(names)}"]
    at = [names.index(c) for c in cols]
    theirs = Counter(tuple(canonical(row[k]) for k in at) for row in cur.fetchall())
    problems = []
    if mine != theirs:
        extra, missing = mine - theirs, theirs - mine
        problems.append(f"{name} {cols}: {sum(mine.values())} vs {sum(theirs.values())} rows; {sum(extra.values())} extra {list(extra)[:3]}; "
                        f"{sum(missing.values())} missing {list(missing)[:3]}")
    return sum(mine.values()), problems


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    connection, bad = oracle_connection(sf), []
    oracles = e.oracle_sql()
    for key, fn in e.queries().items():
        if args and not any(a in key for a in args):
            continue
        start = time.time()
        try:
            if key in oracles:
                n, issues = compare(session, connection, key, fn, oracles[key], sf)
            else:
                n, issues = fn(session, sf).count(), []
        except Exception as error:  # report and go on with the next query
            n, issues = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'ok ' if not issues else 'BAD'} {key}: {n} rows {time.time() - start:.1f}s {'' if key in oracles else '(no oracle)'}", flush=True)
        for issue in issues:
            print("   ", issue, flush=True)
            bad.append(key)
    print("failed:", bad)
