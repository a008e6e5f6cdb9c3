"""Compare registered queries with their SQL on DuckDB.

As a script: ``python tests/oracle.py <sf_dir> [name …]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "null" if value is None else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(con, frame, sql) -> str | None:
    """What differs, or None."""
    expected = con.execute(sql)
    columns = [d[0] for d in expected.description]
    rows = expected.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    mine, theirs = normal(frame.columns, frame.collect()), normal(columns, rows)
    if mine == theirs:
        return None
    a, b = set(mine), set(theirs)
    return f"{len(mine)} rows vs {len(theirs)}; only spark {sorted(a - b)[:2]}; only sql {sorted(b - a)[:2]}"


def main() -> None:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sys.argv[1]), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            frame = query(spark, sys.argv[1])
            if name in sqls:
                problem = difference(con, frame, sqls[name])
            else:
                problem = None if frame.count() >= 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
