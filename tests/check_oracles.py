"""Compare every registered query with its SQL at one scale.

    python tests/check_oracles.py [scale folder] [query ...]
"""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def oracle_rows(con, sql):
    frame = con.execute(sql).to_arrow_table()
    names = sorted(frame.column_names)
    return names, _rows(frame, names), [str(frame.schema.field(n).type) for n in names]


def spark_rows(df):
    frame = df.toArrow()
    names = sorted(frame.column_names)
    return names, _rows(frame, names), [str(frame.schema.field(n).type) for n in names]


def _rows(frame, names):
    return sorted(zip(*[frame.column(n).to_pylist() for n in names]), key=repr)


def main(sf_dir, wanted):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            names, rows, types = spark_rows(query(spark, sf_dir))
            took = time.time() - start
            if name not in sql:
                print(f"---- {name:28s} {len(rows):8d} rows {took:6.2f}s (no SQL)")
                continue
            o_names, o_rows, o_types = oracle_rows(con, sql[name])
        except Exception as error:
            print(f"FAIL {name:28s} {type(error).__name__}: {str(error).splitlines()[0][:400]}")
            bad.append(name)
            continue
        same = names == o_names and rows == o_rows
        print(f"{'ok  ' if same else 'DIFF'} {name:28s} {len(rows):8d} rows {took:6.2f}s")
        if types != o_types:
            print("     types", [(n, a, b) for n, a, b in zip(names, types, o_types) if a != b])
        if not same:
            bad.append(name)
            print("     columns", names, o_names, len(rows), len(o_rows))
            for a, b in [(a, b) for a, b in zip(rows, o_rows) if a != b][:3]:
                print("      spark", str(a)[:600], "\n      sql  ", str(b)[:600])
    entry.scratch.release(spark)
    print("not equal:", bad)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(bool(main(folder, sys.argv[2:])))
