"""Compare registered queries with their SQL oracles in DuckDB: names, types, row count, values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9f}".replace("-0.000000000", "0.000000000")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in v.items()) + "}"
    return str(v)


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_norm(v) for v in row) for row in zip(*cols))


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    got = fn(spark, sf_dir).toArrow()
    took = time.time() - start
    if sql is None:
        return took, got.num_rows, []
    want = con.sql(sql).to_arrow_table()
    problems = []
    gn, gr = _rows(got)
    wn, wr = _rows(want)
    if gn != wn:
        problems.append(f"columns {gn} vs {wn}")
    else:
        for n in gn:
            a, b = str(got.schema.field(n).type), str(want.schema.field(n).type)
            if a.replace("large_", "") != b.replace("large_", ""):
                problems.append(f"type of {n}: {a} vs {b}")
        if len(gr) != len(wr):
            problems.append(f"rows {len(gr)} vs {len(wr)}")
        if gr != wr:
            diff = [(x, y) for x, y in zip(gr, wr) if x != y][:2]
            problems.append(f"values differ, e.g. {str(diff)[:900]}")
    if not gr:
        problems.append("no rows")
    return took, got.num_rows, problems


def main(names, sf_dir="/root/testdata/sf0.01"):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        if not any(name == q or (name.endswith("*") and q.startswith(name[:-1])) for q in queries):
            print("unknown", name)
        for q in [q for q in queries if q == name or (name.endswith("*") and q.startswith(name[:-1]))]:
            try:
                took, rows, problems = compare(spark, con, q, queries[q], oracles.get(q), sf_dir)
            except Exception as e:  # report and go on with the next query
                took, rows, problems = 0, 0, [f"{type(e).__name__}: {str(e)[:1200]}"]
            bad += bool(problems)
            mark = "BAD " if problems else ("ok  " if q in oracles else "rows")
            print(f"{mark} {q} {took:.2f}s {rows} rows", *problems, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
