"""Compare queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..")))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"{len(a[1])} rows, no SQL"
    result = con.execute(sql)
    b = rows_of([x[0] for x in result.description], result.fetchall())
    if a == b:
        return f"ok, {len(a[1])} rows"
    if a[0] != b[0]:
        return f"DIFFERENT columns {a[0]} {b[0]}"
    x, y = sorted(set(a[1]) - set(b[1])), sorted(set(b[1]) - set(a[1]))
    return f"DIFFERENT rows: {len(a[1])} and {len(b[1])}; {x[:2]} {y[:2]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            said = compare(session, name, query, sqls.get(name), sf_dir, con)
        except Exception as error:
            said = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        bad += said.startswith(("DIFF", "FAIL"))
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bad > 0)
