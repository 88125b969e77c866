"""Compares every query with its SQL at one scale: python tests/verify.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(df):
    import math

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>", "nan"):
            return "~"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or type(x).__name__.startswith(("int", "float")):
            return repr(round(float(x), 6) + 0.0)
        return str(x)

    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(x) for x in row) for row in df[cols].astype(object).itertuples(index=False))


def main(sf_dir, names):
    import duckdb

    import __spark_entry__ as e
    from silkmill.session import session

    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for n in names or [q for q in qs if q != "pipeline" and not q.startswith("op")]:
        t = time.time()
        try:
            got = qs[n](spark, sf_dir).toPandas()
            took = time.time() - t
            if n not in sql:
                print(f"{n}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            a, b = canon(got), canon(con.sql(sql[n]).df())
            if a == b:
                print(f"{n}: {len(got)} rows equal, {took:.1f} s", flush=True)
            else:
                bad += 1
                d1, d2 = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
                print(f"{n}: DIFFERS {a[0]} {b[0]} {len(a[1])} {len(b[1])}\n   spark {str(d1)[:300]}\n   sql   {str(d2)[:300]}", flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{n}: FAILED {type(x).__name__} {str(x)[:400]}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
