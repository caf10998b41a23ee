"""Run registered queries and compare them with DuckDB: python tests/oracle.py SF_DIR [name…]"""

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def duck(sf_dir):
    import duckdb

    from sitetally.checks.bindings import TABLES
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v


def compare(spark, con, name, sf_dir):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return sum(got.values()), None
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return sum(got.values()), f"columns {cols} / {sorted(rel.columns)}"
    pick = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in pick) for r in rel.fetchall())
    if got == want:
        return sum(got.values()), "ok"
    return sum(got.values()), (f"DIFF {sum(got.values())} / {sum(want.values())} {cols} only spark: {list((got - want).items())[:3]} "
                               f"only duckdb: {list((want - got).items())[:3]}")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:] or sorted(entry.queries())
    con, bad = duck(sf), 0
    for name in names:
        t = time.time()
        try:
            rows, verdict = compare(spark, con, name, sf)
        except Exception as e:
            rows, verdict = 0, f"ERROR {type(e).__name__} {str(e)[:900]}"
        bad += verdict not in ("ok", None)
        print(f"{name:22} {time.time() - t:6.1f}s {rows:8} {verdict}", flush=True)
    print("failed:", bad)
