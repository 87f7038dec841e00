"""Compare registered queries with their oracles: python tools_check.py SF [name-prefix ...]"""

import decimal
import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__))))


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, wanted = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    from quire.plans.registry import BASE

    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    oracles = entry.oracle_sql()
    bad = []
    for name, f in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted) or name.startswith("op") and not wanted or name == "pipeline" and not wanted:
            continue
        try:
            t0 = time.time()
            df = f(spark, folder)
            rows = df.collect()
            t1 = time.time()
            cols = sorted(df.columns)
            mine = sorted("|".join(norm(r[c]) for c in cols) for r in rows)
            if name not in oracles:
                print(f"{name:34s} rows={len(rows):7d} spark={t1 - t0:6.2f}s (no oracle)", flush=True)
                continue
            cur = con.execute(oracles[name])
            names = [d[0] for d in cur.description]
            theirs_rows = cur.fetchall()
            t2 = time.time()
            idx = [names.index(c) for c in cols] if sorted(names) == cols else None
            if idx is None:
                raise AssertionError(f"columns {cols} vs {sorted(names)}")
            theirs = sorted("|".join(norm(r[i]) for i in idx) for r in theirs_rows)
            ok = mine == theirs
            print(f"{name:34s} {'ok ' if ok else 'BAD'} rows={len(rows):7d}/{len(theirs):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s", flush=True)
            if not ok:
                bad.append(name)
                a, b = set(mine), set(theirs)
                print("   cols", cols)
                for x in sorted(a - b)[:4]:
                    print("   spark only", x[:400])
                for x in sorted(b - a)[:4]:
                    print("   duck  only", x[:400])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name:34s} ERR {str(e)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
