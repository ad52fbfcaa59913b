"""Run registered queries against their SQL in DuckDB and compare by value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _kind(v):
    return "num" if isinstance(v, (int, float)) and not isinstance(v, bool) else type(v).__name__


def diff(spark_df, con, sql):
    """None when equal, else a short text."""
    scols = sorted(spark_df.columns)
    srows = [tuple(_norm(r[c]) for c in scols) for r in spark_df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    dcols = sorted(names)
    if scols != dcols:
        return f"columns spark={scols} sql={dcols}"
    ix = [names.index(c) for c in dcols]
    drows = [tuple(_norm(r[i]) for i in ix) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    s, d = sorted(srows, key=key), sorted(drows, key=key)
    if len(s) != len(d):
        extra = [r for r in s if r not in set(d)][:2], [r for r in d if r not in set(s)][:2]
        return f"rows spark={len(s)} sql={len(d)} only-spark={str(extra[0])[:400]} only-sql={str(extra[1])[:400]}"
    for a, b in zip(s, d):
        for c, x, y in zip(scols, a, b):
            if x is None and y is None:
                continue
            same = (abs(x - y) <= 2e-6 * max(1, abs(x)) if _kind(x) == "num" and _kind(y) == "num" else x == y)
            if not same:
                return f"col {c}: spark={str(x)[:200]!r} sql={str(y)[:200]!r} row={str(a)[:300]}"
            if type(x) is not type(y):
                return f"type of {c}: spark={type(x)} sql={type(y)}"
    return None


def main(argv):
    import __spark_entry__ as e
    from memspark.session import get_spark

    sf = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("--sf="):
            sf = a[5:]
        else:
            names.append(a)
    spark = get_spark(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    todo = [n for n in qs if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for n in todo:
        t = time.time()
        try:
            df = qs[n](spark, sf)
            if n in os_:
                msg = diff(df, con, os_[n])
                rows = df.count() if msg is None and "--rows" in names else ""
            else:
                msg = None
                rows = f"rows-only {df.count()}"
        except Exception as ex:  # report and go on with the next one
            msg, rows = f"{type(ex).__name__}: {str(ex)[:900]}", ""
        bad += msg is not None
        print(f"{'BAD ' if msg else 'ok  '} {n} {time.time() - t:.1f}s {rows} {msg or ''}", flush=True)
    print(f"{len(todo)} checked, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
