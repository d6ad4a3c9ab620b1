"""python tests/verify.py SF_DIR [NAME...]: queries against their SQL in DuckDB, with the rows that differ."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from tilewright.session import local_session


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if not hasattr(v, "asDict") else tuple(plain(x) for x in v)


def compare(spark, con, name, sf_dir):
    t = time.time()
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s", True
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} and {sorted(names)}", False
    order = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if got == want:
        return f"{name}: {len(got)} rows agree, {took:.1f} s" + (" (no rows!)" if not got else ""), True
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{name}: {len(got)} rows here, {len(want)} there; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}", False


if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.queries())
    spark, con, bad = local_session("8"), connect(sf_dir), 0
    for name in names:
        try:
            text, ok = compare(spark, con, name, sf_dir)
        except Exception as e:
            text, ok = f"{name}: {type(e).__name__} {str(e)[:1500]}", False
        bad += not ok
        print(("" if ok else "BAD ") + text, flush=True)
    print(bad, "bad")
