"""Compares queries with their SQL in DuckDB: python tests/compare.py [directory] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(directory: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(directory)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{directory}/{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differ(spark, con, f, sql, directory):
    df = f(spark, directory)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    other = rows_of([d[0] for d in rel.description], rel.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} and {other[0]}"
    if mine[1] != other[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, other[1]))
        return f"{len(mine[1])} and {len(other[1])} rows; only here {sorted(a - b)[:2]}, only there {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    from loomspark.session import local_session

    import __spark_entry__ as e

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), views(directory)
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            said = differ(spark, con, queries[name], sql[name], directory)
            n = queries[name](spark, directory).count() if said is None else ""
        except Exception as x:  # noqa: BLE001
            said, n = f"ERROR {str(x)[:600]}", ""
        print(f"{'ok ' if said is None else 'BAD'} {name} {time.time() - t:.1f} s {n} {said or ''}", flush=True)
