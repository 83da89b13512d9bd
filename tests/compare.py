"""Run queries against their SQL: python tests/compare.py <sf dir> [query ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(repr(r[i]) for i in order) for r in rows))


def difference(spark, con, sf_dir, fn, sql):
    """None if both give the same columns and rows, else a short description; and the row count."""
    df = fn(spark, sf_dir)
    got_cols, got = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        sample = f"spark only {len(a)}: {sorted(a)[:2]}; sql only {len(b)}: {sorted(b)[:2]}"
        return f"rows {len(got)} / {len(want)}; {sample}"[:1200], len(got)
    return None, len(got)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from snapfold import local_session

    sf = sys.argv[1]
    chosen = sys.argv[2:] or list(queries())
    spark, con = local_session("8", "compare"), connect(sf)
    bad = 0
    for name in chosen:
        started = time.time()
        try:
            diff, n = difference(spark, con, sf, queries()[name], oracle_sql()[name])
        except Exception as e:
            diff, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} rows={n} {time.time() - started:.2f}s {diff or ''}", flush=True)
    print("all equal" if not bad else f"{bad} differ")
