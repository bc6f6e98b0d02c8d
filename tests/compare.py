"""Runs registered queries and their SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6g}"
        if isinstance(x, bool) or x is None:
            return str(x)
        return str(x)

    return sorted([tuple(value(r[i]) for i in order) for r in rows])


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = canonical(rel.fetchall(), columns)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from hoptrail.session import build_session

    spark = build_session("local[4]", "compare", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="6g")
    sf, names = sys.argv[1], sys.argv[2:]
    con, sql, queries = duck(sf), entry.oracle_sql(), entry.queries()
    bad = 0
    for name in names or sorted(queries):
        start = time.time()
        try:
            said = compare(spark, con, sf, queries[name], sql[name]) if name in sql else f"no SQL; {queries[name](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said) and not said.startswith("no SQL")
        print(f"{name}: {said or 'same'} ({time.time() - start:.1f} s)", flush=True)
    sys.exit(bool(bad))
