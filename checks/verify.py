"""Run queries beside their SQL on the same files: python -m checks.verify [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

import checks

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}") + 0.0
    return v


def bag(rows, columns) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = checks.QUERIES[name](spark, folder)
    got = bag([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - started
    n = sum(got.values())
    if name not in checks.ORACLES:
        return n > 0, f"{n} rows, no SQL, {took:.1f}s"
    cur = con.execute(checks.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = bag(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {names} / {df.columns}"
    if got != want:
        return False, (
            f"{n} / {sum(want.values())} rows, {took:.1f}s\n   spark only {list((got - want).items())[:4]}"
            f"\n   sql only   {list((want - got).items())[:4]}"
        )
    return n > 0, f"{n} rows, {took:.1f}s"


def main() -> None:
    from tallygrade.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    checks.load_all()
    names = [n for n in checks.QUERIES if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    spark = local_session("8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as failure:
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:900]}"
        bad += not ok
        sys.stdout.write(f"{'ok  ' if ok else 'FAIL'} {name}: {note}\n")
        sys.stdout.flush()
    sys.stdout.write(f"{len(names) - bad}/{len(names)} ok\n")


if __name__ == "__main__":
    main()
