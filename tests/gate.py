"""Run catalogue queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    return (value is None, str(type(value)) if value is None else "", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(row[i] for i in order) for row in rows]
    return sorted(columns), sorted(out, key=lambda r: [_key(v) for v in r])


def same(a, b) -> bool:
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) != isinstance(b, bool) or isinstance(a, str) != isinstance(b, str):
        return False
    if isinstance(a, float) != isinstance(b, float):
        return False
    return a == b


def compare(spark, con, name, query, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return bool(got), f"{name}: rows={len(got)} spark={t1 - t0:.1f}s (no SQL)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    head = f"{name}: rows={len(got)}/{len(want)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"{head} COLUMNS {sorted(df.columns)} != {sorted(cols)}"
    names, a = rows_of(df.columns, got)
    _, b = rows_of(cols, want)
    if len(a) != len(b):
        return False, f"{head} ROWCOUNT; spark {a[:1]} sql {b[:1]}"
    bad = [(x, y) for x, y in zip(a, b) if not all(same(u, v) for u, v in zip(x, y))]
    if bad:
        only_a = sorted(set(a) - set(b), key=str)[:2]
        only_b = sorted(set(b) - set(a), key=str)[:2]
        return False, f"{head} {len(bad)} DIFFERENT {names}\n   spark {only_a}\n   sql   {only_b}"
    return True, f"{head} ok{' EMPTY' if not a else ''}"


def main() -> int:
    import __spark_entry__ as entry
    from tickerloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("gate", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, text = False, f"{name}: {type(exc).__name__} {str(exc)[:700]}"
        failed += not ok
        print("PASS" if ok else "FAIL", text, flush=True)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
