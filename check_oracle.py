"""Run queries next to their SQL twins: python check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v) if v is not None else None


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


# DuckDB types that carry the same values as a Spark type
SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def compare(spark, con, name: str, plan, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"rows only, {len(got)} rows, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    odd = [
        (c, t, kinds[c]) for c, t in df.dtypes
        if SAME.get(t, kinds[c]) != kinds[c]
    ]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        miss = [x for x in a if x not in set(b)][:3]
        extra = [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} vs {len(b)} rows; cols {sorted(names)}; spark {miss}; sql {extra}"
    return not odd, f"{len(a)} rows, {took:.1f}s {odd or ''}"


def main() -> int:
    from scoreloom.plans.all_queries import QUERIES, SQL
    from scoreloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name, plan in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, plan, SQL.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} bad of {len(QUERIES)}")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
