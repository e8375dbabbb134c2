"""Run registered queries beside their SQL twins; also a small command line."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def rows_of(con, text: str):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(
        (tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr
    )


def _plain(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def compare(spark, con, root, name, queries, oracle):
    start = time.time()
    got = spark_rows(queries[name](spark, root))
    took = time.time() - start
    if name not in oracle:
        return None, took, f"{len(got[1])} rows, no oracle"
    want = rows_of(con, oracle[name])
    if got == want:
        return True, took, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, took, f"columns {got[0]} / {want[0]}"
    a, b = set(got[1]), set(want[1])
    return False, took, f"rows {len(got[1])}/{len(want[1])} only-spark {sorted(a - b, key=repr)[:3]} only-sql {sorted(b - a, key=repr)[:3]}"


def main() -> None:
    import __spark_entry__ as entry
    from landshift.session import local_session

    root = f"/root/testdata/sf{sys.argv[1]}" if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = local_session()
    con = connect(root)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, took, note = compare(spark, con, root, name, queries, oracle)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, took, note = False, 0.0, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'OK ' if ok else '-- ' if ok is None else 'BAD'} {name} {took:.2f}s {note}", flush=True)


if __name__ == "__main__":
    main()
