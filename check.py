"""Run registered queries and their SQL side by side: ``python check.py [folder] [name-part ...]``."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

from dealflux.catalog import registry
from dealflux.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def kinds(frame) -> dict[str, str]:
    text = {"large_string": "string", "string_view": "string", "halffloat": "double"}
    return {f.name: text.get(str(f.type), str(f.type)) for f in frame.schema}


def rows(frame) -> list[tuple]:
    names = sorted(frame.column_names)
    data = [frame.column(n).to_pylist() for n in names]
    return sorted(zip(*data), key=repr) if names else []


def compare(spark_table, duck_table) -> str | None:
    a, b = kinds(spark_table), kinds(duck_table)
    if set(a) != set(b):
        return f"columns {sorted(a)} <> {sorted(b)}"
    if a != b:
        return f"types { {k: (a[k], b[k]) for k in a if a[k] != b[k]} }"
    x, y = rows(spark_table), rows(duck_table)
    if len(x) != len(y):
        return f"rows {len(x)} <> {len(y)}; e.g. {x[:2]} / {y[:2]}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows differ in {sorted(a)}: {bad[:2]}" if bad else None


def main(argv: list[str]) -> int:
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    parts = argv[1:]
    registry.load()
    spark = local_session(8, "check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, run in registry.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        began = time.time()
        try:
            got = run(spark, folder).toArrow()
            took = time.time() - began
            if name in registry.ORACLES:
                want = con.sql(registry.ORACLES[name]).to_arrow_table()
                problem = compare(got, want)
            else:
                problem = None if got.num_rows else "no rows"
        except Exception as error:  # report and go on with the next query
            took, problem = time.time() - began, f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in argv:
                traceback.print_exc()
        failed += problem is not None
        kind = "S" if name in registry.ORACLES else "R"
        n = got.num_rows if problem is None else "-"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} {took:.2f}s {n} {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
