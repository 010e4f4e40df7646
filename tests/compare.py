"""Run registered queries against DuckDB and report differences."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return "None" if value is None else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark, con, folder, name, queries, oracles):
    start = time.time()
    df = queries[name](spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    if name not in oracles:
        return [], len(got), middle - start, 0.0
    cursor = con.execute(oracles[name])
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    done = time.time()
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} vs {want_names}")
    elif got != want:
        g, w = set(got), set(want)
        problems.append(f"rows {len(got)} vs {len(want)}; only spark {sorted(g - w)[:3]}; only sql {sorted(w - g)[:3]}")
    return problems, len(got), middle - start, done - middle


if __name__ == "__main__":
    import __spark_entry__ as entry
    from emberline.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    bad = 0
    for name in queries:
        if wanted and not any(name.startswith(w.rstrip("*")) if w.endswith("*") else name == w for w in wanted):
            continue
        try:
            problems, n, a, b = differences(spark, con, folder, name, queries, oracles)
        except Exception as error:  # noqa: BLE001
            problems, n, a, b = [f"{type(error).__name__}: {str(error)[:600]}"], -1, 0.0, 0.0
        bad += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD' if problems else 'ok '} {name:32s} {kind:4s} rows={n:<7d} spark={a:6.2f}s duckdb={b:6.2f}s", *problems, flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
