"""Side-by-side run of registered queries and their SQL, for tests and the command line."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    return v


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark frame and a SQL result; empty when they agree."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} sql {sorted(names)}"]
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    got = [tuple(_plain(v) for v in r) for r in df.select(*order).collect()]
    out = []
    if len(want) != len(got):
        out.append(f"rows: spark {len(got)} sql {len(want)}")

    def key(t):
        return tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in t)

    want.sort(key=key)
    got.sort(key=key)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        out.append(f"values: {len(bad)} rows differ over {order}, e.g. {bad[:3]}")
    for i, c in enumerate(order):
        a = {_kind(r[i]) for r in got if r[i] is not None}
        b = {_kind(r[i]) for r in want if r[i] is not None}
        if a != b:
            out.append(f"type of {c}: spark {a} sql {b}")
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tabloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            if name in sql:
                diff = differences(run(spark, sf_dir), con, sql[name])
                state = "ok" if not diff else "DIFF " + "; ".join(diff)
            else:
                df = run(spark, sf_dir)
                state = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on with the rest
            diff = True
            state = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += not (state == "ok" or state.startswith("rows"))
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
        spark.catalog.clearCache()
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
